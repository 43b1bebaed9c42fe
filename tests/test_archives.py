import io
import zipfile

import landing as files
from spokeworks.plans import load
from spokeworks.plans.warehouse import Warehouse
from spokeworks.sources import manifest, specs
from spokeworks.sources.archives import expand_archives


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def test_archives_are_expanded_member_by_member(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "landing"
    inbox.mkdir()
    table = files.NYC_MODERN + "\n" + files.nyc_modern("{}", "2021-01-01 10:00:00", "2021-01-01 10:05:00") + "\n"
    inner = packed(**{"deep__c.csv": table.format("c")})
    (inbox / "2021-good.zip").write_bytes(packed(**{
        "a.csv": table.format("a"), "dir__b.csv": table.format("b"), "notes.txt": "no", "more.zip": inner,
        "bad.zip": b"not a zip"}))
    (inbox / "2021-same.zip").write_bytes(packed(**{"a.csv": table.format("a2")}))
    (inbox / "2021-broken.zip").write_bytes(b"PK nonsense")
    torn = bytearray(packed(**{"x.csv": table.format("x") * 50, "y.csv": table.format("y")}))
    torn[60:70] = b"\x00" * 10
    (inbox / "2021-torn.zip").write_bytes(torn)
    report = expand_archives(spark, manifest.list_objects(spark, str(inbox), suffix=".zip"), str(root / "nyc_csv"))
    rows = {(r.archive.rsplit("/", 1)[-1], "/".join(r.trail)): r.status for r in report.collect()}
    assert rows == {
        ("2021-good.zip", "a.csv"): "landed", ("2021-good.zip", "dir/b.csv"): "landed",
        ("2021-good.zip", "more.zip/deep/c.csv"): "landed", ("2021-good.zip", "notes.txt"): "skipped",
        ("2021-good.zip", "bad.zip"): "corrupt", ("2021-same.zip", "a.csv"): "landed",
        ("2021-broken.zip", ""): "corrupt",
        ("2021-torn.zip", "x.csv"): "in_corrupt_archive", ("2021-torn.zip", "y.csv"): "in_corrupt_archive"}
    warehouse = Warehouse(str(tmp_path / "tables"))
    load.load_prefix(spark, warehouse, str(root), "nyc_csv/")
    loaded = warehouse.raw(specs.NYC_MODERN).read(spark)
    assert sorted(r.ride_id for r in loaded.collect()) == ["a", "a2", "b", "c"]


def test_archives_of_one_name_stay_apart_and_members_stay_below(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "out" / "landing"
    table = files.NYC_MODERN + "\n" + files.nyc_modern("{}", "2021-01-01 10:00:00", "2021-01-01 10:05:00") + "\n"
    for folder in ("a", "b"):
        (inbox / folder).mkdir(parents=True)
        (inbox / folder / "2021-x.zip").write_bytes(packed(**{"t.csv": table.format(folder), "..__..__out.csv": table.format("out")}))
    report = expand_archives(spark, manifest.list_objects(spark, str(inbox), suffix=".zip"), str(root)).collect()
    assert sorted(r.status for r in report) == ["landed", "landed", "skipped", "skipped"]
    assert len({r.landed for r in report if r.landed}) == 2
    landed = list((tmp_path / "out").rglob("*.csv"))
    assert len(landed) == 2 and all(root in f.parents for f in landed)
