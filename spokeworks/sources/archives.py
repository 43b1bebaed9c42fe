"""Zip archives to landed CSV files, one task per member.

Three small jobs: list the members of every archive (nested archives included),
check each member's checksum, copy the CSV members out. The unit of work is a
member, so one huge archive still spreads over the cluster, and members are
streamed in blocks, so their size does not matter either.
"""

from __future__ import annotations

import shutil
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from urllib.parse import urlparse

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from spokeworks.session import scratch_path, ship_package
from spokeworks.sources.objects import filesystem_of, open_object

BLOCK = 4 * 1024 * 1024
MEMBERS = "archive string, trail array<string>, kind string"
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError)


def _kind(name: str) -> str:
    return "csv" if name.endswith(".csv") else "zip" if name.endswith(".zip") else "other"


def _walk(handle, trail: list[str]) -> Iterator[tuple[list[str], str]]:
    try:
        with zipfile.ZipFile(handle) as archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                inner, kind = trail + [info.filename], _kind(info.filename)
                if not _stays_below(inner):
                    kind = "other"
                yield inner, kind
                if kind == "zip":
                    with archive.open(info) as nested:
                        yield from _walk(nested, inner)
    except UNREADABLE:
        yield trail, "corrupt"


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with open_object(path) as handle:
                found = pd.DataFrame(_walk(handle, []), columns=["trail", "kind"])
            found.insert(0, "archive", path)
            yield found


def _open_member(stack: ExitStack, archive: str, trail: list[str]):
    handle = stack.enter_context(open_object(archive))
    for name in trail:
        handle = stack.enter_context(stack.enter_context(zipfile.ZipFile(handle)).open(name))
    return handle


def _check_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        states = []
        for archive, trail in zip(batch["archive"], batch["trail"]):
            try:
                with ExitStack() as stack:
                    member = _open_member(stack, archive, list(trail))
                    while member.read(BLOCK):
                        pass
                states.append(True)
            except UNREADABLE:
                states.append(False)
        yield batch.assign(intact=states)


def _below(steps: list[str]) -> str:
    """The steps as one relative path; a name that leaves its folder is not a member to land."""
    parts = [part for step in steps for part in step.replace("\\", "/").split("/") if part not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"{'/'.join(steps)} leaves its folder")
    return "/".join(parts)


def _place_of(archive: str) -> str:
    """Name of an archive with a short identity of its path: archives of one name stay apart."""
    return f"{xxhash.xxh32_hexdigest(urlparse(archive).path)}-{archive.rsplit('/', 1)[-1]}"


def _stays_below(trail: list[str]) -> bool:
    return ".." not in "/".join(trail).replace("\\", "/").split("/")


def _copier(destination: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = filesystem_of(destination)
        for batch in batches:
            landed = []
            for archive, trail in zip(batch["archive"], batch["trail"]):
                target = f"{base}/{_below([_place_of(archive), *trail])}"
                filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                # A retried task writes the same bytes again and moves them into place.
                part = f"{target}.{uuid.uuid4().hex}.part"
                with ExitStack() as stack:
                    member = _open_member(stack, archive, list(trail))
                    out = stack.enter_context(filesystem.open_output_stream(part))
                    shutil.copyfileobj(member, out, BLOCK)
                filesystem.move(part, target)
                landed.append(target)
            yield batch.assign(landed=landed)
    return copy


def _one_row_per_task(rows: DataFrame, *keys: str) -> DataFrame:
    """Spread small rows that stand for large work; the row count is a written table's."""
    return rows.repartition(max(1, min(rows.count(), 20_000)), *keys)


def list_members(archives: DataFrame) -> DataFrame:
    """Every member of every archive: (archive, trail of names, kind)."""
    ship_package(archives.sparkSession)
    return _one_row_per_task(archives.select("path"), "path").mapInPandas(_list_members, MEMBERS)


def expand_archives(spark: SparkSession, archives: DataFrame, destination: str) -> DataFrame:
    """Copy all CSV members below ``destination``; returns (archive, trail, status, landed).

    A damaged archive is left out whole, with what it contains; other members
    than ``.csv`` and ``.zip`` are skipped. Neither stops the rest.
    """
    ship_package(spark)
    work = scratch_path(spark, "archives")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    members = written("members", list_members(archives))
    sound = members.filter("kind <> 'corrupt'")
    checked = written("checked", _one_row_per_task(sound, "archive", "trail")
                      .mapInPandas(_check_members, MEMBERS + ", intact boolean"))
    container = F.slice("trail", F.lit(1), F.size("trail") - 1)
    damaged = (checked.filter(~F.col("intact")).select("archive", container.alias("box"))
               .union(members.filter("kind = 'corrupt'").select("archive", F.col("trail").alias("box")))
               .distinct().withColumnRenamed("archive", "box_archive"))
    inside = ((F.col("archive") == F.col("box_archive"))
              & (F.slice("trail", F.lit(1), F.size("box")) == F.col("box")))
    usable = sound.join(damaged, inside, "left_anti")
    wanted = written("wanted", usable.filter("kind = 'csv'").select("archive", "trail", "kind"))
    landed = written("landed", _one_row_per_task(wanted, "archive", "trail")
                     .mapInPandas(_copier(destination), MEMBERS + ", landed string"))
    not_usable = sound.join(damaged, inside, "left_semi").filter("kind = 'csv'")
    nothing = F.lit(None).cast("string").alias("landed")
    return (landed.select("archive", "trail", F.lit("landed").alias("status"), "landed")
            .union(not_usable.select("archive", "trail", F.lit("in_corrupt_archive"), nothing))
            .union(members.filter("kind = 'corrupt'").select("archive", "trail", F.lit("corrupt"), nothing))
            .union(usable.filter("kind = 'other'").select("archive", "trail", F.lit("skipped"), nothing)))
