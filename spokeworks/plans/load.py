"""Landing folder to raw tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from spokeworks.operators.increments import delete_partitions
from spokeworks.plans.warehouse import FILE, Warehouse
from spokeworks.session import scratch_path
from spokeworks.sources import csv_scan, headers, manifest as landing, specs
from spokeworks.sources.tables import ParquetTable, delete

#: Bounds of a batch: bytes to scan, and paths the driver holds.
BATCH_BYTES, BATCH_FILES = 256 << 30, 10_000


@dataclass(frozen=True)
class Selection:
    """Which landed files to take; everything under the prefix by default."""

    year: int | None = None
    filename: str | None = None
    cutoff: str | None = None

    def apply(self, manifest: DataFrame) -> DataFrame:
        chosen = landing.with_year_text(manifest, self.year)
        chosen = landing.with_file_name(chosen, self.filename)
        return chosen if self.cutoff is None else landing.from_cutoff(chosen, self.cutoff)


def route(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with header and layout, written once so that each file is opened once."""
    path = scratch_path(spark, "routes")
    headers.assign_source(headers.with_headers(manifest)).write.parquet(path)
    return spark.read.parquet(path)


def entries(spark: SparkSession, warehouse: Warehouse, sources: Sequence[str] | None = None) -> DataFrame:
    """The latest ledger entry of every object: (source_file, landed_id, bytes, rows, rejected, version)."""
    ledger = warehouse.ledger().read(spark)
    facts = F.struct("at", F.isnotnull("rows").alias("done"), "bytes", "rows", "rejected", "version")
    return ((ledger if sources is None else ledger.filter(F.col("source").isin(*sources)))
            .groupBy(*FILE).agg(F.max(facts).alias("last"))
            .select(*FILE, "last.bytes", "last.rows", "last.rejected", F.coalesce("last.version", F.lit("")).alias("version")))


def loaded_versions(spark: SparkSession, warehouse: Warehouse, sources: Sequence[str]) -> DataFrame | None:
    """(source_file, landed_id, version) of what the raw tables hold; None where they were not filled by a load."""
    done = entries(spark, warehouse, sources).filter("rows IS NOT NULL").select(*FILE, "version")
    return None if done.isEmpty() else done


def not_loaded(spark: SparkSession, warehouse: Warehouse, routed: DataFrame) -> DataFrame:
    """Drops objects whose load the ledger knows as done, with rows or without, in the version that lies there now."""
    done = entries(spark, warehouse).filter("rows IS NOT NULL").select(*FILE, F.nullif("version", F.lit("")).alias("loaded"))
    same = [routed[c] == done[c] for c in FILE]
    return routed.join(done, [*same, F.coalesce(done["loaded"] == routed["version"], F.lit(True))], "left_anti")


@dataclass(frozen=True)
class Batch:
    """Files of one layout that are read together."""

    spec: specs.SourceSpec
    scans: dict[tuple[str, ...], list[str]]
    objects: list[tuple]

    def only(self, paths: set[str]) -> dict[tuple[str, ...], list[str]]:
        """The scans of these paths alone."""
        chosen = {header: [p for p in of if p in paths] for header, of in self.scans.items()}
        return {header: of for header, of in chosen.items() if of}

    def frame(self, spark: SparkSession) -> DataFrame:
        """(path, source_file, landed_id, bytes, version) of the files."""
        return spark.createDataFrame(self.objects, "path string, source_file string, landed_id string, bytes bigint, version string")


def file_batches(routed: DataFrame, batch_bytes: int = BATCH_BYTES, batch_files: int = BATCH_FILES,
                 headers_per_batch: int = 16) -> Iterator[Batch]:
    """Groups of files of bounded bytes, paths and headers, whatever the number of files.

    Paths stream to the driver in order, a batch at a time; a scan needs them by name.
    """
    ordered = (routed.filter("source is not null").select("source", "header", "path", "source_file", "landed_id", "bytes", "version")
               .orderBy("source", "header", "path"))
    for source, rows in itertools.groupby(ordered.toLocalIterator(), lambda r: r.source):
        scans, objects, held = {}, [], 0
        for row in rows:
            header = tuple(row.header)
            full = held + row.bytes > batch_bytes or len(objects) == batch_files
            if objects and (full or (header not in scans and len(scans) == headers_per_batch)):
                yield Batch(specs.get(source), scans, objects)
                scans, objects, held = {}, [], 0
            scans.setdefault(header, []).append(row.path)
            objects.append((row.path, row.source_file, row.landed_id, row.bytes, row.version))
            held += row.bytes
        yield Batch(specs.get(source), scans, objects)


def _enter(warehouse: Warehouse, source: str, files: DataFrame, rows: Column, rejected: Column) -> None:
    warehouse.ledger_of(source).append(files.withColumns({"rows": rows, "rejected": rejected, "at": F.current_timestamp()}))


def _publish(spark: SparkSession, warehouse: Warehouse, spec: specs.SourceSpec, aligned: DataFrame) -> None:
    seen = Observation()
    watched = aligned.observe(seen, F.count_if(F.size("problems") > 0).alias("rejected"))
    warehouse.raw(spec).replace_partitions(csv_scan.good_rows(watched))
    if seen.get["rejected"]:
        warehouse.rejects().replace_partitions(csv_scan.rejected_values(aligned, spec))


def load_batch(spark: SparkSession, warehouse: Warehouse, batch: Batch) -> None:
    """Publish the files of a batch and enter them in the ledger.

    Objects the ledger knows are cleared first, so that a new version without a good row, or
    without a bad one, leaves nothing of the old behind. A run that dies in between left them
    entered as begun, and so they are loaded again.
    """
    files, table, nothing = batch.frame(spark), warehouse.raw(batch.spec), F.lit(None).cast("bigint")
    known = files.join(entries(spark, warehouse), list(FILE), "left_semi").select(*FILE).collect()
    _enter(warehouse, batch.spec.name, files, nothing, nothing)
    for old in (table, warehouse.rejects()):
        delete_partitions(spark, old, known)
    _publish(spark, warehouse, batch.spec, csv_scan.scan_aligned(spark, batch.spec, batch.scans))
    cut = csv_scan.cut_files(warehouse.rejects().read(spark).join(F.broadcast(files.select(*FILE)), list(FILE), "left_semi"))
    torn = files.join(cut, list(FILE)).select("path", *FILE).collect()
    if torn:  # read again by rows that quotes hold together
        for old in (table, warehouse.rejects()):
            delete_partitions(spark, old, torn)
        _publish(spark, warehouse, batch.spec,
                 csv_scan.scan_aligned(spark, batch.spec, batch.only({r.path for r in torn}), broken=True))

    def held(stored: ParquetTable, name: str) -> DataFrame:
        return (stored.read(spark).join(F.broadcast(files.select(*FILE)), list(FILE), "left_semi")
                .groupBy(*FILE).agg(F.count("*").alias(name)))

    done = (files.join(held(table, "good"), list(FILE), "left")
            .join(held(warehouse.rejects(), "bad"), list(FILE), "left"))
    _enter(warehouse, batch.spec.name, done, F.coalesce("good", F.lit(0).cast("bigint")), F.coalesce("bad", F.lit(0).cast("bigint")))


def load_routed(spark: SparkSession, warehouse: Warehouse, routed: DataFrame, **bounds: int) -> None:
    """Scan, align and publish the files batch by batch; unreadable values go to the rejects.

    Layouts have tables of their own, so their jobs run side by side.
    """
    def load_source(source: str) -> None:
        for batch in file_batches(routed.filter(F.col("source") == source), **bounds):
            load_batch(spark, warehouse, batch)

    found = [r.source for r in routed.select("source").dropna().distinct().collect()]
    with ThreadPoolExecutor(4) as jobs:
        for job in [jobs.submit(load_source, source) for source in found]:
            job.result()


COUNTS = "source_file string, rows bigint, rejected bigint, target string"


def count_routed(spark: SparkSession, routed: DataFrame, **bounds: int) -> DataFrame:
    """Dry run: rows each file would add to which table, nothing written to the warehouse.

    Each batch is counted by a job of its own, so no plan grows with the number of files.
    """
    path = scratch_path(spark, "dry-run")
    spark.createDataFrame([], COUNTS).write.parquet(path)

    def count(spec: specs.SourceSpec, aligned: DataFrame) -> DataFrame:
        cut = F.count_if(F.exists("problems", lambda p: p["column"] == csv_scan.LINE)) > 0
        return (aligned.groupBy(*FILE).agg(F.count_if(F.size("problems") == 0).alias("rows"),
                                           F.count_if(F.size("problems") > 0).alias("rejected"), cut.alias("cut"))
                .withColumn("target", F.lit(spec.table)))

    for batch in file_batches(routed, **bounds):
        first = scratch_path(spark, "dry-run-batch")
        count(batch.spec, csv_scan.scan_aligned(spark, batch.spec, batch.scans)).write.parquet(first)
        counted = spark.read.parquet(first)
        torn = batch.frame(spark).join(counted.filter("cut"), list(FILE)).select("path").collect()
        if torn:
            again = csv_scan.scan_aligned(spark, batch.spec, batch.only({r.path for r in torn}), broken=True)
            counted = counted.filter("NOT cut").unionByName(count(batch.spec, again))
        counted.select("source_file", "rows", "rejected", "target").write.mode("append").parquet(path)
        delete(spark, first)
    return (spark.read.schema(COUNTS).parquet(path).groupBy("source_file", "target")
            .agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected")))


def load_listed(spark: SparkSession, warehouse: Warehouse, listed: DataFrame,
                selection: Selection = Selection(), dry_run: bool = False,
                only_new: bool = False, **bounds: int) -> DataFrame:
    """Load the objects of a manifest; returns the dry-run counts or the routing of each file.

    In the routing, ``source`` is NULL for files no layout fits.
    """
    routed = route(spark, selection.apply(listed))
    if only_new:
        routed = not_loaded(spark, warehouse, routed)
    if dry_run:
        return count_routed(spark, routed, **bounds)
    load_routed(spark, warehouse, routed, **bounds)
    return routed


def load_prefix(spark: SparkSession, warehouse: Warehouse, root: str, prefix: str,
                selection: Selection = Selection(), **options) -> DataFrame:
    """``load_listed`` for one source folder."""
    return load_listed(spark, warehouse, landing.list_objects(spark, root, prefix=prefix), selection, **options)


class LoadFailed(RuntimeError):
    """What ``load_all`` raises where a prefix failed; ``outcome`` says how each one went."""

    def __init__(self, outcome: dict[str, str]):
        super().__init__("; ".join(f"{prefix} {how}" for prefix, how in outcome.items()))
        self.outcome = outcome


def _listed(spark: SparkSession, root: str, prefix: str) -> DataFrame | None:
    """The objects below the prefix, None where its folder is not there; a path lost later is a failure."""
    try:
        return landing.list_objects(spark, root, prefix=prefix)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_all(spark: SparkSession, warehouse: Warehouse, root: str, **options) -> dict[str, str]:
    """Every registered prefix in turn; a failing one does not stop the next, and is raised once all were tried."""
    outcome, failed = {}, []
    for prefix in specs.prefixes():
        outcome[prefix] = "nothing landed"
        try:
            listed = _listed(spark, root, prefix)
            if listed is not None:
                load_listed(spark, warehouse, listed, **options)
                outcome[prefix] = "loaded"
        except Exception as problem:  # isolation between sources is the point here
            outcome[prefix] = f"failed: {problem}"
            failed.append(problem)
    if failed:
        raise LoadFailed(outcome) from failed[0]
    return outcome
