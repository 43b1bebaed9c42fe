"""The file-once rule as streams: from landing to raw tables, and from the load ledger to rides.

A stream of files sees a path once, so an object that was rewritten in place is loaded by a batch with ``only_new``;
the ledger's entry of that load then brings its new rides through ``stream_rides``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spokeworks.plans import refresh
from spokeworks.plans.load import load_routed, route
from spokeworks.plans.warehouse import FILE, LEDGER_SCHEMA, Warehouse
from spokeworks.sources.manifest import describe

#: What the binary-file source yields for a listed object.
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def stream_landing(spark: SparkSession, warehouse: Warehouse, root: str, prefix: str,
                   checkpoint: str, files_per_trigger: int = 2_000) -> StreamingQuery:
    """Load the files that landed since the last run, then stop.

    The stream carries paths only. A micro-batch that is replayed after a crash
    rewrites the partitions of its files, so nothing is loaded twice.
    """
    listing = (spark.readStream.format("binaryFile").schema(LISTING)
               .option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.csv")
               .option("maxFilesPerTrigger", files_per_trigger)
               .load(f"{root.rstrip('/')}/{prefix}".rstrip("/")))
    manifest = describe(listing, root, prefix)

    def load(batch: DataFrame, _: int) -> None:
        load_routed(batch.sparkSession, warehouse, route(batch.sparkSession, batch))

    return (manifest.writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_rides(spark: SparkSession, warehouse: Warehouse, checkpoint: str, on_duplicates: str = "error",
                 entries_per_trigger: int = 200) -> StreamingQuery:
    """Take the files of every load that was done since the last run to the ride tables, then stop.

    The stream is the load ledger, which every load appends to: it carries names, never rides. Which of these files
    are new, and which were loaded again with another content, is decided by their versions, so a micro-batch that is
    replayed takes nothing twice.
    """
    ledger = (spark.readStream.schema(f"{LEDGER_SCHEMA}, source string").option("maxFilesPerTrigger", entries_per_trigger)
              .parquet(warehouse.ledger().path))

    def take(batch: DataFrame, _: int) -> None:
        done = batch.filter("rows IS NOT NULL").select(*FILE).distinct()
        refresh.refresh_rides(batch.sparkSession, warehouse, on_duplicates=on_duplicates, only=done)

    return (ledger.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
