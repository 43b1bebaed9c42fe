"""Session settings the jobs rely on, and the shared scratch location."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Wall-clock columns are TIMESTAMP_NTZ, so UTC only affects the audit stamps.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Partitioned writes keep a few writers open instead of sorting each task.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    # Recording a Python stack for every column expression costs seconds on wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "spokeworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; master and sizing come from the cluster unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, under the cluster's shared checkpoint folder.

    A session that names none (a local test) uses its warehouse folder, which executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, once per application."""
    package = pathlib.Path(__file__).resolve().parent
    if any(name.endswith("/spokeworks.zip") for name in spark.sparkContext.listFiles):
        return
    bundle = pathlib.Path(tempfile.mkdtemp(prefix="spokeworks-bundle-")) / "spokeworks"
    spark.sparkContext.addPyFile(
        shutil.make_archive(str(bundle), "zip", package.parent, package.name))
