"""Landed objects as a DataFrame: path, name, size - never their content.

``binaryFile`` lists the folder; as ``content`` is not selected no object is
opened. Every selection below is an ordinary filter on this manifest.
"""

from __future__ import annotations

import datetime as dt
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Fixed value: monthly and weekly extracts are named like this in the source index.
EXTRACT_NAME = r"(?i)Journey\s?Data\s?Extract.*\.csv"


def landed_id(uri: Column) -> Column:
    """Short identity of a landed object; two objects may share a basename."""
    return F.lower(F.hex(F.xxhash64(uri)))


def describe(listing: DataFrame, root: str, prefix: str) -> DataFrame:
    """Manifest columns of a binary-file listing; ``key`` is the path below the root.

    ``version`` tells one content of an object from the next: its size and when it was written.
    """
    uri = F.col("_metadata.file_path")
    below_root = F.split("path", f"\\Q{urlparse(root).path.rstrip('/')}\\E/", 2)
    return listing.select(
        "path", F.element_at(below_root, -1).alias("key"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.col("length").alias("bytes"), F.lit(prefix).alias("prefix"),
        landed_id(uri).alias("landed_id"),
        F.concat_ws("-", "length", F.unix_micros("modificationTime")).alias("version"))


def list_objects(spark: SparkSession, root: str, suffix: str = ".csv", prefix: str = "") -> DataFrame:
    """Objects with the suffix below root/prefix."""
    listing = (spark.read.format("binaryFile")
               .option("recursiveFileLookup", True)
               .option("pathGlobFilter", f"*{suffix}")
               .load(f"{root.rstrip('/')}/{prefix}".rstrip("/")))
    return describe(listing, root, prefix)


def with_year_text(manifest: DataFrame, year: int | None) -> DataFrame:
    """Keep keys that contain the year's digits anywhere."""
    return manifest if year is None else manifest.filter(F.col("key").contains(str(year)))


def with_file_name(manifest: DataFrame, name: str | None) -> DataFrame:
    return manifest if name is None else manifest.filter(F.col("source_file") == name)


def archives_between(manifest: DataFrame, start_year: int = 2018, end_year: int | None = None) -> DataFrame:
    """Zip archives whose name starts with a year in the range."""
    last = dt.date.today().year if end_year is None else end_year
    year = F.regexp_extract("source_file", r"^(\d{4})", 1)
    return manifest.filter(F.col("source_file").endswith(".zip")
                           & year.try_cast("int").between(start_year, last))


def extracts_since(manifest: DataFrame, start_year: int = 2019) -> DataFrame:
    """Journey extracts, by name, whose first 20xx is the given year or later."""
    year = F.regexp_extract("source_file", r"(20\d{2})", 1)
    return manifest.filter(F.col("source_file").rlike(EXTRACT_NAME)
                           & (year.try_cast("int") >= start_year))


def from_cutoff(manifest: DataFrame, cutoff: str) -> DataFrame:
    """Files named at or after the cut-off file; none if that file never landed."""
    landed = manifest.filter(F.col("source_file") == cutoff).exists()
    return manifest.filter((F.col("source_file") >= cutoff) & landed)


def fingerprints(spark: SparkSession, root: str, prefix: str = "", suffix: str = ".csv") -> DataFrame:
    """(key, lines, fingerprint) of every object that has a line, from its lines in splits.

    The fingerprint is made of sums over the lines, so blocks add up in any order, and two objects with the same
    lines in another order count as the same.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
             .text(f"{root.rstrip('/')}/{prefix}".rstrip("/")).select("value", F.col("_metadata.file_path").alias("uri")))
    below = F.element_at(F.split(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), f"\\Q{urlparse(root).path.rstrip('/')}\\E/", 2), -1)
    hashed = F.xxhash64("value")
    return (lines.groupBy("uri").agg(F.count("*").alias("lines"), F.sum(F.shiftright(hashed, 32)).alias("high"),
                                     F.sum(hashed.bitwiseAND(0xFFFFFFFF)).alias("low"))
            .select(below.alias("key"), "lines", F.concat_ws("-", "lines", "high", "low").alias("fingerprint")))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, old_key, state) of two indexes (key, fingerprint): same, changed, new, gone or renamed.

    A new key with the fingerprint of one that is gone is that object renamed, one for one in the order of their keys.
    """
    both = (before.select("key", F.col("fingerprint").alias("old")).join(after.select("key", F.col("fingerprint").alias("now")), "key", "full_outer"))
    held = both.filter("old IS NOT NULL AND now IS NOT NULL").select(
        "key", F.col("key").alias("old_key"), F.when(F.col("old") == F.col("now"), "same").otherwise("changed").alias("state"))
    number = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("key"))
    gone = both.filter("now IS NULL").select(F.col("key").alias("old_key"), F.col("old").alias("fingerprint"), number("old").alias("number"))
    new = both.filter("old IS NULL").select("key", F.col("now").alias("fingerprint"), number("now").alias("number"))
    moved = new.join(gone, ["fingerprint", "number"], "full_outer").select(
        F.coalesce("key", "old_key").alias("key"), "old_key",
        F.when(F.col("old_key").isNull(), "new").when(F.col("key").isNull(), "gone").otherwise("renamed").alias("state"))
    return held.unionByName(moved)
