"""Ride data in the four raw layouts, derived from the ``lineitem`` table.

Every lineitem row becomes one ride: line status picks the city, the shifted
ship date the day and the generation, the keys the hour, stations and bike. It
includes NULL stations, stops and user types, and stops before their start.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from spokeworks.plans import marts, rides, staging
from spokeworks.session import ship_package
from spokeworks.sources import specs
from spokeworks.sources.objects import filesystem_of
from spokeworks.sources.population import seed_population

#: The columns used; declared, so that building a plan reads no footer.
LINES = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
         " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")

#: 24 years: ship dates of 1995-2001 become rides of 2019-2025.
SHIFT_DAYS = 8766

_DAY = f"date_add(cast(l_shipdate AS date), {SHIFT_DAYS})"
_START = (f"cast({_DAY} AS timestamp_ntz) + "
          "make_dt_interval(0, cast(l_partkey % 24 AS int), cast(l_suppkey % 60 AS int))")
_STATION = "CASE WHEN l_partkey % 97 <> 0 THEN cast(l_partkey AS string) END"
_ISSUED = "concat(l_orderkey, '-', l_linenumber)"


def _stop(seconds: str) -> str:
    """Every 50th part rides backwards in time, every 89th never arrives."""
    elapsed = f"make_dt_interval(0, 0, 0, cast({seconds} AS decimal(18,6)))"
    signed = f"CASE WHEN l_partkey % 50 = 0 THEN -{elapsed} ELSE {elapsed} END"
    return f"CASE WHEN l_partkey % 89 <> 0 THEN {_START} + {signed} END"


def _degrees(base: str, key: str) -> str:
    return f"double({base}) + double({key} % 5000) / double(10000)"


def _file(stem: str) -> str:
    """One source file per quarter, such as nyc-modern-2021Q3.csv."""
    return f"concat('{stem}', year({_DAY}), 'Q', quarter({_DAY}), '.csv')"


def _rider(member: str, casual: str) -> str:
    return (f"CASE l_returnflag WHEN 'R' THEN '{member}' WHEN 'A' THEN '{casual}' "
            "ELSE CASE WHEN l_partkey % 11 <> 0 THEN 'Other' END END")


def _either(even: str, odd: str) -> str:
    return f"if(l_linenumber % 2 = 0, '{even}', '{odd}')"


#: Raw layout -> {column: expression over lineitem}.
COLUMNS = {
    "nyc_legacy": {
        "tripduration": "bigint(l_quantity * 60 + l_linenumber)",
        "bikeid": "string(l_orderkey)",
        "starttime": _START,
        "stoptime": _stop("l_quantity * 60 + l_linenumber"),
        "start_station_id": _STATION,
        "start_station_name": "concat('Station ', l_partkey)",
        "start_station_latitude": _degrees("40.5", "l_partkey"),
        "start_station_longitude": _degrees("-74.0", "l_partkey"),
        "end_station_id": "string(l_suppkey)",
        "end_station_name": "concat('Station ', l_suppkey)",
        "end_station_latitude": _degrees("40.5", "l_suppkey"),
        "end_station_longitude": _degrees("-74.0", "l_suppkey"),
        "usertype": _rider("Subscriber", "Customer"),
        "birth_year": "CASE WHEN l_suppkey % 13 <> 0 THEN 1940 + l_suppkey % 60 END",
        "gender": "bigint(l_linenumber % 3)",
        "source_file": _file("nyc-legacy-"),
    },
    "nyc_modern": {
        "ride_id": _ISSUED,
        "rideable_type": _either("classic_bike", "electric_bike"),
        "started_at": _START,
        "ended_at": _stop("l_quantity * 60 + l_linenumber + l_suppkey % 4 * 0.25"),
        "start_station_id": _STATION,
        "start_station_name": "concat('Station ', l_partkey)",
        "end_station_id": "string(l_suppkey)",
        "end_station_name": "concat('Station ', l_suppkey)",
        "start_lat": _degrees("40.5", "l_partkey"),
        "start_lng": _degrees("-74.0", "l_partkey"),
        "end_lat": _degrees("40.5", "l_suppkey"),
        "end_lng": _degrees("-74.0", "l_suppkey"),
        "member_casual": _rider("member", "casual"),
        "source_file": _file("nyc-modern-"),
    },
    "london_legacy": {
        "rental_id": _ISSUED,
        "bike_id": "string(l_suppkey)",
        "start_date": _START,
        "end_date": _stop("l_quantity * 60"),
        "duration": "bigint(l_quantity * 60)",
        "start_station_id": _STATION,
        "start_station_name": "concat('Station ', l_partkey)",
        "end_station_id": "string(l_suppkey)",
        "end_station_name": "concat('Station ', l_suppkey)",
        "source_file": _file("london-legacy-"),
    },
    "london_modern": {
        "number": _ISSUED,
        "bike_number": "string(l_suppkey)",
        "bike_model": _either("CLASSIC", "PBSC_EBIKE"),
        "start_date": _START,
        "end_date": _stop("l_quantity * 60"),
        "total_duration": "concat(bigint(l_quantity), 'm 0s')",
        "total_duration_ms": "bigint(l_quantity * 60000)",
        "start_station_number": _STATION,
        "start_station": "concat('Station ', l_partkey)",
        "end_station_number": "string(l_suppkey)",
        "end_station": "concat('Station ', l_suppkey)",
        "source_file": _file("london-modern-"),
    },
}

#: City -> (line status of its rides, first day of its modern layout).
CITIES = {"nyc": ("O", dt.date(2021, 2, 1)), "london": ("F", dt.date(2022, 9, 1))}


@dataclass(frozen=True)
class SampleRides:
    """Raw, staging, ride and mart relations over one folder of test tables."""

    spark: SparkSession
    sf_dir: str

    def raw(self, source: str) -> DataFrame:
        spec = specs.get(source)
        status, modern_from = CITIES[spec.location]
        # On the stored column, so that the date range reaches the Parquet scan.
        switch = modern_from - dt.timedelta(days=SHIFT_DAYS)
        side = ">=" if spec.generation == "modern" else "<"
        lines = (self.spark.read.schema(LINES).parquet(f"{self.sf_dir.rstrip('/')}/lineitem.parquet")
                 .filter(f"l_linestatus = '{status}' AND l_shipdate {side} timestamp_ntz'{switch} 00:00:00'"))
        return lines.selectExpr(*[f"{value} AS `{name}`" for name, value in COLUMNS[source].items()])

    def staging(self, source: str) -> DataFrame:
        return staging.MODELS[source](self.raw(source))

    def nyc_rides(self) -> DataFrame:
        return rides.int_nyc_rides(self.staging("nyc_modern"), self.staging("nyc_legacy"))

    def london_rides(self) -> DataFrame:
        return rides.int_london_rides(self.staging("london_modern"), self.staging("london_legacy"))

    def rides(self, city: str) -> DataFrame:
        return {"nyc": self.nyc_rides, "london": self.london_rides}[city]()

    def both_rides(self) -> DataFrame:
        return self.nyc_rides().unionByName(self.london_rides(), allowMissingColumns=True)

    def population(self) -> DataFrame:
        return seed_population(self.spark)

    def daily(self, city: str) -> DataFrame:
        return marts.daily_metrics(self.rides(city), self.population(), has_members=city == "nyc")

    def hourly(self, city: str) -> DataFrame:
        return marts.hourly_patterns(self.rides(city))

    def members(self) -> DataFrame:
        return marts.member_analysis(self.nyc_rides())

    def growth(self, city: str) -> DataFrame:
        return marts.station_growth(self.rides(city), self.population())

    def long(self) -> DataFrame:
        return marts.metrics_long(marts.combined_daily(self.daily("nyc"), self.daily("london")))

    # -- files ----------------------------------------------------------------

    def names(self) -> DataFrame:
        """(prefix, source_file) of every sample file, as a manifest without folders."""
        per_source = [
            self.raw(s.name).select(F.lit(s.prefix).alias("prefix"), "source_file").distinct()
            for s in specs.registered()
        ]
        every = per_source[0]
        for more in per_source[1:]:
            every = every.unionByName(more)
        return every.withColumn("key", F.concat("prefix", "source_file"))

    def landing_text(self, source: str, without: tuple[str, ...] = ()) -> DataFrame:
        """Raw rows as the text a landing file holds, under its headers."""
        spec = specs.get(source)
        written = {  # casts to text, as date_format would apply the session zone
            "iso": "string(`{0}`)",
            "iso_minutes": "left(string(`{0}`), 16)",
            "day_first_minutes": "regexp_replace(string(`{0}`), '^(....)-(..)-(..) (..:..).*$', '$3/$2/$1 $4')",
        }
        return self.raw(source).selectExpr(*[
            (written[f.layouts[0]] if f.kind == "timestamp_ntz" else "string(`{0}`)").format(f.name)
            + f" AS `{f.header}`" for f in spec.fields if f.header not in without
        ], "source_file")

    def write_landing(self, root: str, *sources: str) -> str:
        """CSV files in the folders the loader expects, of the given layouts or all four.

        Some modern files come with their columns reordered, an extra column, or
        an optional one missing; a copy of the legacy rides lacks required ones.
        """
        def land(rows: DataFrame, folder: str) -> None:
            rows.write.option("header", True).partitionBy("source_file").csv(f"{root}/{folder}")

        wanted = sources or tuple(staging.MODELS)
        if "nyc_legacy" in wanted:
            land(self.landing_text("nyc_legacy"), "nyc_csv/legacy")
            land(self.landing_text("nyc_legacy", without=("usertype", "gender")), "nyc_csv/incomplete")
        if "nyc_modern" in wanted:
            modern = self.landing_text("nyc_modern")
            land(modern.filter("rideable_type = 'classic_bike'"), "nyc_csv/classic")
            turned = modern.filter("rideable_type = 'electric_bike'")
            order = [c for c in reversed(turned.columns) if c != "source_file"]
            land(turned.select(*order, F.lit("kept out").alias("remark"), "source_file"), "nyc_csv/electric")
        if "london_legacy" in wanted:
            land(self.landing_text("london_legacy"), "london_csv/legacy")
        if "london_modern" in wanted:
            land(self.landing_text("london_modern").filter("`Bike model` = 'CLASSIC'"), "london_csv/classic")
            land(self.landing_text("london_modern", without=("Total duration (ms)",))
                 .filter("`Bike model` <> 'CLASSIC'"), "london_csv/ebike")
        return root

    def write_archives(self, folder: str) -> str:
        """Modern NYC rides in zip archives, one per task, with a nested one and a note in each."""
        ship_package(self.spark)
        rows = self.landing_text("nyc_modern").drop("source_file")
        rows.mapInPandas(_zip_writer(folder), "archive string").write.format("noop").mode("overwrite").save()
        return folder


def _zip_writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = filesystem_of(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"2021-trips-{TaskContext.get().partitionId():05d}.zip"
        with filesystem.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("notes.txt", "not a table")
            for number, batch in enumerate(batches):
                member, text = f"trips-{number:05d}.csv", batch.to_csv(index=False)
                if number % 2 == 0:
                    archive.writestr(f"part/{member}", text)
                    continue
                nested = io.BytesIO()
                with zipfile.ZipFile(nested, "w", zipfile.ZIP_DEFLATED) as inner:
                    inner.writestr(member, text)
                archive.writestr(f"nested-{number:05d}.zip", nested.getvalue())
        yield pd.DataFrame({"archive": [name]})
    return write
