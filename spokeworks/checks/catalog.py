"""Every registered query next to the SQL that must give the same rows.

A query takes the sample rides of one test folder and runs over whole tables.
Decimals are shipped as doubles and audit stamps are left out, so that both
engines return the same types.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from spokeworks.checks.relations import RIDE_COLUMNS_LONDON, RIDE_COLUMNS_NYC, with_relations
from spokeworks.functions import columns as c
from spokeworks.operators import increments, quality
from spokeworks.plans import load, marts, refresh, reports, rides
from spokeworks.plans.reports import Period
from spokeworks.plans.warehouse import Warehouse
from spokeworks.samples import SampleRides
from spokeworks.session import scratch_path
from spokeworks.sources import archives, csv_scan, headers, manifest, population, specs
from spokeworks.streaming.file_loads import stream_landing, stream_rides

AUDIT_COLUMNS = ("dbt_updated_at", "ingested_at", "landed_id")
PERIOD = Period(dt.date(2019, 3, 15), dt.date(2024, 10, 10))
BETWEEN = "date BETWEEN TIMESTAMP '2019-03-15' AND TIMESTAMP '2024-10-10'"
WIDE = Period(dt.date(2018, 1, 1), dt.date(2030, 1, 1))


@dataclass(frozen=True)
class Query:
    build: Callable[[SampleRides], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SampleRides], DataFrame]):
        CATALOG[name] = Query(build, None if sql is None else with_relations(sql))
        return build
    return add


def shipped(df: DataFrame) -> DataFrame:
    """Comparable types, without audit stamps."""
    def plain(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            return F.col(field.name).cast("bigint").alias(field.name)
        return F.col(field.name)
    return df.select(*[plain(f) for f in df.schema.fields if f.name not in AUDIT_COLUMNS])


def _warehouse(s: SampleRides) -> Warehouse:
    return Warehouse(scratch_path(s.spark, "warehouse"))


def _landed(rides: DataFrame) -> DataFrame:
    """Rides with the identity their file would have had."""
    return rides.withColumn("landed_id", manifest.landed_id(F.col("source_file")))


NYC = ("nyc_legacy", "nyc_modern")
LONDON = ("london_legacy", "london_modern")


def _landing(s: SampleRides, *sources: str) -> str:
    return s.write_landing(scratch_path(s.spark, "landing"), *sources)


def _folder_file():
    """Name of the sample file a landed part belongs to: Spark names its folder after it."""
    return F.regexp_extract("key", r"source_file=([^/]+)/", 1)


def _routed(s: SampleRides, *sources: str) -> DataFrame:
    root = _landing(s, *sources)
    prefixes = dict.fromkeys(specs.get(name).prefix for name in sources or NYC + LONDON)
    routed = None
    for prefix in prefixes:
        listed = manifest.list_objects(s.spark, root, prefix=prefix)
        routed = listed if routed is None else routed.unionByName(listed)
    return load.route(s.spark, routed)


# == scans, sources, sinks =====================================================

_NAMES = """(
  SELECT DISTINCT 'nyc_csv/' AS prefix, source_file FROM raw_nyc_legacy UNION ALL
  SELECT DISTINCT 'nyc_csv/', source_file FROM raw_nyc_modern UNION ALL
  SELECT DISTINCT 'london_csv/', source_file FROM raw_london_legacy UNION ALL
  SELECT DISTINCT 'london_csv/', source_file FROM raw_london_modern) names"""


@query("s1_list_files", f"SELECT DISTINCT source_file FROM {_NAMES} "
                        "WHERE prefix = 'nyc_csv/' AND contains(source_file, '2021')")
def _(s):
    listed = manifest.list_objects(s.spark, _landing(s, *NYC), prefix="nyc_csv/")
    return manifest.with_year_text(listed, 2021).select(_folder_file().alias("source_file")).distinct()


@query("s2_select_file", f"SELECT prefix, source_file FROM {_NAMES} WHERE source_file = 'london-legacy-2019Q4.csv'")
def _(s):
    return manifest.with_file_name(s.names(), "london-legacy-2019Q4.csv").select("prefix", "source_file")


@query("s3_archives_by_year", f"""
  SELECT source_file FROM (SELECT DISTINCT regexp_extract(source_file, '[0-9]+') || '-trips.zip' AS source_file
    FROM {_NAMES} WHERE prefix = 'nyc_csv/')
  WHERE CAST(left(source_file, 4) AS INT) BETWEEN 2020 AND 2023""")
def _(s):
    year = F.regexp_extract("source_file", r"\d+", 0)
    named = (s.names().filter("prefix = 'nyc_csv/'")
             .select(F.explode(F.array(F.concat(year, F.lit("-trips.zip")),
                                       F.concat(year, F.lit("-trips.txt")),
                                       F.concat(F.lit("old-"), year, F.lit(".zip")))).alias("source_file"))
             .distinct())
    return manifest.archives_between(named, 2020, 2023)


@query("s4_extracts_by_name", f"""
  SELECT DISTINCT '17 Journey Data Extract ' || regexp_extract(source_file, '[0-9]+') || '.CSV' AS source_file
  FROM {_NAMES} WHERE prefix = 'london_csv/' AND CAST(left(regexp_extract(source_file, '[0-9]+'), 4) AS INT) >= 2021""")
def _(s):
    year = F.regexp_extract("source_file", r"\d+", 0)
    named = (s.names().filter("prefix = 'london_csv/'")
             .select(F.explode(F.array(F.concat(F.lit("17 Journey Data Extract "), year, F.lit(".CSV")),
                                       F.concat(F.lit("station list "), year, F.lit(".csv")))).alias("source_file"))
             .distinct())
    return manifest.extracts_since(named, 2021)


@query("s5_cutoff_replay", f"SELECT prefix, source_file FROM {_NAMES} "
                           "WHERE prefix = 'nyc_csv/' AND source_file >= 'nyc-modern-2023Q1.csv'")
def _(s):
    return (manifest.from_cutoff(s.names().filter("prefix = 'nyc_csv/'"), "nyc-modern-2023Q1.csv")
            .select("prefix", "source_file"))


_MODERN_COLUMNS = ", ".join(c for c in specs.NYC_MODERN.columns if c != "source_file")


@query("s6_expand_archives", f"SELECT {_MODERN_COLUMNS} FROM raw_nyc_modern")
def _(s):
    packed = s.write_archives(scratch_path(s.spark, "archives-in"))
    root = scratch_path(s.spark, "landing")
    archives.expand_archives(s.spark, manifest.list_objects(s.spark, packed, suffix=".zip"), f"{root}/nyc_csv")
    warehouse = _warehouse(s)
    load.load_prefix(s.spark, warehouse, root, "nyc_csv/")
    return shipped(warehouse.raw(specs.NYC_MODERN).read(s.spark)).drop("source_file")


@query("s7_csv_scan", """
  SELECT 'nyc_legacy' AS layout, count(*) AS n, count(start_station_id) AS with_station FROM raw_nyc_legacy UNION ALL
  SELECT 'nyc_modern', count(*), count(start_station_id) FROM raw_nyc_modern UNION ALL
  SELECT 'london_legacy', count(*), count(start_station_id) FROM raw_london_legacy UNION ALL
  SELECT 'london_modern', count(*), count(start_station_number) FROM raw_london_modern""")
def _(s):
    def counted(batch):
        station = "start_station_number" if batch.spec.name == "london_modern" else "start_station_id"
        return (load.csv_scan.scan_aligned(s.spark, batch.spec, batch.scans)
                .agg(F.lit(batch.spec.name).alias("layout"), F.count("*").alias("n"), F.count(station).alias("with_station")))

    parts = functools.reduce(DataFrame.unionByName, [counted(b) for b in load.file_batches(_routed(s))])
    return parts.groupBy("layout").agg(F.sum("n").alias("n"), F.sum("with_station").alias("with_station"))


@query("s8_header_dispatch", """
  SELECT DISTINCT source_file, 'nyc_legacy' AS source FROM raw_nyc_legacy UNION ALL
  SELECT DISTINCT source_file, NULL FROM raw_nyc_legacy UNION ALL
  SELECT DISTINCT source_file, 'nyc_modern' FROM raw_nyc_modern UNION ALL
  SELECT DISTINCT source_file, 'london_legacy' FROM raw_london_legacy UNION ALL
  SELECT DISTINCT source_file, 'london_modern' FROM raw_london_modern""")
def _(s):
    return _routed(s).select(_folder_file().alias("source_file"), "source").distinct()


def _lacking(spec: specs.SourceSpec) -> tuple[str, ...]:
    """Two required columns that the sample leaves out of a layout's incomplete files."""
    return spec.required_headers[3], spec.required_headers[-1]


def _missing_rows() -> str:
    selects = []
    for spec in specs.registered():
        header = [f.header for f in spec.fields if f.header not in _lacking(spec)]
        for candidate in specs.for_prefix(spec.prefix):
            missing = ", ".join(f"('{h}')" for h in candidate.required_headers if h not in header)
            selects.append(f"SELECT source_file, '{candidate.name}' AS candidate, m AS missing_column "
                           f"FROM (SELECT DISTINCT source_file FROM raw_{spec.name}), (VALUES {missing}) v(m)")
    return " UNION ALL ".join(selects)


@query("s9_missing_columns", _missing_rows())
def _(s):
    root, reports_of = scratch_path(s.spark, "landing"), []
    for spec in specs.registered():
        (s.landing_text(spec.name, without=_lacking(spec)).write.option("header", True)
         .partitionBy("source_file").csv(f"{root}/{spec.prefix}{spec.name}"))
    for prefix in specs.prefixes():
        with_key = headers.with_headers(manifest.list_objects(s.spark, root, prefix=prefix))
        reports_of.append(headers.missing_report(with_key).join(with_key.select("path", "key"), "path")
                          .select(_folder_file().alias("source_file"), "candidate", "missing_column").distinct())
    return functools.reduce(DataFrame.unionByName, reports_of)


def _raw_roundtrip(source: str, **as_landed: str):
    """``as_landed`` says what a column is where some landed files lack it."""
    spec = specs.get(source)
    columns = ", ".join(f"{as_landed[n]} AS {n}" if n in as_landed else n for n in spec.columns if n != "source_file")

    @query(f"s11_align_{source}", f"SELECT {columns} FROM raw_{source}")
    def _(s):
        warehouse = _warehouse(s)
        load.load_prefix(s.spark, warehouse, _landing(s, source), spec.prefix)
        return shipped(warehouse.raw(spec).read(s.spark)).drop("source_file")


_raw_roundtrip("nyc_legacy")
_raw_roundtrip("nyc_modern")
_raw_roundtrip("london_legacy")
_raw_roundtrip("london_modern", total_duration_ms="CASE WHEN bike_model = 'CLASSIC' THEN total_duration_ms END")


def _broken_rows(source: str):
    """Every value of a layout whose station names hold line breaks and quotes, read by rows that quotes hold together."""
    spec = specs.get(source)
    name = next(f for f in spec.fields if f.name in ("start_station_name", "start_station"))
    broken = f"CASE WHEN length({name.name}) % 2 = 0 THEN {name.name} || chr(10) || '\"dock\", ' || {name.name} ELSE {name.name} END"
    columns = ", ".join(f"{broken} AS {n}" if n == name.name else n for n in spec.columns if n != "source_file")

    @query(f"s7_broken_rows_{source}", f"SELECT {columns} FROM raw_{source}")
    def _(s):
        root, text = scratch_path(s.spark, "landing"), s.landing_text(source)
        own = F.col(f"`{name.header}`")
        both = F.when(F.length(own) % 2 == 0, F.concat(own, F.lit('\n"dock", '), own)).otherwise(own)
        (text.withColumn(name.header, both).write.option("header", True).option("escape", '"')
         .partitionBy("source_file").csv(f"{root}/{spec.prefix}"))
        routed = load.route(s.spark, manifest.list_objects(s.spark, root, prefix=spec.prefix))
        scans = {tuple(r.header): r.paths for r in routed.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()}
        return shipped(csv_scan.good_rows(csv_scan.scan_aligned(s.spark, spec, scans, broken=True))).drop("source_file")


for _source in NYC + LONDON:
    _broken_rows(_source)


@query("s10_header_contracts", """
  SELECT 'nyc_legacy' AS source, source_file, 15 AS required_present FROM (SELECT DISTINCT source_file FROM raw_nyc_legacy)
  UNION ALL SELECT 'nyc_modern', source_file, 13 FROM (SELECT DISTINCT source_file FROM raw_nyc_modern)
  UNION ALL SELECT 'london_legacy', source_file, 9 FROM (SELECT DISTINCT source_file FROM raw_london_legacy)
  UNION ALL SELECT 'london_modern', source_file, 9 FROM (SELECT DISTINCT source_file FROM raw_london_modern)""")
def _(s):
    present = functools.reduce(lambda held, spec: held.when(
        F.col("source") == spec.name, F.size(F.array_intersect(F.array(*[F.lit(h) for h in spec.required_headers]), "header"))),
        specs.registered(), F)
    return (_routed(s).filter("source IS NOT NULL")
            .select("source", _folder_file().alias("source_file"), present.cast("bigint").alias("required_present"))
            .distinct())


@query("s12_lineage", "SELECT source_file, count(*) AS n FROM all_rides GROUP BY 1")
def _(s):
    warehouse, root = _warehouse(s), _landing(s)
    routed = [load.load_prefix(s.spark, warehouse, root, prefix) for prefix in specs.prefixes()]
    lineage = [warehouse.raw(spec).read(s.spark).select("source_file", "landed_id") for spec in specs.registered()]
    objects = (functools.reduce(DataFrame.unionByName, routed).filter("source IS NOT NULL")
               .select("source_file", "landed_id", _folder_file().alias("folder_file")))
    per_object = functools.reduce(DataFrame.unionByName, lineage).groupBy("source_file", "landed_id").count()
    return (per_object.join(objects, ["source_file", "landed_id"])
            .groupBy(F.col("folder_file").alias("source_file")).agg(F.sum("count").alias("n")))


@query("s13_s14_london_dates", """
  SELECT source_file, min(start_time) AS first_start, max(stop_time) AS last_stop FROM int_london_rides GROUP BY 1""")
def _(s):
    warehouse, root = _warehouse(s), _landing(s, *LONDON)
    routed = load.load_prefix(s.spark, warehouse, root, "london_csv/")
    dates = [warehouse.raw(spec).read(s.spark).select("start_date", "end_date", "landed_id")
             for spec in specs.for_prefix("london_csv/")]
    per_object = dates[0].unionByName(dates[1]).groupBy("landed_id").agg(
        F.min("start_date").alias("first"), F.max("end_date").alias("last"))
    return (per_object.join(routed.select("landed_id", _folder_file().alias("source_file")), "landed_id")
            .groupBy("source_file").agg(F.min("first").alias("first_start"), F.max("last").alias("last_stop")))


@query("s15_raw_append", """
  SELECT 'raw_nyc_legacy' AS target, count(*) AS n FROM raw_nyc_legacy UNION ALL
  SELECT 'raw_nyc_modern', count(*) FROM raw_nyc_modern UNION ALL
  SELECT 'raw_london_legacy', count(*) FROM raw_london_legacy UNION ALL
  SELECT 'raw_london_modern', count(*) FROM raw_london_modern""")
def _(s):
    warehouse, root = _warehouse(s), _landing(s)
    for _ in range(2):  # the second load replaces what the first one wrote
        load.load_all(s.spark, warehouse, root)
    counted = [warehouse.raw(spec).read(s.spark).agg(F.lit(spec.table).alias("target"), F.count("*").alias("n"))
               for spec in specs.registered()]
    return functools.reduce(DataFrame.unionByName, counted)


@query("e3_available_and_loaded", """
  SELECT source, count(DISTINCT source_file) AS files, sum(rows)::BIGINT AS rows, 0 AS waiting FROM (
    SELECT 'nyc_legacy' AS source, source_file, 1 AS rows FROM raw_nyc_legacy UNION ALL
    SELECT 'nyc_modern', source_file, 1 FROM raw_nyc_modern UNION ALL
    SELECT 'london_legacy', source_file, 1 FROM raw_london_legacy UNION ALL
    SELECT 'london_modern', source_file, 1 FROM raw_london_modern) GROUP BY 1""")
def _(s):
    warehouse, root = _warehouse(s), _landing(s)
    load.load_all(s.spark, warehouse, root)
    objects = functools.reduce(DataFrame.unionByName, [
        load.route(s.spark, manifest.list_objects(s.spark, root, prefix=prefix)) for prefix in specs.prefixes()])
    waiting = load.not_loaded(s.spark, warehouse, objects).filter("source IS NOT NULL").groupBy("source").count()
    held = load.entries(s.spark, warehouse).join(
        objects.select("source", "source_file", "landed_id", _folder_file().alias("folder_file")), ["source_file", "landed_id"])
    return (held.groupBy("source").agg(F.count_distinct("folder_file").alias("files"), F.sum("rows").alias("rows"))
            .join(waiting, "source", "left").withColumn("waiting", F.coalesce("count", F.lit(0)).cast("bigint")).drop("count"))


@query("e4_routing_table", f"""
  SELECT prefix, source_file, CASE WHEN starts_with(source_file, 'nyc-legacy') THEN 'nyc_legacy' WHEN starts_with(source_file, 'nyc')
    THEN 'nyc_modern' WHEN starts_with(source_file, 'london-legacy') THEN 'london_legacy' ELSE 'london_modern' END AS source
  FROM {_NAMES}""")
def _(s):
    return _routed(s).filter("source IS NOT NULL").select("prefix", _folder_file().alias("source_file"), "source").distinct()


@query("s16_raw_tables", """
  SELECT 'raw_nyc_legacy' AS table_name, 0 AS before_load, count(*) AS n FROM raw_nyc_legacy UNION ALL
  SELECT 'raw_nyc_modern', 0, count(*) FROM raw_nyc_modern UNION ALL
  SELECT 'raw_london_legacy', 0, count(*) FROM raw_london_legacy UNION ALL
  SELECT 'raw_london_modern', 0, count(*) FROM raw_london_modern""")
def _(s):
    warehouse = _warehouse(s)
    warehouse.create_raw_tables(s.spark)
    result = None
    for spec in specs.registered():
        table = warehouse.raw(spec)
        created = table.read(s.spark).count()
        rows = s.raw(spec.name).withColumns({
            "ingested_at": F.current_timestamp(), "landed_id": F.lit("sample")})
        table.append(rows)
        counted = table.read(s.spark).agg(
            F.lit(spec.table).alias("table_name"), F.lit(created).alias("before_load"), F.count("*").alias("n"))
        result = counted if result is None else result.unionByName(counted)
    return shipped(result)


@query("s17_dry_run", """
  SELECT 'raw_nyc_legacy' AS target, count(*) AS rows, 0 AS rejected FROM raw_nyc_legacy UNION ALL
  SELECT 'raw_nyc_modern', count(*), 0 FROM raw_nyc_modern UNION ALL
  SELECT 'raw_london_legacy', count(*), 0 FROM raw_london_legacy UNION ALL
  SELECT 'raw_london_modern', count(*), 0 FROM raw_london_modern""")
def _(s):
    root, warehouse = _landing(s), _warehouse(s)
    counts = functools.reduce(DataFrame.unionByName, [
        load.load_prefix(s.spark, warehouse, root, prefix, dry_run=True) for prefix in specs.prefixes()])
    return counts.groupBy("target").agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"))


@query("s18_load_all", """
  SELECT location, schema_version, count(*) AS n FROM all_rides GROUP BY 1, 2""")
def _(s):
    warehouse = _warehouse(s)
    load.load_all(s.spark, warehouse, _landing(s))
    counted = [refresh.staged(s.spark, warehouse, spec.name).groupBy("location", "schema_version")
               .agg(F.count("*").alias("n")) for spec in specs.registered()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("s19_load_one_year", """
  SELECT source_file, count(*) AS n FROM raw_nyc_modern WHERE contains(source_file, '2022') GROUP BY 1""")
def _(s):
    warehouse, root = _warehouse(s), _landing(s, "nyc_modern")
    routed = load.load_prefix(s.spark, warehouse, root, "nyc_csv/", load.Selection(year=2022))
    per_object = warehouse.raw(specs.NYC_MODERN).read(s.spark).groupBy("landed_id").count()
    return (per_object.join(routed.select("landed_id", _folder_file().alias("source_file")), "landed_id")
            .groupBy("source_file").agg(F.sum("count").alias("n")))


@query("s20_population_seed", """
  SELECT r.location, r.year, p.population FROM (
    SELECT DISTINCT location, CAST(extract(year FROM start_time) AS BIGINT) AS year FROM all_rides) r
  JOIN (SELECT location, year, CAST(population AS BIGINT) AS population FROM population) p USING (location, year)""")
def _(s):
    path = scratch_path(s.spark, "population")
    s.population().write.option("header", True).csv(path)
    seed = population.check_unique(population.read_population(s.spark, path))
    years = s.both_rides().select("location", c.year_of("start_time").alias("year")).distinct()
    return years.join(seed, ["location", "year"])


@query("s21_raw_table_scan", "SELECT ride_id, rideable_type, started_at FROM raw_nyc_modern "
                             "WHERE source_file = 'nyc-modern-2022Q1.csv'")
def _(s):
    warehouse = _warehouse(s)
    table = warehouse.raw(specs.NYC_MODERN)
    table.append(s.raw("nyc_modern").withColumns({
        "ingested_at": F.current_timestamp(), "landed_id": F.lit("sample")}))
    return (table.read(s.spark).filter("source_file = 'nyc-modern-2022Q1.csv'")
            .select("ride_id", "rideable_type", "started_at"))


@query("s22_full_refresh", "SELECT * FROM mart_nyc_hourly_patterns")
def _(s):
    mart = _warehouse(s).mart("mart_nyc_hourly_patterns")
    mart.rebuild(s.hourly("london"))
    mart.rebuild(s.hourly("nyc"))
    return mart.read(s.spark)


_STAGED = "SELECT location, schema_version, source_file, count(*) AS n, count(ride_id) AS keyed, min(start_time) AS first_start FROM {} GROUP BY 1, 2, 3"


@query("s23_staging_view", " UNION ALL ".join(_STAGED.format(f"stg_{source}") for source in NYC + LONDON))
def _(s):
    for source in NYC + LONDON:
        s.staging(source).createOrReplaceTempView(f"sample_stg_{source}")
    return s.spark.sql(" UNION ALL ".join(_STAGED.format(f"sample_stg_{source}") for source in NYC + LONDON))


@query("s24_incremental_append", f"SELECT {RIDE_COLUMNS_NYC} FROM int_nyc_rides")
def _(s):
    target = _warehouse(s).rides("int_nyc_rides")
    batch = _landed(s.nyc_rides())
    increments.append_unseen(s.spark, batch.filter("source_file < 'nyc-modern-2023Q1.csv'"), target)
    increments.append_unseen(s.spark, batch, target)
    return shipped(target.read(s.spark))


_REPLACED = f"""
  SELECT {RIDE_COLUMNS_LONDON} FROM int_london_rides WHERE source_file >= 'london-modern-2023Q1.csv'
  UNION ALL
  SELECT {RIDE_COLUMNS_LONDON} FROM int_london_rides WHERE source_file < 'london-modern-2023Q1.csv'
    AND ride_id NOT IN (SELECT ride_id FROM int_london_rides WHERE source_file >= 'london-modern-2023Q1.csv')"""


@query("s25_incremental_by_key", _REPLACED)
def _(s):
    target = _warehouse(s).rides("int_london_rides")
    batch = _landed(s.london_rides())
    first = batch.filter("source_file < 'london-modern-2023Q1.csv'")
    increments.replace_by_key(s.spark, first, target, ["ride_id"], on_duplicates="keep")
    increments.replace_by_key(s.spark, batch, target, ["ride_id"], on_duplicates="keep")
    return shipped(target.read(s.spark))


_REWRITTEN = "contains(source_file, 'Q3')"
_KEPT = "(start_station_id IS NULL OR length(start_station_id) % 2 = 1)"


def _objects(s: SampleRides, rides: DataFrame) -> DataFrame:
    """The landed objects of the rides as a table, as a listing has them: each increment looks at all of them."""
    path = scratch_path(s.spark, "objects")
    rides.select("source_file", "landed_id").distinct().write.parquet(path)
    return s.spark.read.parquet(path)


def _versions(objects: DataFrame, rewritten: str) -> DataFrame:
    return objects.withColumn("version", F.when(F.expr(_REWRITTEN), rewritten).otherwise("1"))


@query("s24_rewritten_objects", f"""
  SELECT {RIDE_COLUMNS_NYC} FROM int_nyc_rides WHERE NOT {_REWRITTEN} OR {_KEPT}""")
def _(s):
    """Both layouts of the city that appends: third quarters come again with fewer rides."""
    target, batch = _warehouse(s).rides("int_nyc_rides"), _landed(s.nyc_rides())
    objects = _objects(s, batch)
    increments.append_unseen(s.spark, batch, target, versions=_versions(objects, "1"))
    again = batch.filter(f"NOT {_REWRITTEN} OR {_KEPT}")
    for _ in range(2):
        increments.append_unseen(s.spark, again, target, versions=_versions(objects, "2"))
    return shipped(target.read(s.spark))


@query("s25_rewritten_objects", f"""
  SELECT {RIDE_COLUMNS_LONDON} FROM int_london_rides WHERE {_REWRITTEN} AND {_KEPT}
  UNION ALL
  SELECT {RIDE_COLUMNS_LONDON} FROM int_london_rides WHERE NOT {_REWRITTEN}
    AND ride_id NOT IN (SELECT ride_id FROM int_london_rides WHERE {_REWRITTEN} AND {_KEPT})""")
def _(s):
    """Both layouts of the keyed city: what comes again replaces its keys elsewhere, too."""
    target, batch = _warehouse(s).rides("int_london_rides"), _landed(s.london_rides())
    objects = _objects(s, batch)
    increments.replace_by_key(s.spark, batch, target, ["ride_id"], "keep", _versions(objects, "1"))
    again = batch.filter(f"NOT {_REWRITTEN} OR {_KEPT}")
    for _ in range(2):
        increments.replace_by_key(s.spark, again, target, ["ride_id"], "keep", _versions(objects, "2"))
    return shipped(target.read(s.spark))


@query("s26_mart_read", "SELECT location, date, metric_value FROM mart_daily_metrics_long "
                        "WHERE metric_name = 'total_rides' AND location = 'london'")
def _(s):
    mart = _warehouse(s).mart("mart_daily_metrics_long")
    mart.rebuild(s.long())
    return (mart.read(s.spark).filter("metric_name = 'total_rides' AND location = 'london'")
            .select("location", "date", "metric_value"))


#: Per layout: landed column, the kinds a value may read as, raw column, and whether no value reads as any of them.
_CHECKED = {
    "nyc_legacy": (("usertype", ("bigint", "double"), "usertype", True), ("birth year", ("bigint",), "birth_year", False),
                   ("stoptime", ("timestamp_ntz",), "stoptime", False), ("start station name", ("string",), "start_station_name", False)),
    "nyc_modern": (("rideable_type", ("timestamp_ntz",), "rideable_type", True), ("end_lng", ("double",), "end_lng", False),
                   ("ended_at", ("timestamp_ntz", "double"), "ended_at", False)),
    "london_legacy": (("StartStation Name", ("double",), "start_station_name", True), ("Rental Id", ("string",), "rental_id", False),
                      ("Duration", ("bigint",), "duration", False)),
    "london_modern": (("Bike model", ("bigint", "timestamp_ntz"), "bike_model", True), ("Start date", ("timestamp_ntz",), "start_date", False),
                      ("Total duration (ms)", ("bigint",), "total_duration_ms", False)),
}


@query("v1_value_checks", " UNION ALL ".join(
    f"SELECT source_file, '{landed}' AS column_name, count({raw}) AS present, count({raw if bad else 'NULL'}) AS invalid FROM raw_{source} GROUP BY 1"
    for source, checked in _CHECKED.items() for landed, _, raw, bad in checked))
def _(s):
    return functools.reduce(DataFrame.unionByName, [
        quality.invalid_counts(s.landing_text(source), {landed: kinds for landed, kinds, *_ in checked})
        for source, checked in _CHECKED.items()])


# == projections, filters, predicates ==========================================

@query("p5_composite_key", "SELECT ride_id, bike_id, start_time FROM stg_nyc_legacy")
def _(s):
    return s.staging("nyc_legacy").select("ride_id", "bike_id", "start_time")


@query("p6_duration", "SELECT start_time, stop_time, duration_seconds FROM all_rides")
def _(s):
    return shipped(s.both_rides().select("start_time", "stop_time", "duration_seconds"))


@query("p7_user_type", "SELECT user_type, count(*) AS n FROM stg_nyc_legacy GROUP BY 1")
def _(s):
    raw = s.raw("nyc_legacy").select(c.current_user_type("usertype").alias("user_type"))
    return raw.groupBy("user_type").agg(F.count("*").alias("n"))


@query("p8_lineage_literals", "SELECT location, schema_version, source_file, count(*) AS n FROM all_rides GROUP BY 1, 2, 3")
def _(s):
    return s.both_rides().groupBy("location", "schema_version", "source_file").agg(F.count("*").alias("n"))


@query("p9_null_padding", "SELECT schema_version, count(*) AS n, count(bike_id) AS with_bike FROM int_nyc_rides GROUP BY 1")
def _(s):
    return s.nyc_rides().groupBy("schema_version").agg(F.count("*").alias("n"), F.count("bike_id").alias("with_bike"))


@query("p10_absent_metrics", "SELECT location, count(*) AS n, count(member_rides) AS member_days, "
                             "count(casual_rides) AS casual_days FROM days_of_both GROUP BY 1")
def _(s):
    return (marts.combined_daily(s.daily("nyc"), s.daily("london")).groupBy("location")
            .agg(F.count("*").alias("n"), F.count("member_rides").alias("member_days"),
                 F.count("casual_rides").alias("casual_days")))


@query("p11_day_type", "SELECT location, CASE WHEN isodow(start_time) < 6 THEN 'weekday' ELSE 'weekend' END AS day_type, "
                       "count(*) AS n FROM all_rides GROUP BY 1, 2")
def _(s):
    return s.both_rides().groupBy("location", c.day_type("start_time").alias("day_type")).agg(F.count("*").alias("n"))


@query("p12_per_1000", "SELECT location, date, rides_per_1000 FROM days_of_both")
def _(s):
    return (marts.combined_daily(s.daily("nyc"), s.daily("london"))
            .select("location", "date", c.per_thousand("total_rides", "population").alias("rides_per_1000")))


@query("f1_unseen_files", "SELECT ride_id, source_file FROM int_nyc_rides WHERE source_file NOT IN "
                          "(SELECT DISTINCT source_file FROM int_nyc_rides WHERE start_time < TIMESTAMP '2021-06-10')")
def _(s):
    held = s.nyc_rides().filter("start_time < timestamp_ntz'2021-06-10 00:00:00'")
    return increments.unseen_rows(s.nyc_rides(), held).select("ride_id", "source_file")


@query("f2_equality", "SELECT date, metric_value FROM mart_daily_metrics_long "
                      "WHERE location = 'nyc' AND metric_name = 'member_rides'")
def _(s):
    return s.long().filter("location = 'nyc' AND metric_name = 'member_rides'").select("date", "metric_value")


@query("f3_date_clamp", "SELECT location, count(*) AS n FROM mart_daily_metrics_long WHERE date BETWEEN "
                        "TIMESTAMP '2019-01-01' AND TIMESTAMP '2024-12-31' GROUP BY 1")
def _(s):
    return s.long().filter(WIDE.clamped()).groupBy("location").agg(F.count("*").alias("n"))


@query("f4_in_list", "SELECT location, date, metric_name, metric_value FROM mart_daily_metrics_long "
                     "WHERE metric_name IN ('total_minutes_biked', 'total_rides')")
def _(s):
    return (s.long().filter(F.col("metric_name").isin(*reports.DURATION_METRICS))
            .select("location", "date", "metric_name", "metric_value"))


@query("f5_not_null", "SELECT metric_name, count(*) AS n, count(metric_value) AS known "
                      "FROM mart_daily_metrics_long GROUP BY 1")
def _(s):
    return s.long().groupBy("metric_name").agg(F.count("*").alias("n"), F.count("metric_value").alias("known"))


@query("f6_year_range", "SELECT location, year, station_count FROM mart_nyc_station_growth WHERE year BETWEEN 2019 AND 2024")
def _(s):
    return s.growth("nyc").filter(PERIOD.years()).select("location", "year", "station_count")


@query("f7_month_range", "SELECT month FROM mart_nyc_member_analysis "
                         "WHERE month BETWEEN TIMESTAMP '2019-03-15' AND TIMESTAMP '2024-10-10'")
def _(s):
    return s.members().filter(PERIOD.months()).select("month")


# == joins =====================================================================

@query("j1_population", "SELECT location, date, population FROM days_of_both")
def _(s):
    days = s.both_rides().groupBy("location", c.day_of("start_time").alias("date")).agg(F.count("*").alias("rides"))
    return (marts.with_population(days.withColumn("year", c.year_of("date")), s.population())
            .select("location", "date", "population"))


@query("j1b_population_by_year", """
  SELECT location, year, station_count, population FROM mart_nyc_station_growth UNION ALL
  SELECT location, year, station_count, population FROM mart_london_station_growth""")
def _(s):
    return (marts.with_population(marts.station_counts(s.both_rides()), s.population())
            .select("location", "year", "station_count", "population"))


@query("j2_anti_files", "SELECT source_file, count(*) AS n FROM int_london_rides WHERE source_file NOT IN "
                        "(SELECT source_file FROM int_london_rides WHERE start_time < TIMESTAMP '2022-02-02') GROUP BY 1")
def _(s):
    held = s.london_rides().filter("start_time < timestamp_ntz'2022-02-02 00:00:00'")
    return (increments.unseen_rows(s.london_rides(), held)
            .groupBy("source_file").agg(F.count("*").alias("n")))


@query("j3_keyed_replace", _REPLACED)
def _(s):
    batch = s.london_rides()
    return shipped(increments.replaced_by_key(
        batch.filter("source_file < 'london-modern-2023Q1.csv'"),
        batch.filter("source_file >= 'london-modern-2023Q1.csv'"), ["ride_id"]))


_LATEST = ("(SELECT max(year) FROM mart_nyc_station_growth WHERE year BETWEEN 2019 AND 2024)")
_PER_CAPITA = f"""
  SELECT coalesce(r.location, p.location) AS location, total_rides, population,
    nullif(total_rides, 0) / nullif(population, 0) * 1000 AS rides_per_1000
  FROM (SELECT location, sum(metric_value) AS total_rides FROM mart_daily_metrics_long
        WHERE metric_name = 'total_rides' AND {BETWEEN} GROUP BY 1) r
  FULL OUTER JOIN (SELECT location, max(metric_value) AS population FROM mart_daily_metrics_long
        WHERE metric_name = 'population' AND year = {_LATEST} GROUP BY 1) p ON r.location = p.location"""


@query("j4_combine_per_city", _PER_CAPITA)
def _(s):
    return reports.per_capita_by_city(s.long(), s.growth("nyc"), PERIOD)


# == aggregations and windows ==================================================

@query("a1_count", "SELECT location, CAST(date_trunc('day', start_time) AS TIMESTAMP) AS date, count(*) AS n FROM all_rides GROUP BY 1, 2")
def _(s):
    return s.both_rides().groupBy("location", c.day_of("start_time").alias("date")).agg(F.count("*").alias("n"))


@query("a2_average_minutes", "SELECT location, date, avg_duration_minutes FROM days_of_both")
def _(s):
    return marts.combined_daily(s.daily("nyc"), s.daily("london")).select("location", "date", "avg_duration_minutes")


@query("a3_total_minutes", "SELECT location, schema_version, CAST(sum(us) AS DOUBLE) / CAST(1000000 AS DOUBLE) / 60 AS minutes "
                           "FROM all_rides GROUP BY 1, 2")
def _(s):
    return (s.both_rides().groupBy("location", "schema_version")
            .agg((c.total_seconds("duration_seconds").cast("double") / 60).alias("minutes")))


@query("a4_case_count", """
  SELECT source_file, CAST(sum(CASE WHEN user_type = 'member' THEN 1 ELSE 0 END) AS BIGINT) AS member_rides,
    CAST(sum(CASE WHEN user_type = 'casual' THEN 1 ELSE 0 END) AS BIGINT) AS casual_rides FROM int_nyc_rides GROUP BY 1""")
def _(s):
    return s.nyc_rides().groupBy("source_file").agg(
        c.count_where(F.col("user_type") == "member").alias("member_rides"),
        c.count_where(F.col("user_type") == "casual").alias("casual_rides"))


@query("a5_filter_ratio", """
  SELECT schema_version, CAST(count(*) FILTER (WHERE user_type = 'member') AS DOUBLE) * CAST(100 AS DOUBLE)
    / CAST(count(*) AS DOUBLE) AS member_percentage FROM int_nyc_rides GROUP BY 1""")
def _(s):
    return s.nyc_rides().groupBy("schema_version").agg(
        c.percent_where(F.col("user_type") == "member").alias("member_percentage"))


@query("a6_count_distinct", "SELECT location, year, station_count FROM mart_nyc_station_growth UNION ALL "
                            "SELECT location, year, station_count FROM mart_london_station_growth")
def _(s):
    return marts.station_counts(s.both_rides())


_TRUE_AVERAGE = ("sum(metric_value) FILTER (WHERE metric_name = 'total_minutes_biked') / "
                 "nullif(sum(metric_value) FILTER (WHERE metric_name = 'total_rides'), 0)")
_CASE_AVERAGE = ("sum(CASE WHEN metric_name = 'total_minutes_biked' THEN metric_value ELSE 0 END) / "
                 "nullif(sum(CASE WHEN metric_name = 'total_rides' THEN metric_value ELSE 0 END), 0)")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order: compared to nine decimals."""
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("a7_filtered_ratio", f"SELECT location, year, round({_TRUE_AVERAGE}, 9) AS avg_duration "
                            "FROM mart_daily_metrics_long GROUP BY 1, 2")
def _(s):
    return _rounded(s.long().groupBy("location", "year").agg(reports._true_average().alias("avg_duration")),
                    "avg_duration")


@query("a8_case_ratio", f"SELECT location, metric_name, round({_CASE_AVERAGE}, 9) AS avg_duration "
                        "FROM mart_daily_metrics_long GROUP BY 1, 2")
def _(s):
    return _rounded(s.long().groupBy("location", "metric_name")
                    .agg(reports._average_or_zero().alias("avg_duration")), "avg_duration")


@query("a9_average_of_daily", f"""
  SELECT avg(daily_rides) AS avg_daily_rides FROM (SELECT date, sum(metric_value) AS daily_rides
    FROM mart_daily_metrics_long WHERE location = 'london' AND metric_name = 'total_rides' AND {BETWEEN} GROUP BY date)""")
def _(s):
    return reports.average_daily_rides(s.long(), "london", PERIOD)


@query("a10_global_max_min", "SELECT max(date) AS last_day, min(date) AS first_day, "
                             "max(date) FILTER (WHERE location = 'nowhere') AS no_day FROM mart_daily_metrics_long")
def _(s):
    return s.long().agg(F.max("date").alias("last_day"), F.min("date").alias("first_day"),
                        F.max(F.when(F.col("location") == "nowhere", F.col("date"))).alias("no_day"))


@query("a11_grouped_max", "SELECT location, max(metric_value) AS population FROM mart_daily_metrics_long "
                          "WHERE metric_name = 'population' GROUP BY 1")
def _(s):
    return (s.long().filter("metric_name = 'population'").groupBy("location")
            .agg(F.max("metric_value").alias("population")))


@query("a12_grouped_sum_avg", """
  SELECT location, year, metric_name, round(sum(metric_value), 6) AS total, round(avg(metric_value), 9) AS mean
  FROM mart_daily_metrics_long GROUP BY 1, 2, 3""")
def _(s):
    return s.long().groupBy("location", "year", "metric_name").agg(
        F.round(F.sum("metric_value"), 6).alias("total"), F.round(F.avg("metric_value"), 9).alias("mean"))


@query("a13_group_by_expressions", """
  SELECT location, CAST(extract(year FROM start_time) AS BIGINT) AS year,
    CAST(extract(month FROM start_time) AS BIGINT) AS month, count(*) AS n FROM all_rides GROUP BY 1, 2, 3""")
def _(s):
    return (s.both_rides().groupBy("location", c.year_of("start_time").alias("year"),
                                   c.month_number("start_time").alias("month")).agg(F.count("*").alias("n")))


@query("w1_previous_year", "SELECT location, year, station_count, prev_year_count FROM mart_nyc_station_growth UNION ALL "
                           "SELECT location, year, station_count, prev_year_count FROM mart_london_station_growth")
def _(s):
    return (marts.previous_year(marts.station_counts(s.both_rides()))
            .select("location", "year", "station_count", "prev_year_count"))


@query("w2_growth_percent", "SELECT location, year, yoy_growth FROM mart_nyc_station_growth UNION ALL "
                            "SELECT location, year, yoy_growth FROM mart_london_station_growth")
def _(s):
    return shipped(marts.station_growth(s.both_rides(), s.population()).select("location", "year", "yoy_growth"))


@query("o1_stored_mart", "SELECT * FROM mart_london_hourly_patterns ORDER BY hour_of_day")
def _(s):
    mart = _warehouse(s).mart("mart_london_hourly_patterns")
    mart.rebuild(s.hourly("london"))
    return mart.read(s.spark).orderBy("hour_of_day")


@query("u1_union_generations", "SELECT schema_version, ride_id, start_time FROM int_london_rides")
def _(s):
    return (rides.int_london_rides(s.staging("london_modern"), s.staging("london_legacy"))
            .select("schema_version", "ride_id", "start_time"))


@query("u2_union_cities", "SELECT date, location, year, day_type, total_rides, member_rides, casual_rides, population "
                          "FROM days_of_both")
def _(s):
    return (marts.combined_daily(s.daily("nyc"), s.daily("london"))
            .select("date", "location", "year", "day_type", "total_rides", "member_rides", "casual_rides", "population"))


@query("u3_unpivot", "SELECT date, location, metric_name, metric_value FROM mart_daily_metrics_long")
def _(s):
    return s.long().select("date", "location", "metric_name", "metric_value")


# == scalar functions ==========================================================

@query("x1_truncation", """
  SELECT ride_id, CAST(date_trunc('day', start_time) AS TIMESTAMP) AS day, CAST(date_trunc('month', start_time) AS TIMESTAMP) AS month,
    CAST(date_trunc('year', start_time) AS TIMESTAMP) AS year_start FROM all_rides""")
def _(s):
    return s.both_rides().select("ride_id", c.day_of("start_time").alias("day"), c.month_of("start_time").alias("month"),
                                 c.year_start_of("start_time").alias("year_start"))


@query("x2_x3_date_parts", """
  SELECT ride_id, CAST(extract(year FROM start_time) AS BIGINT) AS year, CAST(extract(month FROM start_time) AS BIGINT) AS month,
    CAST(extract(hour FROM start_time) AS BIGINT) AS hour, CAST(isodow(start_time) AS BIGINT) AS weekday FROM all_rides""")
def _(s):
    return s.both_rides().select("ride_id", c.year_of("start_time").alias("year"), c.month_number("start_time").alias("month"),
                                 c.hour_of("start_time").alias("hour"), c.iso_weekday("start_time").alias("weekday"))


@query("x5_x6_stamp_and_concat", "SELECT location || '/' || strftime(stop_time, '%Y%m%d%H%M%S') AS stamp FROM all_rides")
def _(s):
    return s.both_rides().select(F.concat("location", F.lit("/"), c.second_stamp("stop_time")).alias("stamp"))


@query("x7_x13_zero_safe_arithmetic", """
  SELECT ride_id, CAST(1000 AS DOUBLE) / nullif(CASE WHEN us < 0 THEN 0 ELSE duration_seconds END, 0) AS per_second FROM all_rides""")
def _(s):
    seconds = F.col("duration_seconds").cast("double")
    return s.both_rides().select("ride_id", c.ratio(F.lit(1000.0), F.when(seconds < 0, 0.0).otherwise(seconds)).alias("per_second"))


@query("x8_round", """
  SELECT ride_id, CAST(sign(us) * ((2 * abs(us) + 100000) // 200000) AS DOUBLE) / CAST(10 AS DOUBLE) AS tenths FROM all_rides""")
def _(s):
    return shipped(s.both_rides().select("ride_id", F.round("duration_seconds", 1).alias("tenths")))


@query("x10_casts", "SELECT bike_id, birth_year, gender, start_latitude, start_longitude FROM stg_nyc_legacy")
def _(s):
    return shipped(s.staging("nyc_legacy").select("bike_id", "birth_year", "gender", "start_latitude", "start_longitude"))


@query("x11_audit_time", "SELECT source_file, count(*) AS stamped FROM all_rides GROUP BY 1")
def _(s):
    return s.both_rides().groupBy("source_file").agg(F.count("dbt_updated_at").alias("stamped"))


@query("x12_name_patterns", f"""
  SELECT source_file, regexp_extract(source_file, '([0-9]{{4}})Q([0-9])', 1) AS year_text,
    regexp_matches(source_file, 'legacy') AS is_legacy FROM {_NAMES}""")
def _(s):
    return s.names().select("source_file", F.regexp_extract("source_file", r"(\d{4})Q(\d)", 1).alias("year_text"),
                            F.col("source_file").rlike("legacy").alias("is_legacy"))


# == streaming and registry ====================================================

@query("t1_once_per_file", " UNION ALL ".join(
    f"SELECT 'raw_{source}' AS table_name, count(*) AS n FROM raw_{source}" for source in NYC + LONDON))
def _(s):
    warehouse, root = _warehouse(s), _landing(s)
    checkpoint = scratch_path(s.spark, "stream")
    for _ in range(2):  # nothing new for the second run
        for number, prefix in enumerate(specs.prefixes()):
            stream_landing(s.spark, warehouse, root, prefix, f"{checkpoint}/{number}").awaitTermination()
    return functools.reduce(DataFrame.unionByName, [
        warehouse.raw(spec).read(s.spark).agg(F.lit(spec.table).alias("table_name"), F.count("*").alias("n"))
        for spec in specs.registered()])


@query("t1_rides_follow_loads", """
  SELECT location, schema_version, count(*) AS n FROM all_rides GROUP BY 1, 2""")
def _(s):
    """All four layouts loaded, then taken to rides by the stream of the ledger, twice."""
    warehouse, checkpoint = _warehouse(s), scratch_path(s.spark, "stream")
    load.load_all(s.spark, warehouse, _landing(s))
    for _ in range(2):
        stream_rides(s.spark, warehouse, checkpoint, on_duplicates="keep").awaitTermination()
    taken = [warehouse.rides(f"int_{city}_rides").read(s.spark).select("location", "schema_version") for city in ("nyc", "london")]
    return taken[0].unionByName(taken[1]).groupBy("location", "schema_version").agg(F.count("*").alias("n"))


@query("r1_new_source", "SELECT ride_id AS trip, started_at AS begun FROM raw_nyc_modern")
def _(s):
    spec = specs.SourceSpec(
        name="harbour_trips", prefix="harbour_csv/", table="raw_harbour_trips", location="harbour", generation="modern",
        fields=(specs.Field("Trip", "trip"), specs.Field("Begun", "begun", "timestamp_ntz")))
    root = scratch_path(s.spark, "landing")
    (s.raw("nyc_modern").select(F.col("started_at").cast("string").alias("Begun"), F.col("ride_id").alias("Trip"))
     .write.option("header", True).csv(f"{root}/harbour_csv"))
    specs.register(spec)
    try:
        warehouse = _warehouse(s)
        load.load_prefix(s.spark, warehouse, root, spec.prefix)
        return warehouse.raw(spec).read(s.spark).select("trip", "begun")
    finally:
        specs.unregister(spec.name)


# == named relations ===========================================================

_STG_COMMON = "start_station_name, start_station_id, end_station_name, end_station_id"
_US = "us / CAST(1000000 AS DOUBLE) AS duration_seconds"


@query("k1_stg_nyc_legacy", f"SELECT * EXCLUDE (us), {_US} FROM stg_nyc_legacy")
def _(s):
    return shipped(s.staging("nyc_legacy"))


@query("k2_stg_nyc_modern", f"SELECT * EXCLUDE (us), {_US} FROM stg_nyc_modern")
def _(s):
    return shipped(s.staging("nyc_modern"))


@query("k3_stg_london_legacy", f"SELECT * EXCLUDE (us), {_US} FROM stg_london_legacy")
def _(s):
    return shipped(s.staging("london_legacy"))


@query("k4_stg_london_modern", f"SELECT * EXCLUDE (us), {_US} FROM stg_london_modern")
def _(s):
    return shipped(s.staging("london_modern"))


@query("k5_int_nyc_rides", f"SELECT {RIDE_COLUMNS_NYC} FROM int_nyc_rides")
def _(s):
    return shipped(s.nyc_rides())


@query("k6_int_london_rides", f"SELECT {RIDE_COLUMNS_LONDON} FROM int_london_rides")
def _(s):
    return shipped(s.london_rides())


@query("k7_mart_nyc_daily_metrics", "SELECT * FROM mart_nyc_daily_metrics")
def _(s):
    return s.daily("nyc")


@query("k8_mart_london_daily_metrics", "SELECT * FROM mart_london_daily_metrics")
def _(s):
    return s.daily("london")


@query("k9_mart_nyc_hourly_patterns", "SELECT * FROM mart_nyc_hourly_patterns")
def _(s):
    return s.hourly("nyc")


@query("k10_mart_london_hourly_patterns", "SELECT * FROM mart_london_hourly_patterns")
def _(s):
    return s.hourly("london")


@query("k11_mart_nyc_member_analysis", "SELECT * FROM mart_nyc_member_analysis")
def _(s):
    return s.members()


@query("k12_mart_nyc_station_growth", "SELECT * FROM mart_nyc_station_growth")
def _(s):
    return shipped(s.growth("nyc"))


@query("k13_mart_london_station_growth", "SELECT * FROM mart_london_station_growth")
def _(s):
    return shipped(s.growth("london"))


@query("k14_mart_daily_metrics_long", "SELECT * FROM mart_daily_metrics_long")
def _(s):
    return s.long()


# == reports ===================================================================

_LONG = "mart_daily_metrics_long"


@query("d1_latest_date_capped", f"SELECT max(date) AS max_date FROM {_LONG} WHERE location = 'nyc' AND date <= TIMESTAMP '2024-12-31'")
def _(s):
    return reports.latest_date(s.long(), "nyc", cap=reports.LAST_DAY)


@query("d2_latest_date", f"SELECT max(date) AS max_date FROM {_LONG} WHERE location = 'london'")
def _(s):
    return reports.latest_date(s.long(), "london")


@query("d3_common_date_bounds", f"""
  SELECT (SELECT min(date) FROM {_LONG} WHERE date >= TIMESTAMP '2019-01-01' AND date <= m.max_date) AS min_date, m.max_date
  FROM (SELECT least((SELECT max(date) FROM {_LONG} WHERE location = 'nyc' AND date <= TIMESTAMP '2024-12-31'),
                     (SELECT max(date) FROM {_LONG} WHERE location = 'london')) AS max_date) m""")
def _(s):
    return reports.common_date_bounds(s.long(), "nyc", "london")


@query("d4_city_date_bounds", f"""
  SELECT 'nyc' AS location, min(date) FILTER (WHERE date >= TIMESTAMP '2019-01-01') AS min_date, max(date) AS max_date
  FROM {_LONG} WHERE location = 'nyc' AND date <= TIMESTAMP '2024-12-31' UNION ALL
  SELECT 'london', min(date) FILTER (WHERE date >= TIMESTAMP '2019-01-01'), max(date) FROM {_LONG} WHERE location = 'london'""")
def _(s):
    nyc = reports.date_bounds(s.long(), "nyc", cap=reports.LAST_DAY)
    london = reports.date_bounds(s.long(), "london")
    return (nyc.select(F.lit("nyc").alias("location"), "min_date", "max_date")
            .unionByName(london.select(F.lit("london").alias("location"), "min_date", "max_date")))


@query("d5_latest_growth_year", f"SELECT {_LATEST} AS latest_year")
def _(s):
    return reports.latest_growth_year(s.growth("nyc"), PERIOD)


@query("d6_population_in_latest_year", f"""
  SELECT location, max(metric_value) AS population FROM {_LONG}
  WHERE metric_name = 'population' AND year = {_LATEST} GROUP BY 1""")
def _(s):
    return reports.population_in_latest_year(s.long(), s.growth("nyc"), PERIOD)


@query("d7_rides_by_city", f"""
  SELECT location, sum(metric_value) AS total_rides FROM {_LONG}
  WHERE metric_name = 'total_rides' AND {BETWEEN} GROUP BY 1""")
def _(s):
    return reports.rides_by_city(s.long(), PERIOD)


@query("d8_per_capita_by_city", _PER_CAPITA)
def _(s):
    return reports.per_capita_by_city(s.long(), s.growth("nyc"), PERIOD)


@query("d9_average_duration_by_city", f"""
  SELECT location, round({_TRUE_AVERAGE}, 9) AS avg_ride_duration_minutes FROM {_LONG} WHERE {BETWEEN} GROUP BY 1""")
def _(s):
    return _rounded(reports.average_duration_by_city(s.long(), PERIOD), "avg_ride_duration_minutes")


@query("d10_total_rides", f"""
  SELECT sum(metric_value) AS total_rides FROM {_LONG}
  WHERE location = 'nyc' AND {BETWEEN} AND metric_name = 'total_rides'""")
def _(s):
    return reports.total_rides(s.long(), "nyc", PERIOD)


@query("d11_average_daily_rides", f"""
  SELECT avg(daily_rides) AS avg_daily_rides FROM (SELECT date, sum(metric_value) AS daily_rides FROM {_LONG}
    WHERE location = 'nyc' AND {BETWEEN} AND metric_name = 'total_rides' GROUP BY date)""")
def _(s):
    return reports.average_daily_rides(s.long(), "nyc", PERIOD)


@query("d12_average_duration", f"""
  SELECT round({_TRUE_AVERAGE}, 9) AS avg_ride_duration_minutes FROM {_LONG} WHERE location = 'nyc' AND {BETWEEN}""")
def _(s):
    return _rounded(reports.average_duration(s.long(), "nyc", PERIOD), "avg_ride_duration_minutes")


_MONTHLY = f"""
  SELECT CAST(extract(month FROM date) AS BIGINT) AS month, year, {{combine}} AS {{name}} FROM {_LONG}
  WHERE location = '{{city}}' AND {BETWEEN} AND metric_name IN ({{metrics}}) GROUP BY 1, 2 ORDER BY 1, 2"""


@query("d13_average_rides_by_month", _MONTHLY.format(
    combine="avg(metric_value)", name="metric_value", city="nyc", metrics="'total_rides'"))
def _(s):
    return reports.rides_by_month(s.long(), "nyc", PERIOD, "average")


@query("d14_total_rides_by_month", _MONTHLY.format(
    combine="sum(metric_value)", name="metric_value", city="london", metrics="'total_rides'"))
def _(s):
    return reports.rides_by_month(s.long(), "london", PERIOD, "total")


@query("d15_duration_by_month", _MONTHLY.format(
    combine=f"round({_CASE_AVERAGE}, 9)", name="avg_duration", city="nyc", metrics="'total_minutes_biked', 'total_rides'"))
def _(s):
    return _rounded(reports.duration_by_month(s.long(), "nyc", PERIOD), "avg_duration")


@query("d16_rides_by_hour", "SELECT hour_of_day, ride_count FROM mart_london_hourly_patterns ORDER BY hour_of_day")
def _(s):
    return reports.rides_by_hour(s.hourly("london"))


@query("d17_member_trend", """
  SELECT month, member_percentage FROM mart_nyc_member_analysis
  WHERE month BETWEEN TIMESTAMP '2019-03-15' AND TIMESTAMP '2024-10-10' ORDER BY month""")
def _(s):
    return reports.member_trend(s.members(), PERIOD)


@query("d18_stations_by_year", """
  SELECT year, station_count AS metric_value FROM mart_london_station_growth
  WHERE year BETWEEN 2019 AND 2024 ORDER BY year""")
def _(s):
    return reports.stations_by_year(s.growth("london"), PERIOD)


_BY_PERIOD = f"""
  SELECT CAST(date_trunc('{{unit}}', date) AS TIMESTAMP) AS period, location, {{value}} AS {{name}} FROM {_LONG}
  WHERE {BETWEEN} AND metric_name IN ({{metrics}}) GROUP BY 1, 2 ORDER BY 1, 2"""


@query("d19_rides_by_period", _BY_PERIOD.format(
    unit="month", value="sum(metric_value)", name="metric_value", metrics="'total_rides'"))
def _(s):
    return reports.metric_by_period(s.long(), "total_rides", PERIOD, "monthly")


@query("d19_rides_by_year", _BY_PERIOD.format(
    unit="year", value="sum(metric_value)", name="metric_value", metrics="'total_rides'"))
def _(s):
    return reports.metric_by_period(s.long(), "total_rides", PERIOD, "yearly")


@query("d20_per_capita_by_period", _BY_PERIOD.format(
    unit="year", value="round(sum(metric_value), 6)", name="metric_value", metrics="'rides_per_1000'"))
def _(s):
    return (reports.metric_by_period(s.long(), "rides_per_1000", PERIOD, "yearly")
            .withColumn("metric_value", F.round("metric_value", 6)))


@query("d21_duration_by_period", _BY_PERIOD.format(
    unit="month", value=f"round({_CASE_AVERAGE}, 9)", name="avg_duration", metrics="'total_minutes_biked', 'total_rides'"))
def _(s):
    return _rounded(reports.duration_by_period(s.long(), PERIOD, "monthly"), "avg_duration")


@query("d22_stations_by_city", """
  SELECT year, location, station_count FROM (
    SELECT year, location, station_count FROM mart_nyc_station_growth UNION ALL
    SELECT year, location, station_count FROM mart_london_station_growth)
  WHERE year BETWEEN 2019 AND 2024 ORDER BY year, location""")
def _(s):
    return reports.stations_by_city([s.growth("nyc"), s.growth("london")], PERIOD)
