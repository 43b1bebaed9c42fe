"""Landing files to marts, twice, as batches and as a stream."""

import landing as files
from spokeworks.plans import load, marts, refresh
from spokeworks.plans.warehouse import Warehouse
from spokeworks.sources import specs
from spokeworks.sources.population import seed_population
from spokeworks.streaming.file_loads import stream_landing, stream_rides


def first_files(root):
    files.put(root, "nyc_csv/2019.csv", files.NYC_LEGACY,
              files.nyc_legacy("9", "2019-06-01 10:00:00", "2019-06-01 10:10:00"),
              files.nyc_legacy("9", "2019-06-01 10:00:00", "2019-06-01 10:10:00"))
    files.put(root, "nyc_csv/2021.csv", files.NYC_MODERN,
              files.nyc_modern("r1", "2021-02-01 10:00:00", "2021-02-01 10:05:00", user="casual"))
    files.put(root, "london_csv/old.csv", files.LONDON_LEGACY,
              files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 09:30"),
              files.london_legacy("2", "18/12/2019 09:00", "18/12/2019 09:10"))


def later_files(root):
    files.put(root, "nyc_csv/2022.csv", files.NYC_MODERN,
              files.nyc_modern("r1", "2022-02-01 10:00:00", "2022-02-01 10:05:00"))
    files.put(root, "london_csv/new.csv", files.LONDON_MODERN,
              files.london_modern("2", "2023-03-06 09:00", "2023-03-06 09:40"),
              files.london_modern("3", "2023-03-06 09:00", "2023-03-06 09:40"))


def check(spark, warehouse):
    nyc = warehouse.rides("int_nyc_rides").read(spark)
    assert (nyc.count(), nyc.filter("ride_id = 'r1'").count()) == (4, 2)
    london = {r.ride_id: r for r in warehouse.rides("int_london_rides").read(spark).collect()}
    assert sorted(london) == ["1", "2", "3"] and london["2"].schema_version == "modern"
    daily = {str(r.date)[:10]: r for r in warehouse.mart("mart_nyc_daily_metrics").read(spark).collect()}
    assert (daily["2019-06-01"].member_rides, daily["2019-06-01"].total_minutes_biked) == (2, 20.0)
    growth = [r.station_count for r in warehouse.mart("mart_london_station_growth").read(spark).orderBy("year").collect()]
    assert growth == [1, 1]
    for city, members in (("nyc", True), ("london", False)):  # kept per file, the marts equal a full rebuild
        taken, population = warehouse.rides(f"int_{city}_rides").read(spark), seed_population(spark)
        for name, whole in ((f"mart_{city}_daily_metrics", marts.daily_metrics(taken, population, members)),
                            (f"mart_{city}_hourly_patterns", marts.hourly_patterns(taken)),
                            (f"mart_{city}_station_growth", marts.station_growth(taken, population))):
            kept = warehouse.mart(name).read(spark)
            assert sorted(map(str, kept.collect())) == sorted(map(str, whole.select(*kept.columns).collect()))
    long = warehouse.mart("mart_daily_metrics_long").read(spark)
    assert long.filter("location = 'london' AND metric_name = 'member_rides'").count() == 0
    assert long.filter("metric_name = 'total_rides'").agg({"metric_value": "sum"}).first()[0] == 7.0


def run_twice(spark, root, warehouse, fetch, **options):
    first_files(root)
    fetch()
    refresh.refresh(spark, warehouse, seed_population(spark), **options)
    later_files(root)
    fetch()
    refresh.refresh(spark, warehouse, seed_population(spark), **options)
    check(spark, warehouse)


def test_batch_with_staging_views(spark, tmp_path):
    warehouse = Warehouse(str(tmp_path / "tables"))
    run_twice(spark, tmp_path / "landing", warehouse,
              lambda: load.load_all(spark, warehouse, str(tmp_path / "landing"), only_new=True))
    refresh.refresh_rides(spark, warehouse)  # nothing new
    check(spark, warehouse)
    refresh.register_views(spark, warehouse)
    assert spark.sql("SELECT count(*) FROM stg_nyc_modern JOIN mart_nyc_hourly_patterns ON true").first()[0] > 0


def test_batch_with_stored_staging(spark, tmp_path):
    warehouse = Warehouse(str(tmp_path / "tables"))
    run_twice(spark, tmp_path / "landing", warehouse,
              lambda: load.load_all(spark, warehouse, str(tmp_path / "landing")),
              stored_staging=True, on_duplicates="keep")
    assert warehouse.staging("stg_nyc_legacy").read(spark).count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    warehouse = Warehouse(str(tmp_path / "tables"))

    def fetch():
        for prefix in specs.prefixes():
            stream_landing(spark, warehouse, str(tmp_path / "landing"), prefix,
                           str(tmp_path / "checkpoints" / prefix), files_per_trigger=2).awaitTermination()

    run_twice(spark, tmp_path / "landing", warehouse, fetch)
    progress = stream_landing(spark, warehouse, str(tmp_path / "landing"), "nyc_csv/", str(tmp_path / "checkpoints" / "nyc_csv/"))
    progress.awaitTermination()
    assert sum(p["numInputRows"] for p in progress.recentProgress) == 0


def rewritten_files(root):
    """Other contents of objects that were loaded: a ride less, a ride more, a ride with another end, none."""
    files.put(root, "nyc_csv/2019.csv", files.NYC_LEGACY, files.nyc_legacy("9", "2019-06-01 10:00:00", "2019-06-01 10:10:00"))
    files.put(root, "nyc_csv/2021.csv", files.NYC_MODERN,
              files.nyc_modern("r1", "2021-02-01 10:00:00", "2021-02-01 10:05:00", user="casual"),
              files.nyc_modern("r9", "2021-02-02 10:00:00", "2021-02-02 10:05:00", user="casual"))
    files.put(root, "nyc_csv/2022.csv", files.NYC_MODERN)
    files.put(root, "london_csv/old.csv", files.LONDON_LEGACY, files.london_legacy("1", "18/12/2019 09:00", "18/12/2019 10:30"))


def test_rewritten_objects_replace_their_rides_in_both_forms(spark, tmp_path):
    for form in ("batch", "stream"):
        root, warehouse = tmp_path / f"landing-{form}", Warehouse(str(tmp_path / form))

        def follow():
            if form == "stream":
                stream_rides(spark, warehouse, str(tmp_path / "checkpoints")).awaitTermination()  # noqa: B023
            else:
                refresh.refresh_rides(spark, warehouse)  # noqa: B023
            refresh.refresh_marts(spark, warehouse, seed_population(spark))  # noqa: B023

        for more in (first_files, later_files):
            more(root)
            load.load_all(spark, warehouse, str(root), only_new=True)
            follow()
        check(spark, warehouse)
        rewritten_files(root)
        load.load_all(spark, warehouse, str(root), only_new=True)
        for _ in range(2):
            follow()
            nyc = warehouse.rides("int_nyc_rides").read(spark)
            assert sorted((r.source_file, r.ride_id[:2]) for r in nyc.collect()) == [("2019.csv", "le"), ("2021.csv", "r1"), ("2021.csv", "r9")]
            london = {r.ride_id: float(r.duration_seconds) for r in warehouse.rides("int_london_rides").read(spark).collect()}
            assert london == {"1": 5400.0, "2": 2400.0, "3": 2400.0}
            for city, members in (("nyc", True), ("london", False)):
                taken, kept = warehouse.rides(f"int_{city}_rides").read(spark), warehouse.mart(f"mart_{city}_daily_metrics").read(spark)
                whole = marts.daily_metrics(taken, seed_population(spark), members).select(*kept.columns)
                assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))
