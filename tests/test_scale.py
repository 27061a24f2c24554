"""Plans and layouts that must hold on tables of any size."""

import pytest
from pyspark.sql import functions as F

from meterstream.operators import grid, joins, metrics, prep, split, windows
from meterstream.plans import registry, views
from meterstream.sources import tables

SF = "/root/testdata/sf0.001"


def made_up(spark):
    """Rows whose number Spark can't guess."""
    rows = spark.range(3).select(F.col("id").alias("meter_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    return rows.select("meter_id", F.timestamp_seconds(1_700_000_000 + F.col("k") * 3600).alias("ts"), (F.col("k") % 7).cast("double").alias("diff"), F.col("k").cast("double").alias("reading"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def starts_of(rows):
    return rows.select("meter_id").distinct().withColumn("start", F.lit("2023-11-15").cast("timestamp"))


SHUFFLED = {
    "segments": lambda r: split.segments(r, starts_of(r), train_days=1, second_days=1, predict_days=0),
    "window_rows": lambda r: split.window_rows(r, starts_of(r), weeks=1),
    "month_segments": split.month_segments,
    "autocorrelation_facts": lambda r: metrics.autocorrelation_facts(r, grid.periods(r), seconds=36000),
    "with_facts": lambda r: prep.with_facts(r, grid.periods(r), "period"),
    "unmatched": lambda r: grid.unmatched(r, grid.fill_gaps(r)),
    "fill_report": lambda r: grid.fill_report(r, grid.fill_gaps(r)),
    "batch_totals": lambda r: metrics.batch_totals(grid.fill_report(r, grid.fill_gaps(r)), None),
    "off_period": grid.off_period,
    "hourly": grid.hourly,
    "at_frequency": grid.at_frequency,
    "stable": windows.stable,
    "removed": lambda r: joins.removed(r, r.where("diff = 1")),
    "day_coverage": joins.day_coverage,
}


@pytest.mark.parametrize("name", SHUFFLED)
def test_made_up_rows_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(SHUFFLED[name](made_up(spark)))


def test_gap_fill_makes_no_frame_for_each_meter(spark):
    """Columns in, columns out, with the rows of the frame's version: null and repeated times, names for ids, null readings."""
    times = [None, 0, 3600, 3600, 7200, 18000, 21650, 25200, 25200 + 1200, 28800]
    rows = [(m, t, None if t == 7200 else float(k)) for m in ("a", None) for k, t in enumerate(times)] + [("b", 0, 1.0), ("c", None, 2.0)]
    given = spark.createDataFrame(rows, "meter_id string, t long, reading double").select("meter_id", F.timestamp_seconds("t").alias("ts"), "reading")
    found = grid.fill_gaps(given)
    assert "InArrow" in plan(found) and "InPandas" not in plan(found)
    frame = grid.marked(given.where("meter_id = 'a'")).toPandas().drop_duplicates("ts", keep="first")
    want = [(t.timestamp(), None if r != r else r, s) for t, r, s in zip(grid.filled_frame(frame)["ts"].dt.tz_localize("UTC"), *(grid.filled_frame(frame)[c] for c in ("reading", "synthetic")))]
    got = found.select("meter_id", F.unix_timestamp("ts").alias("t"), "reading", "synthetic").collect()
    for m in ("a", None):
        assert sorted(((r["t"], r["synthetic"]) for r in got if r["meter_id"] == m)) == [(t, s) for t, _, s in want] and len(want) == 8
    assert {r["meter_id"] for r in got} == {"a", None}


def test_tasks_grow_with_the_rows_made_up(spark, monkeypatch):
    """Tasks of rows that pack well would otherwise hold all that comes."""
    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    meters = views.table(spark, SF, "supplier").count()
    rows = views.patterned_meters(spark, SF)
    tasks = meters * 240 // 100
    assert tasks > 4 and rows.rdd.getNumPartitions() == tasks and rows.count() == meters * 240
    for made in (views.gappy_meters(spark, SF), grid.fill_gaps(views.gappy_meters(spark, SF)), grid.gap_filled(rows.where("k % 24 < 5 AND reading IS NOT NULL"), 3600.0)):
        assert made.rdd.getNumPartitions() >= tasks


def files_of(folder) -> list:
    return [p for p in folder.rglob("part-*") if not p.name.startswith(".")]


def test_shards_are_files_of_many_meters(spark, tmp_path):
    """As many files as the rows ask for, whatever the number of meters, and each meter's year in one."""
    rows = made_up(spark).select((F.col("meter_id") * 100 + F.col("diff")).alias("meter_id"), "ts", "reading")
    later = rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 YEAR"))
    assert split.shards(rows.unionByName(later), str(tmp_path / "shards"), rows_a_file=200) == 600
    assert 2 <= len(files_of(tmp_path / "shards")) <= 6
    back = spark.read.parquet(str(tmp_path / "shards"))
    each = back.withColumn("file", F.input_file_name()).groupBy("meter_id", "year").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    assert len(each) == 42 and {r["files"] for r in each} == {1} and sum(r["n"] for r in each) == 600
    tables.write_segments(rows.withColumn("start", F.col("ts")), starts_of(rows), str(tmp_path / "segments"))
    assert len(files_of(tmp_path / "segments" / "segments")) <= 4
    tables.write_predictions(rows, starts_of(rows), str(tmp_path / "predictions"))
    assert len(files_of(tmp_path / "predictions" / "predictions")) <= 4


def test_segments_in_files_of_many_meters_or_in_folders(spark, tmp_path, monkeypatch):
    paths = []
    monkeypatch.setattr(registry, "shared_path", lambda spark, name: paths.append(tmp_path / name) or str(tmp_path / name))
    found = registry.QUERIES["src_segments"](spark, SF)
    meters = views.table(spark, SF, "supplier").count()
    assert found.count() == meters * 48 and len(files_of(paths[0])) <= 4 < meters
    text = spark.createDataFrame([(7, "2024-10-27 02:30:00", "1"), (7, "2024-10-27 02:30:00", "2"), (8, None, "3"), (8, "2024-06-01 00:00:00", "4")], "meter_id long, timestamp string, hodnota string").coalesce(1)
    text.write.option("header", True).csv(str(tmp_path / "rows"))
    text.write.partitionBy("meter_id").option("header", True).csv(str(tmp_path / "folders"))
    both = [sorted(map(tuple, tables.read_segment(spark, str(tmp_path / name)).collect())) for name in ("rows", "folders")]
    assert both[0] == both[1] and [r[::2] for r in both[0]] == [(7, 1.0), (7, 2.0), (8, 4.0)]
