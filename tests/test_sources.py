"""Readers and writers round trip."""

import pytest
from pyspark.sql import functions as F

from meterstream.operators import split
from meterstream.sources import tables


def test_delivery(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("id;timestamp;hodnota\n1;2024-01-01 10:00:00;5.5\n2;2024-01-02;nan\n")
    (tmp_path / "a" / "_y.csv").write_text("id;timestamp;hodnota\n9;2024-01-01;1\n")
    got = tables.read_delivery(spark, str(tmp_path)).orderBy("meter_id").collect()
    assert [(r["meter_id"], r["ts_local"].hour, r["reading"]) for r in got] == [(1, 10, 5.5), (2, 0, None)]
    (tmp_path / "bad.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError):
        tables.read_delivery(spark, str(tmp_path / "bad.csv"))


def test_series_take_the_meter_from_the_name(spark, tmp_path):
    (tmp_path / "77.csv").write_text("timestamp_utc,hodnota\n2024-01-01 00:00:00,1.5\n")
    row = tables.read_series(spark, str(tmp_path)).first()
    assert row["meter_id"] == 77 and row["reading"] == 1.5


def test_shards_and_metadata(spark, tmp_path):
    rows = tables.synthetic_series(spark, 2, days=3)
    assert split.shards(rows, str(tmp_path / "shards")) == 2 * 3 * 48
    assert rows.where("diff < 0").count() == 0 and rows.agg(F.min("reading")).first()[0] >= 1000
    facts = spark.createDataFrame([(1, 5.0, None), (2, 6.0, "a")], "meter_id long, x double, note string")
    more = spark.createDataFrame([(1, "b", 7)], "meter_id long, note string, extra int")
    tables.write_metadata(facts, str(tmp_path / "facts"))
    assert tables.read_key(spark, str(tmp_path / "facts"), "x").count() == 2
    assert {(r["meter_id"], r["x"], r["note"], r["extra"]) for r in tables.augmented(facts, more).collect()} == {(1, 5.0, "b", 7), (2, 6.0, "a", None)}
    tables.write_models(facts, str(tmp_path / "models"))
    assert tables.read_models(spark, str(tmp_path / "models")).count() == 2
