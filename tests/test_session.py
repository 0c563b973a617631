import pandas as pd
from pyspark.sql import functions as F

from conftest import values
from newsloom import session

SCHEMA = "a string, b array<float>, c array<string>, d struct<x:int,y:string>, e array<struct<z:int>>"


def test_measure_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([("é" * 10, [1.0] * 100, ["xx", None], (1, "abc"), [(1,)]), (None,) * 5], SCHEMA)
    rows, size = session.measure(df)
    assert rows == 2
    assert 20 + 800 + 18 + 19 < size < 1000
    assert session.measure(df.limit(0)) == (0, 0)


def test_broadcast_only_within_both_bounds(spark):
    df = spark.range(100).select("id", F.lit("x" * 100).alias("text"))
    assert session.broadcast_if_small(df)[1]
    assert not session.broadcast_if_small(df, max_rows=99)[1]
    assert not session.broadcast_if_small(df, max_bytes=5_000)[1]
    big, _ = session.broadcast_if_small(df, max_rows=99)
    assert big is df


def test_scratch_goes_to_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert session.shared_dir(spark) == configured.rstrip("/")
    stored = session.materialize(spark.range(10), "test")
    assert values(stored.agg(F.sum("id"))) == [(45,)]
    assert all(configured.removeprefix("file:") in f for f in stored.inputFiles())


def test_arrow_batches_are_bounded_in_bytes(spark):
    @F.pandas_udf("long")
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    long = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    assert long.select(batch_bytes("t").alias("n")).agg(F.max("n")).first()[0] <= 5_000_000  # of 40 million


def test_spread_uses_all_cores_for_one_row_group(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    df = spark.range(10_000).selectExpr("id", "IF(id % 5 = 0, NULL, concat('t', id)) AS text")
    df.repartition(1).write.parquet(one)
    df.repartition(64).write.parquet(many)

    def busy(frame):
        return frame.select(F.spark_partition_id().alias("p")).distinct().count()

    with_aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a megabyte a task here
    try:
        got = session.spread(spark.read.parquet(one))
        assert busy(spark.read.parquet(one)) == 1 and busy(got) == 8
        assert sorted(values(got), key=lambda r: r[0]) == sorted(values(df), key=lambda r: r[0])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_aqe)
    stored = spark.read.parquet(many)
    assert session.spread(stored) is stored
