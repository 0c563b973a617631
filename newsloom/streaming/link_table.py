"""The article table of the stream: bucketed by link, so that a batch reads only the buckets it touches.

``rows/link_bucket=n`` holds the articles, ``refreshed/link_bucket=n`` later titles and summaries of known
links, which a reader lays over the rows. Ids are reserved by small files named after the first id
of a range, so neither a scan for the highest id nor a lock is needed, and a batch that is run again
cannot give an id twice.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.entries import split_by_publication
from newsloom.operators.merges import absent_by_link, number_from, one_per_link
from newsloom.schema import ARTICLE, conform
from newsloom.session import broadcast_if_small, instant, materialize
from newsloom.sources.tables import append_rows, create_exclusively, file_system, names_in, read_small

BUCKET = "link_bucket"
BUCKETS = 64
REFRESH = "link string, title string, summary string, refreshed_at timestamp"


def _layout(spark: SparkSession, table: str, buckets: int) -> int:
    """Number of buckets of the table, fixed when it is first written."""
    path = f"{table}/_layout.json"
    create_exclusively(spark, path, json.dumps({"buckets": buckets}))
    return json.loads(read_small(spark, path))["buckets"]


def bucket_of(link: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(link), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    fs, path = file_system(spark, folder)
    return spark.read.schema(full).parquet(folder) if fs.exists(path) else spark.createDataFrame([], full)


def stored_rows(spark: SparkSession, table: str, buckets: list[int] | None = None) -> DataFrame:
    """Articles as they were inserted, of the given buckets alone."""
    rows = _stored(spark, f"{table}/rows", ARTICLE)
    return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """Articles with the last refreshed title and summary of each link."""
    refreshed = _stored(spark, f"{table}/refreshed", T.StructType.fromDDL(REFRESH))
    last = refreshed.groupBy("link").agg(F.max_by(F.struct("title", "summary"), F.struct("refreshed_at", "title", "summary")).alias("_new"))
    last, _ = broadcast_if_small(last)
    hit = F.col("_new").isNotNull()
    shown = {n: F.when(hit, F.col("_new")[n]).otherwise(F.col(n)) for n in ("title", "summary")}
    return stored_rows(spark, table).join(last, "link", "left").withColumns(shown).select(*ARTICLE.fieldNames())


def reserve_ids(spark: SparkSession, table: str, count: int) -> int:
    """First of ``count`` ids that nobody else gets."""
    while True:
        taken = [n for n in names_in(spark, f"{table}/ids") if n.endswith(".json") and n[0].isdigit()]
        last = json.loads(read_small(spark, f"{table}/ids/{max(taken)}"))["last_id"] if taken else 0
        if create_exclusively(spark, f"{table}/ids/{last + 1:020d}.json", json.dumps({"last_id": last + count})):
            return last + 1


def merge_entries(spark: SparkSession, table: str, collected: DataFrame, as_of: datetime, updating: str | None = None, buckets: int = BUCKETS) -> None:
    """Add the links the table does not have; those of publication ``updating`` refresh the known ones.

    A batch that is run again finds its links in the table and adds nothing; refreshing twice changes nothing.
    """
    buckets = _layout(spark, table, buckets)
    entries = materialize(collected.withColumn(BUCKET, bucket_of(F.col("link"), buckets)), "batch-entries")
    # no more rows than there are buckets
    touched = sorted(r[0] for r in entries.select(BUCKET).distinct().collect())
    if not touched:
        return
    known = stored_rows(spark, table, touched).select("link")
    if updating is not None:
        again, _ = split_by_publication(entries, updating)
        links, _ = broadcast_if_small(one_per_link(again).select("link", "title", "summary", BUCKET))
        hits = known.join(links, "link")
        refreshed = materialize(hits.select("link", "title", "summary", instant(as_of).alias("refreshed_at"), BUCKET), "refreshed")
        if not refreshed.isEmpty():
            append_rows(refreshed.repartition(BUCKET), f"{table}/refreshed", [BUCKET])
    new = materialize(absent_by_link(known, entries).withColumn("_at", F.monotonically_increasing_id()), "new-articles")
    count = new.count()
    if count:
        first = reserve_ids(spark, table, count)
        rows = number_from(new, first - 1).withColumn("created_at", instant(as_of))
        rows = conform(rows, T.StructType([*ARTICLE.fields, T.StructField(BUCKET, T.IntegerType())]))
        append_rows(rows.repartition(BUCKET), f"{table}/rows", [BUCKET])
