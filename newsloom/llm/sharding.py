"""Shuffled shards by a two-pass external shuffle.

The first pass scatters the records by a seeded hash of their place in the input into buckets that fit in
memory. The second reads one bucket at a time, brings it into an order of its own, shuffles it with a seeded
Fisher-Yates shuffle and writes it. The buckets in sequence are one random order of all records, which is
cut into shards of equal counts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import broadcast_if_small, materialize

LAW = "rows"


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    seed: int = 20240131
    bucket_bytes: int = 24 << 20
    # bytes that a row takes besides its texts
    row_bytes: int = 64

    def __post_init__(self):
        if min(self.shards, self.bucket_bytes, self.row_bytes) < 1:
            raise ValueError("shards, bucket_bytes and row_bytes must be positive")


def fisher_yates(n: int, seed: str) -> list[int]:
    """A random order of ``range(n)``."""
    draw = random.Random(seed)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draw.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(rows: pa.Table, bucket: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A bucket in shuffled order, ``place`` counting from 0, in batches of a few MB."""
    order = fisher_yates(rows.num_rows, f"{seed}:{bucket}")
    step = max(1, rows.num_rows * (4 << 20) // max(rows.nbytes, 1))
    for i in range(0, rows.num_rows, step):
        part = rows.take(pa.array(order[i : i + step], pa.int64())).combine_chunks()
        n = part.num_rows
        columns = [pa.array([bucket] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), part.column("row").chunk(0)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "place", "row"])


def _text_bytes(docs: DataFrame, row_bytes: int) -> int:
    """Approximate bytes of the table: its strings and binaries, and a fixed share for every row."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = docs.agg(F.sum(sum(texts, F.lit(row_bytes)).cast("long")).alias("b")).first()["b"]
    return int(size or 0)


def shuffled_records(docs: DataFrame, settings: Settings = Settings(), stored: bool = False) -> DataFrame:
    """``position, row`` of every record: ``row`` has the columns of ``docs``, positions are a random order from 0.

    ``stored`` says that ``docs`` is a plain scan of a stored table, whose rows keep their places when a task is
    repeated; other frames are written first. The order depends on the seed and on how the input is split.
    """
    spark = docs.sparkSession
    docs = docs if stored else materialize(docs, "records")
    buckets = max(1, -(-_text_bytes(docs, settings.row_bytes) // settings.bucket_bytes))
    place = F.monotonically_increasing_id()
    scattered = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), place.alias("at")
    ).withColumn("bucket", F.pmod(F.xxhash64(F.lit(settings.seed), "at"), F.lit(buckets)).cast("int"))
    # fetched blocks arrive in any order: the place in the input makes a repeated task equal the first
    ordered = scattered.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "at").select("bucket", "row")
    row_type = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType()), T.StructField("row", row_type)])

    def run(batches):
        current, held = None, []
        for batch in batches:
            numbers = batch.column("bucket").to_pylist()
            start = 0
            while start < len(numbers):
                bucket, end = numbers[start], start + 1
                while end < len(numbers) and numbers[end] == bucket:
                    end += 1
                if held and bucket != current:
                    yield from _shuffled(pa.Table.from_batches(held), current, settings.seed)
                    held = []
                current = bucket
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from _shuffled(pa.Table.from_batches(held), current, settings.seed)

    written = materialize(ordered.mapInArrow(run, schema), "buckets")
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # a row per bucket: the table's size divided by a bucket's
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, _ = broadcast_if_small(counts.select("bucket", before.alias("start")))
    return written.join(starts, "bucket").select((F.col("start") + F.col("place")).alias("position"), "row")


def shard(docs: DataFrame, settings: Settings = Settings(), stored: bool = False) -> DataFrame:
    """The records with their ``shard`` and ``slot``; counts of shards differ by one at most, slots are gapless from 0.

    Columns of ``docs`` that are called ``shard`` or ``slot`` are replaced. NULLs, empty texts and repeated rows are
    records like any other, each with a place of its own; an empty table gives no rows. A record larger than a
    bucket's bytes makes its bucket as much larger.
    """
    records = shuffled_records(docs, settings, stored)
    n = docs.count()
    # the first rest shards hold one record more
    each, rest = divmod(n, settings.shards)
    position, long_part = F.col("position"), F.lit(rest * (each + 1))
    late, in_long = position - long_part, position < long_part
    slot = F.when(in_long, position % F.lit(each + 1)).otherwise(late % F.lit(max(each, 1)))
    number = F.when(in_long, (position - slot) / F.lit(each + 1)).otherwise(F.lit(rest) + (late - slot) / F.lit(max(each, 1)))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return records.select(*kept, number.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write ``shard=n`` folders whose files hold the records in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, settings: Settings = Settings(), stored: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every record of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(docs, settings, stored).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
