"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word separators: space and the ASCII controls from tab to carriage return.
SEPARATORS = "[ \\t-\\r]+"
WORD = rb"[^ \t-\r]+"
# Bytes of the Arrow batches that go to Python; Spark's own bound is rows and 64 MB.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; -1 for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` on batches of bounded bytes, one row at least."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def map_texts(
    docs: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    *extra: Column,
    bounded: bool = False,
) -> DataFrame:
    """Apply an Arrow batch function to ``doc_id`` and ``text``, and ``extra`` columns, alone.

    ``bounded`` keeps batches small, for functions that need many times the memory of their input.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *extra)
    return map_batches(texts, function, schema) if bounded else texts.mapInArrow(function, schema)


def pieces_of(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``limit`` bytes of text (one row at least)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """Texts of a batch, NULL as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 bytes of the texts of a batch, NULL as empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
