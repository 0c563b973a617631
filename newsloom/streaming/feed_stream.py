"""Incremental ingest of landed feed documents."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.entries import collect_entries, normalize_entries
from newsloom.session import materialize
from newsloom.sources.feeds import attach_feeds, feed_records, split_damaged, stream_feed_documents, with_dates
from newsloom.sources.tables import append_rows
from newsloom.streaming.link_table import BUCKETS, merge_entries


def _batch_time(batch: DataFrame) -> datetime | None:
    """Time of the micro-batch as the stream recorded it: the same when the batch is run again."""
    micros = batch.agg(F.max(F.unix_micros("read_at"))).first()[0]
    return None if micros is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def ingest_batch(
    batch: DataFrame,
    feeds: DataFrame,
    table: str,
    as_of: datetime | None = None,
    updating_publication: str | None = None,
    rejects: str | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Parse and clean one micro-batch of documents and bring it into the table.

    ``as_of`` replaces the time of the batch. Records that are no entry are appended to ``rejects``.
    """
    spark = batch.sparkSession
    now = as_of or _batch_time(batch.select("read_at"))
    if now is None:
        return
    records = materialize(attach_feeds(feed_records(batch), feeds), "batch-records")
    entries, damaged = split_damaged(records)
    if rejects is not None:
        append_rows(damaged.select("feed_key", "entry_ord.file", "entry_ord.place", "damage", "record"), rejects)
    collected = collect_entries(normalize_entries(with_dates(entries), now, only_fresh=True))
    merge_entries(spark, table, collected, now, updating_publication, buckets)


def start_ingest(
    spark: SparkSession,
    root: str,
    feeds: DataFrame,
    table: str,
    checkpoint: str,
    as_of: datetime | None = None,
    updating_publication: str | None = None,
    rejects: str | None = None,
    buckets: int = BUCKETS,
    **reading,
) -> StreamingQuery:
    """Start a run over everything that has landed since the last one.

    ``reading`` goes to :func:`newsloom.sources.feeds.stream_feed_documents`; the table is read with
    :func:`newsloom.streaming.link_table.read_table`.
    """
    documents = stream_feed_documents(spark, root, **reading).withColumn("read_at", F.current_timestamp())
    return (
        documents.writeStream.foreachBatch(
            lambda batch, _id: ingest_batch(batch, feeds, table, as_of, updating_publication, rejects, buckets)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
