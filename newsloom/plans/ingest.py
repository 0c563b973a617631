"""Read entries, clean them and bring them into the article table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators.entries import collect_entries, normalize_entries, split_by_publication
from newsloom.operators.merges import insert_absent, update_title_and_summary
from newsloom.session import materialize
from newsloom.sources.feeds import read_feed_files
from newsloom.sources.publications import publication_feeds


def collect(entries: DataFrame, as_of: datetime, drop_feed_on_bad_date: bool = False) -> DataFrame:
    normalized = normalize_entries(entries, as_of, only_fresh=not drop_feed_on_bad_date)
    return collect_entries(normalized, drop_feed_on_bad_date)


def ingest(
    articles: DataFrame,
    entries: DataFrame,
    as_of: datetime,
    updating_publication: str,
    drop_feed_on_bad_date: bool = False,
) -> DataFrame:
    """The article table after one run.

    Entries of ``updating_publication`` refresh title and summary of known links; those of all
    other publications only add links that are not known yet.
    """
    collected = materialize(collect(entries, as_of, drop_feed_on_bad_date), "collected")
    return merge_collected(articles, collected, as_of, updating_publication)


def merge_collected(articles: DataFrame, collected: DataFrame, as_of: datetime, updating_publication: str) -> DataFrame:
    """The article table with stored ``collected`` entries merged in."""
    updating, others = split_by_publication(collected, updating_publication)
    merged = update_title_and_summary(articles, updating)
    # both kinds add the links that are not known yet
    added = insert_absent(articles, updating.unionByName(others), as_of)
    return merged.unionByName(added.select(*merged.columns))


def ingest_files(
    spark: SparkSession, articles: DataFrame, root: str, config: DataFrame, as_of: datetime, updating_publication: str
) -> DataFrame:
    entries = read_feed_files(spark, root, publication_feeds(config))
    return ingest(articles, entries, as_of, updating_publication)
