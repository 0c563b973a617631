"""Run counters; each is one partially aggregated pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.html import html_to_text
from newsloom.operators.entries import FEED_ORDER, NO_DATE, TOO_OLD


def publication_counts(normalized: DataFrame) -> DataFrame:
    """Entries per publication: all, looked at, too old, in error."""
    reason = F.col("reject_reason")
    skipped = reason == TOO_OLD
    undated = reason == NO_DATE
    return normalized.groupBy("publication").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(reason.isNull() | ~(skipped | undated)).alias("processed"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(reason.isNotNull() & ~skipped).alias("errors"),
    )


def feed_counts(normalized: DataFrame) -> DataFrame:
    """Entries per feed: valid, duplicates, filtered (content never filters) and unreadable.

    One pass: the entries are counted per link and feed before the shuffle, each with its first summary, and
    the first feed of a link is found among those counts.
    """
    accepted = normalized.where("reject_reason is null")
    offers = accepted.groupBy("link", "feed_url").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*FEED_ORDER, "summary")).alias("first")
    )
    by_link = Window.partitionBy("link").orderBy("first")
    ranked = offers.withColumn("rank", F.row_number().over(by_link))
    is_first = F.col("rank") == 1
    read = ranked.withColumn("readable", html_to_text(F.when(is_first, F.col("first.summary"))).isNotNull())
    counted = read.groupBy("feed_url").agg(
        F.sum("n").alias("offered"), F.count_if(is_first & F.col("readable")).alias("valid"), F.count_if(is_first & ~F.col("readable")).alias("html_errors")
    )
    return counted.select(
        "feed_url",
        "valid",
        (F.col("offered") - F.col("valid") - F.col("html_errors")).alias("duplicates"),
        F.lit(0).cast("long").alias("filtered"),
        "html_errors",
    )


def configuration_counts(publications: DataFrame) -> DataFrame:
    """Publications, enabled publications and the feeds of the enabled ones."""
    return publications.agg(
        F.count(F.lit(1)).alias("publications"),
        F.count_if("enabled").alias("enabled"),
        F.coalesce(F.sum(F.when(F.col("enabled"), F.size("urls"))), F.lit(0)).cast("long").alias("feeds"),
    )


def entries_per_publication(collected: DataFrame) -> DataFrame:
    """Collected entries per publication and, with a NULL publication, over all."""
    return collected.rollup("publication").agg(F.count(F.lit(1)).alias("entries"))


def scoring_counts(scored: DataFrame) -> DataFrame:
    status = F.col("scoring_status")
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "SUCCESS").alias("success"),
        F.count_if(status.startswith("FAILED")).alias("failed"),
    )


def mean_seconds(timed: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Mean duration per row, 0 when there are no rows."""
    return timed.agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_seconds"))


def embedding_counts(articles: DataFrame, vector: str = "embedding2") -> DataFrame:
    return articles.agg(F.count(vector).alias("embedded"), F.count(F.lit(1)).alias("total"))


def filled_counts(articles: DataFrame, columns: list[str]) -> DataFrame:
    """Number of non-NULL values of each column."""
    return articles.agg(*[F.count(c).alias(c) for c in columns])
