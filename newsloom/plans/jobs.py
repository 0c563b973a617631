"""Jobs that bring their results into a versioned article table.

Each reads the latest version, computes the new table and commits it; when another writer commits first,
it starts again from that version (:func:`newsloom.sources.tables.change_table`). What a job computes before,
such as parsed feeds and model replies, is stored and not computed again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators import inference
from newsloom.operators.merges import apply_payloads, apply_rule_results, save_records
from newsloom.operators.rules import run_rules
from newsloom.plans import enrich
from newsloom.plans.ingest import collect, merge_collected
from newsloom.session import materialize
from newsloom.sources.feeds import read_feed_output
from newsloom.sources.publications import publication_feeds
from newsloom.sources.tables import append_version, change_table, latest_version, read_version


def ingest_job(spark: SparkSession, base: str, root: str, config: DataFrame, as_of: datetime, updating_publication: str, rejects: str | None = None) -> int:
    """Landed feeds into the table; damaged records are committed to the table ``rejects``. Returns the version."""
    entries, damaged = read_feed_output(spark, root, publication_feeds(config))
    if rejects is not None:
        append_version(damaged.select("feed_key", "entry_ord.file", "entry_ord.place", "damage", "record"), rejects)
    collected = materialize(collect(entries, as_of), "collected")
    return change_table(spark, base, lambda articles: merge_collected(articles, collected, as_of, updating_publication))


def rules_job(spark: SparkSession, base: str, tags: DataFrame, as_of: datetime, rescore: bool = False) -> int:
    def change(articles: DataFrame) -> DataFrame:
        results = materialize(run_rules(articles, tags, rescore), "rule-results")
        return apply_rule_results(articles, results, as_of)

    return change_table(spark, base, change)


def payload_job(spark: SparkSession, base: str, payloads: DataFrame, as_of: datetime) -> int:
    return change_table(spark, base, lambda articles: apply_payloads(articles, payloads, as_of))


def records_job(spark: SparkSession, base: str, records: DataFrame, order: list[str] | None = None) -> int:
    return change_table(spark, base, lambda articles: save_records(articles, records, order))


def embedding_job(spark: SparkSession, base: str, as_of: datetime, embed: inference.EmbedFn, **limits) -> int:
    return change_table(spark, base, lambda articles: enrich.add_embeddings(articles, as_of, embed, **limits))


def scoring_job(spark: SparkSession, base: str, as_of: datetime, complete: inference.CompleteFn, taxonomy: DataFrame, profile_json: str, template: str, **limits) -> int:
    """Scores by model for recent articles. The replies are stored; a second attempt asks for the articles it finds then."""
    return change_table(
        spark, base, lambda articles: enrich.add_scores(articles, as_of, complete, taxonomy, profile_json, template, **limits)
    )


def current(spark: SparkSession, base: str) -> DataFrame:
    return read_version(spark, base, latest_version(spark, base))
