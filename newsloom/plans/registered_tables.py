"""Registered queries over tables that jobs write, repeated updates and the order of results, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import counters, inference, merges, rules, selection as sel
from newsloom.plans import derived_views as dv
from newsloom.plans import jobs
from newsloom.plans.derived_views import AS_OF, AS_OF_SQL, HACKER_NEWS, table
from newsloom.plans.ranking import top_results
from newsloom.plans.registered import land, query, time_text
from newsloom.plans.registered_sql import _A, _CARRIED, _COMBINED, _FROM, _RECENT, _RESULT, _SCORED, _SHORT, _UPDATES, ORACLE, _digest, _nearest, _time, _vector
from newsloom.plans import registered as base_queries
from newsloom.schema import ARTICLE, conform
from newsloom.session import materialize, scratch_path
from newsloom.sources import tables

# --- repeated keys ----------------------------------------------------------------------------


def _opinions(spark: SparkSession, sf: str) -> DataFrame:
    """Several updates for most ids: one by the document itself, one by each document after it in a group of seven."""
    return table(spark, sf, "documents").selectExpr("doc_id AS said_at", "doc_id % 100 AS agent_number", "doc_id").selectExpr(
        "doc_id - doc_id % 7 AS id", "concat('A', agent_number) AS agent", "cast(doc_id % 9 AS int) AS score", "cast(doc_id % 4 AS int) AS ai_score", "said_at"
    )


@query
def records_saved_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Updates that name an id up to seven times change no number of rows; the last one counts."""
    got = merges.save_records(dv.articles(spark, sf), _opinions(spark, sf), order=["said_at"])
    return got.select("id", "agent", F.col("score").cast("long"), F.col("ai_score").cast("long"))


ORACLE["records_saved_last_wins"] = (
    _A + """, opinion AS (SELECT doc_id - doc_id % 7 AS id, concat('A', doc_id % 100) AS agent, doc_id % 9 AS score, doc_id % 4 AS ai_score
      FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id - doc_id % 7 ORDER BY doc_id DESC) = 1)
    SELECT a.id, CASE WHEN o.id IS NULL THEN a.agent ELSE o.agent END AS agent, CASE WHEN o.id IS NULL THEN a.score ELSE o.score END AS score,
      o.ai_score FROM article a LEFT JOIN opinion o ON a.id = o.id"""
)


@query
def scores_saved_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Every result handed in twice, as after a retried request: equal rows of an id are one."""
    scored = materialize(base_queries._scored(spark, sf).select("id", *merges.SCORE_COLUMNS), "scored")
    return merges.save_scores(dv.articles(spark, sf), scored.unionByName(scored)).select(*base_queries._score_list())


ORACLE["scores_saved_repeated"] = _A + f", {_RESULT} {_CARRIED} {_FROM}"


@query
def filled_counts_after_scoring(spark: SparkSession, sf: str) -> DataFrame:
    scored = materialize(base_queries._scored(spark, sf).select("id", *merges.SCORE_COLUMNS), "scored")
    return counters.filled_counts(merges.save_scores(dv.articles(spark, sf), scored), ["embedding2", *sel.SCORE_COLUMNS])


ORACLE["filled_counts_after_scoring"] = (
    _A + f""", {_RESULT} SELECT count(a.embedding2) AS embedding2, count(r.score) AS ai_score2, count(r.topic) AS tags_topic,
      count(r.mood) AS tags_mood, count(r.scope) AS tags_scope FROM article a JOIN result r ON a.id = r.id"""
)

# --- selections and order ---------------------------------------------------------------------


@query
def rows_set_by_users(spark: SparkSession, sf: str) -> DataFrame:
    """What stops a rescoring run."""
    return dv.articles(spark, sf).where(rules.set_by_user(F.col("agent"))).select("id", "agent")


ORACLE["rows_set_by_users"] = _A + "SELECT id, agent FROM article WHERE lower(agent) = 'user'"


@query
def first_embedded_articles(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the first fifty articles without a vector, in the order of their ids."""
    todo = sel.prepare_for_models(dv.articles(spark, sf).where("embedding2 is null")).select("id", "combined", "embedding2")
    got = inference.embed_articles(todo, lambda texts: [[float(len(t))] for t in texts], count=50)
    return got.select("id", F.get("embedding2", F.lit(0)).cast("long").alias("length"))


ORACLE["first_embedded_articles"] = _A + f"SELECT id, length({_COMBINED}) AS length FROM article WHERE embedding2 IS NULL ORDER BY id LIMIT 50"


@query
def combined_short_texts(spark: SparkSession, sf: str) -> DataFrame:
    ready = sel.prepare_for_models(dv.articles(spark, sf), use_short=True)
    return base_queries.digest(ready, "id", combined=F.col("combined"))


_COMBINED_SHORT = re.sub(r"\b(title|summary)\b", r"\1_short", _COMBINED)
ORACLE["combined_short_texts"] = _A + f", {_SHORT} SELECT id, {_digest(_COMBINED_SHORT, 'combined')} FROM short"


@query
def top_results_order(spark: SparkSession, sf: str) -> DataFrame:
    """The places of the ranked articles as the result is read."""
    ranked = top_results(dv.articles(spark, sf), AS_OF).withColumn("read", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("read"))
    return ranked.select("id", F.round("neighbor_score", 6).alias("neighbor_score"), place.cast("long").alias("place"))


ORACLE["top_results_order"] = (
    _nearest(False) + _SCORED + """SELECT source_id AS id, round(calculated_score, 6) AS neighbor_score,
      row_number() OVER (ORDER BY calculated_score DESC NULLS FIRST, source_id) AS place FROM scored"""
)

# --- jobs -------------------------------------------------------------------------------------


def _table_of(spark: SparkSession, rows: DataFrame) -> str:
    base = scratch_path(spark, "article-table")
    tables.write_version(conform(rows, ARTICLE), base)
    return base


@query
def ingest_job_table(spark: SparkSession, sf: str) -> DataFrame:
    """Landed files brought into a committed table that knows some of the links."""
    root, _ = land(spark, dv.entries(spark, sf))
    config = dv.entries(spark, sf).groupBy("feed_publication", "pub_ord").agg(F.array_sort(F.collect_set("feed_url")).alias("urls"))
    config = config.select(F.col("feed_publication").alias("publication"), "urls", F.lit(True).alias("enabled"), "pub_ord")
    base = _table_of(spark, base_queries._articles_from_entries(spark, sf))
    jobs.ingest_job(spark, base, root, config, AS_OF, HACKER_NEWS)
    return jobs.current(spark, base).select("link", "title", "summary", "agent", "publication")


ORACLE["ingest_job_table"] = ORACLE["ingested_articles"]


@query
def payload_job_table(spark: SparkSession, sf: str) -> DataFrame:
    base = _table_of(spark, dv.articles(spark, sf))
    jobs.payload_job(spark, base, base_queries._payloads(spark, sf), AS_OF)
    return jobs.current(spark, base).select("id", "agent", F.col("score").cast("long"), "reason", time_text("updated_at", "updated_at"))


ORACLE["payload_job_table"] = (
    _A + f""", {_UPDATES}, last AS (SELECT * FROM update_row QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_ord DESC, pos DESC) = 1)
    SELECT a.id, l.agent, l.score, l.reason, {_time(AS_OF_SQL, 'updated_at')} FROM article a JOIN last l ON a.id = l.id"""
)


@query
def records_job_table(spark: SparkSession, sf: str) -> DataFrame:
    base = _table_of(spark, dv.articles(spark, sf))
    jobs.records_job(spark, base, _opinions(spark, sf), order=["said_at"])
    return jobs.current(spark, base).select("id", "agent", F.col("score").cast("long"), F.col("ai_score").cast("long"))


ORACLE["records_job_table"] = ORACLE["records_saved_last_wins"]


@query
def rules_job_table(spark: SparkSession, sf: str) -> DataFrame:
    base = _table_of(spark, dv.articles(spark, sf))
    jobs.rules_job(spark, base, dv.tags(spark), AS_OF)
    return jobs.current(spark, base).select("id", "agent", "score", "reason")


ORACLE["rules_job_table"] = ORACLE["versioned_table"]


@query
def embedding_job_table(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors from a stand-in for a model, committed for the recent articles without one."""
    base = _table_of(spark, dv.articles(spark, sf))
    jobs.embedding_job(spark, base, AS_OF, lambda texts: [[float(len(t)), 1.0] for t in texts])
    return jobs.current(spark, base).select("id", *base_queries.vector_digest("embedding2"))


ORACLE["embedding_job_table"] = (
    _A + f""", chosen AS ({_RECENT}) SELECT a.id, CASE WHEN c.id IS NULL THEN a.dims ELSE 2 END AS dims,
      CASE WHEN c.id IS NULL THEN a.weighted ELSE c.length + 2.0 END AS weighted
    FROM (SELECT id, {_vector('embedding2')} FROM article) a LEFT JOIN (SELECT id, length({_COMBINED}) AS length FROM chosen) c ON a.id = c.id"""
)


@query
def appended_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Three commits, each adding rows: the last version has all, the first only its own."""
    base = scratch_path(spark, "appended")
    articles = dv.articles(spark, sf).select("id", "title")
    for part in range(3):
        tables.append_version(articles.where(F.col("id") % 3 == part).withColumn("part", F.lit(part)), base)
    first = tables.read_version(spark, base, 1).withColumn("version", F.lit(1))
    return first.unionByName(tables.read_version(spark, base).withColumn("version", F.lit(3))).select("version", "part", "id")


ORACLE["appended_versions"] = """SELECT 1 AS version, 0 AS part, doc_id AS id FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 3, CAST(doc_id % 3 AS INTEGER), doc_id FROM documents"""
