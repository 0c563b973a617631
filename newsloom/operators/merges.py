"""Merge results into the article table.

Each function returns rows; :mod:`newsloom.sources.tables` writes them. The incoming side is
measured and broadcast when it is small, so the article table is not shuffled; otherwise both
sides are joined by key. Incoming frames are read more than once and should be stored first when
they are expensive (:func:`newsloom.session.materialize`).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.schema import ARTICLE, conform
from newsloom.session import broadcast_if_small, instant, materialize
from newsloom.sources.payloads import explode_payloads, typed_updates

RULE_COLUMNS = ["agent", "score", "reason"]
EMBEDDING_COLUMNS = ["embedding2"]
SCORE_COLUMNS = ["ai_score2", "tags_topic", "tags_mood", "tags_scope", "score", "agent"]
RECORD_COLUMNS = ["agent", "score", "ai_score"]


def last_per_key(rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The last row of each key; the rank limit also runs before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def single_updates(updates: DataFrame, columns: list[str], key: str = "id", order: list[str] | None = None) -> DataFrame:
    """``key`` and the struct ``_new`` of ``columns``, one row per key; rows without a key are left out.

    With ``order`` the last row of a key counts. Without it rows of one key must agree in ``columns``: those that
    do are one, others fail the job, because no order says which of them is meant.
    """
    keyed = updates.where(F.col(key).isNotNull())
    if order:
        return last_per_key(keyed.select(key, *columns, *[c for c in order if c not in columns]), order, key).select(key, F.struct(*columns).alias("_new"))
    new = F.struct(*columns)
    stop = F.raise_error(F.concat(F.lit(f"different updates for {key} "), F.col(key).cast("string")))
    merged = keyed.groupBy(key).agg(F.min(new).alias("_new"), F.max(new).alias("_other"))
    return merged.select(key, F.when(F.col("_new").eqNullSafe(F.col("_other")), F.col("_new")).otherwise(stop).alias("_new"))


def update_columns(
    articles: DataFrame,
    updates: DataFrame,
    columns: list[str],
    key: str = "id",
    stamp: datetime | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Overwrite ``columns`` where ``updates`` has the key, NULLs included; keep all else.

    The result has the rows of ``articles``, however often a key is repeated in ``updates`` (see
    :func:`single_updates`); keys the table does not have are ignored. With ``stamp`` the touched
    rows also get it as updated_at.
    """
    incoming, _ = broadcast_if_small(single_updates(updates, columns, key, order))
    hit = F.col("_new").isNotNull()
    types = {f.name: f.dataType for f in articles.schema.fields}
    projected = []
    for name in articles.columns:
        if name in columns:
            value = F.when(hit, F.col("_new")[name].cast(types[name])).otherwise(F.col(name))
        elif name == "updated_at" and stamp is not None:
            value = F.when(hit, instant(stamp)).otherwise(F.col(name))
        else:
            value = F.col(name)
        projected.append(value.alias(name))
    return articles.join(incoming, key, "left").select(*projected)


def apply_rule_results(articles: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    """Write (id, agent, score, reason) rows; of rows with the same id the last one counts."""
    order = [c for c in ("batch_ord", "pos") if c in rows.columns]
    return update_columns(articles, rows, RULE_COLUMNS, stamp=as_of, order=order)


def apply_payloads(articles: DataFrame, payloads: DataFrame, as_of: datetime) -> DataFrame:
    """The same from JSON array payloads, in payload order."""
    return apply_rule_results(articles, typed_updates(explode_payloads(payloads)), as_of)


def save_embeddings(articles: DataFrame, embedded: DataFrame, order: list[str] | None = None) -> DataFrame:
    return update_columns(articles, embedded, EMBEDDING_COLUMNS, order=order)


def save_scores(articles: DataFrame, scored: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Write scores, tags and agent of all scored rows; failed ones carry their old values."""
    return update_columns(articles, scored, SCORE_COLUMNS, order=order)


def save_records(articles: DataFrame, records: DataFrame, order: list[str] | None = None) -> DataFrame:
    return update_columns(articles, records, RECORD_COLUMNS, order=order)


def one_per_link(entries: DataFrame) -> DataFrame:
    order = [c for c in ("pub_ord", "url_ord", "entry_ord") if c in entries.columns] or ["title"]
    first = Window.partitionBy("link").orderBy(*order)
    return entries.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def absent_by_link(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose link the table does not have yet, one per link.

    With few entries the table's links are only scanned and matched against a broadcast set;
    what comes back is no larger than the entries.
    """
    new = one_per_link(entries)
    known = articles.select("link")
    links, small = broadcast_if_small(entries.select("link").distinct())
    if small:
        # stored, because a scan of the whole table may outlast the time limit of a broadcast
        known = F.broadcast(materialize(known.join(links, "link", "left_semi").distinct(), "known-links"))
    return new.join(known, "link", "left_anti")


def number_from(rows: DataFrame, last_id: int) -> DataFrame:
    """Give stored ``rows`` consecutive ids after ``last_id``, without sorting them.

    Rows carry ``_at``, a partition number and a place in it; the counts per partition give
    the offsets.
    """
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the write
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, at = [], last_id + 1
    for row in counts:
        starts.append((row["part"], at))
        at += row["count"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, start long"))
    return rows.withColumn("part", part).join(offsets, "part").withColumn("id", F.col("start") + place).drop("part", "start", "_at")


def insert_absent(articles: DataFrame, entries: DataFrame, as_of: datetime, last_id: int | None = None) -> DataFrame:
    """New article rows for links not in the table, with ids after the table's highest one."""
    if last_id is None:
        last_id = articles.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = absent_by_link(articles, entries).withColumn("_at", F.monotonically_increasing_id())
    rows = number_from(materialize(new, "new-articles"), int(last_id))
    return conform(rows.withColumn("created_at", instant(as_of)), ARTICLE)


def update_title_and_summary(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """Existing rows with the entries' title and summary; all other columns stay."""
    return update_columns(articles, one_per_link(entries), ["title", "summary"], key="link")


def upsert_title_and_summary(articles: DataFrame, entries: DataFrame, as_of: datetime) -> DataFrame:
    """The whole table after the merge: updated rows and rows for new links."""
    merged = update_title_and_summary(articles, entries)
    return merged.unionByName(insert_absent(articles, entries, as_of).select(*merged.columns))
