"""Registered queries: one per operator, each over the whole given tables.

Arrays are shown as joined text, times as text and long texts as length and MD5, so that results
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.dates import parse_published
from newsloom.functions.html import collapse_whitespace, html_to_text, paragraphs_to_text
from newsloom.functions.prompts import build_prompt, format_taxonomy
from newsloom.functions.replies import parse_reply
from newsloom.functions.vectors import l2_distance
from newsloom.operators import counters, entries as en, inference, merges, rules, selection as sel
from newsloom.operators.neighbors import nearest_neighbors, neighbor_scores
from newsloom.plans import derived_views as dv
from newsloom.plans import ingest
from newsloom.plans.derived_views import AS_OF, HACKER_NEWS, table
from newsloom.plans.ranking import top_results
from newsloom.schema import ARTICLE, TAGGING_RESULT, conform
from newsloom.session import configure, instant, materialize, scratch_path, spread
from newsloom.sources import feeds, payloads, publications, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PROMPT = "Rate the article.\n{taxonomy}\nReader: {profile}\n\n{article}\nAnswer with JSON."
PROFILE = '{"likes": ["science"]}'


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    QUERIES[run.__name__] = configured
    return run


def digest(df: DataFrame, key: str, **texts: Column) -> DataFrame:
    """Key, and length and MD5 of each text; the texts are computed first and once."""
    shown = df.select(key, *[c.alias(n) for n, c in texts.items()])
    columns = []
    for n in texts:
        columns += [F.char_length(n).cast("long").alias(f"{n}_len"), F.md5(n).alias(f"{n}_md5")]
    return shown.select(key, *columns)


def joined(col: str, name: str | None = None) -> Column:
    return F.array_join(col, ",", "<null>").alias(name or col)


def time_text(col: Column | str, name: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name)


def vector_digest(name: str) -> list[Column]:
    """Length of a vector and the sum of its components times their places."""
    parts = F.transform(name, lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return [F.size(name).cast("long").alias("dims"), F.round(total, 3).alias("weighted")]


def distance(name: str = "distance") -> Column:
    return F.round("distance", 6).alias(name)


# --- neighbours -------------------------------------------------------------------------------


@query
def neighbor_pairs_global(spark, sf):
    pairs = nearest_neighbors(dv.articles(spark, sf), AS_OF)
    return pairs.select("source_id", "neighbor_id", "neighbor_score", distance())


@query
def neighbor_pairs_per_article(spark, sf):
    pairs = nearest_neighbors(dv.articles(spark, sf), AS_OF, per_article=True)
    return pairs.select("source_id", "neighbor_id", "neighbor_score", distance())


@query
def neighbor_pairs_with_vectors(spark, sf):
    pairs = nearest_neighbors(dv.articles(spark, sf), AS_OF, per_article=True, keep_missing=False)
    return pairs.select("source_id", "neighbor_id", "neighbor_score", distance())


@query
def neighbor_pairs_by_cells(spark, sf):
    """The path for many recent vectors, taken here by allowing no broadcast."""
    pairs = nearest_neighbors(
        dv.articles(spark, sf), AS_OF, per_article=True, keep_missing=False, broadcast_bytes=0, pivots=4
    )
    return pairs.select("source_id", "neighbor_id", "neighbor_score", distance())


@query
def neighbor_pairs_by_blocks(spark, sf):
    """The path for more recent vectors than a broadcast may hold, taken here by allowing few."""
    a = dv.articles(spark, sf)
    # a third of the recent vectors, at 64 doubles each
    recent = a.where(F.col("created_at") >= instant(AS_OF) - F.expr("interval 2 days")).where("embedding2 is not null").count()
    pairs = nearest_neighbors(a, AS_OF, per_article=True, keep_missing=False, broadcast_bytes=max(1024, recent * 512 // 3))
    return pairs.select("source_id", "neighbor_id", "neighbor_score", distance())


@query
def neighbor_scores_per_article(spark, sf):
    pairs = nearest_neighbors(dv.articles(spark, sf), AS_OF, per_article=True)
    return neighbor_scores(pairs).select(
        "source_id", "source_score", F.round("calculated_score", 6).alias("calculated_score")
    )


def _ranked(df):
    return df.select(
        "id", "title", "publication", "agent", "score", F.round("neighbor_score", 6).alias("neighbor_score")
    )


@query
def top_results_global(spark, sf):
    return _ranked(top_results(dv.articles(spark, sf), AS_OF))


@query
def top_results_per_article(spark, sf):
    return _ranked(top_results(dv.articles(spark, sf), AS_OF, per_article=True))


@query
def vector_distances(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(l2_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


# --- selection --------------------------------------------------------------------------------


@query
def articles_with_nulls(spark, sf):
    return sel.with_nulls_in(dv.articles(spark, sf), ["embedding2", "score"]).select("id", "publication")


@query
def articles_created_since(spark, sf):
    return sel.created_since(dv.articles(spark, sf), AS_OF).select("id", time_text("created_at", "created_at"))


@query
def recent_articles(spark, sf):
    return sel.recent(dv.articles(spark, sf), AS_OF, ["embedding2"]).select("id", time_text("created_at", "created_at"))


@query
def recent_articles_for_models(spark, sf):
    ready = sel.recent_for_models(dv.articles(spark, sf), AS_OF, ["embedding2"])
    return digest(ready, "id", title=F.col("title_short"), summary=F.col("summary_short"), combined=F.col("combined"))


@query
def negative_tags(spark, sf):
    return rules.negative_tags(dv.word_tags(spark, sf))


@query
def positive_tags(spark, sf):
    return rules.positive_tags(dv.word_tags(spark, sf))


@query
def unprocessed_articles(spark, sf):
    return sel.unprocessed(dv.articles(spark, sf)).select("id")


@query
def rescorable_articles(spark, sf):
    return sel.rescorable(dv.articles(spark, sf)).select("id", "agent", "score")


@query
def classified_without_embedding(spark, sf):
    return digest(sel.classified_without_embedding(dv.articles(spark, sf)), "id", combined=F.col("combined"))


@query
def training_set(spark, sf):
    return sel.training_set(dv.articles(spark, sf)).select("id", "score", *vector_digest("embedding2"))


@query
def embedding_dry_run(spark, sf):
    todo = dv.articles(spark, sf).where("embedding2 is null")
    same = inference.embed_articles(sel.prepare_for_models(todo), embed=None, dry_run=True)
    return same.select("id", F.col("embedding2").isNull().alias("still_empty"))


@query
def update_records(spark, sf):
    return sel.update_records(dv.articles(spark, sf)).select(
        "id", "agent", "score", F.col("ai_score").cast("long")
    )


@query
def split_by_publication(spark, sf):
    collected = ingest.collect(dv.entries(spark, sf), AS_OF)
    hn, others = en.split_by_publication(collected, HACKER_NEWS)
    return hn.select(F.lit("updating").alias("part"), "link").unionByName(others.select(F.lit("adding").alias("part"), "link"))


@query
def bad_content_marks(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", tx.has_bad_content(F.col("url"), F.col("html")).alias("has_bad_content"))


# --- text -------------------------------------------------------------------------------------


@query
def collapsed_whitespace(spark, sf):
    return digest(table(spark, sf, "documents"), "doc_id", text=collapse_whitespace(F.col("text")))


@query
def lower_case(spark, sf):
    return digest(table(spark, sf, "documents"), "doc_id", text=tx.lower_case(F.col("text")))


@query
def special_characters_removed(spark, sf):
    d, c = spread(table(spark, sf, "documents").select("doc_id", "text")), F.col("text")
    return digest(
        d, "doc_id", kept_digits=tx.remove_special_characters(c), no_digits=tx.remove_special_characters(c, remove_digits=True)
    )


@query
def short_texts(spark, sf):
    a = sel.with_short_texts(dv.articles(spark, sf))
    return digest(a, "id", title=F.col("title_short"), summary=F.col("summary_short"))


@query
def texts_before_bar(spark, sf):
    return digest(table(spark, sf, "documents"), "doc_id", text=tx.before_bar(F.col("text")))


@query
def texts_cut_short(spark, sf):
    return digest(table(spark, sf, "documents"), "doc_id", text=tx.cut_short(F.col("text"), 300, tx.SUMMARY_ERROR))


@query
def combined_texts(spark, sf):
    a = dv.articles(spark, sf)
    c = F.col
    return digest(a, "id", combined=tx.combined_text(c("publication"), c("title"), c("summary"), c("author")))


@query
def stripped_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_query(F.col("url")).alias("url"))


@query
def title_cased(spark, sf):
    return digest(table(spark, sf, "documents"), "doc_id", text=tx.title_case(F.col("text")))


@query
def newlines_to_spaces(spark, sf):
    return digest(table(spark, sf, "documents"), "doc_id", text=tx.newlines_to_spaces(F.col("text")))


@query
def page_texts(spark, sf):
    return digest(table(spark, sf, "pages"), "page_id", text=html_to_text(F.col("html")))


@query
def paragraph_texts(spark, sf):
    return digest(table(spark, sf, "pages"), "page_id", text=paragraphs_to_text(F.col("html")))


# --- feed entries -----------------------------------------------------------------------------


@query
def publication_feeds(spark, sf):
    found = publications.publication_feeds(dv.publications(spark, sf))
    return found.select("feed_publication", "url_ord", "feed_url")


@query
def fresh_entries(spark, sf):
    e = dv.entries(spark, sf)
    return e.where(en.is_fresh(F.col("published_parsed"), instant(AS_OF))).select("entry_ord")


@query
def published_dates(spark, sf):
    return dv.entries(spark, sf).select("entry_ord", time_text(parse_published(F.col("published")), "published_at"))


@query
def entry_routes(spark, sf):
    e = dv.entries(spark, sf)
    return e.select("entry_ord", en.route(F.col("entry_id"), F.col("link"), F.lit(None).cast("string")).alias("route"))


def _entry_columns(df):
    return df.select(
        "entry_ord", "title", "link", "summary", joined("tags"), "media", "author", "publication",
        time_text("published_at", "published_at"),
    )


@query
def normalized_entries(spark, sf):
    n = en.normalize_entries(dv.entries(spark, sf), AS_OF)
    return _entry_columns(n.where("reject_reason is null"))


@query
def rejected_entries(spark, sf):
    return en.normalize_entries(dv.entries(spark, sf), AS_OF).where("reject_reason is not null").select("entry_ord", "reject_reason")


@query
def collected_entries(spark, sf):
    return _entry_columns(ingest.collect(dv.entries(spark, sf), AS_OF))


@query
def collected_html_entries(spark, sf):
    """Entries whose summaries are whole web pages."""
    got = ingest.collect(dv.entries(spark, sf, html_summary=True), AS_OF)
    return digest(got, "entry_ord", link=F.col("link"), summary=F.col("summary"))


def _undated(spark, sf):
    date = F.when((F.col("url_ord") == 0) | (F.col("entry_ord") % 41 != 17), F.col("published_parsed"))
    return dv.entries(spark, sf).withColumn("published_parsed", date)


@query
def collected_dropping_feeds(spark, sf):
    """Entries without a date end their feed."""
    got = ingest.collect(_undated(spark, sf), AS_OF, drop_feed_on_bad_date=True)
    return got.select("entry_ord", "link")


@query
def publication_counts(spark, sf):
    return counters.publication_counts(en.normalize_entries(_undated(spark, sf), AS_OF))


@query
def feed_counts(spark, sf):
    return counters.feed_counts(en.normalize_entries(dv.entries(spark, sf), AS_OF))


@query
def configuration_counts(spark, sf):
    return counters.configuration_counts(dv.publications(spark, sf))


@query
def entries_per_publication(spark, sf):
    return counters.entries_per_publication(ingest.collect(dv.entries(spark, sf), AS_OF))


def land(spark, rows):
    """Write entries as RSS files of their feeds, in their order; returns the folder and the feeds."""
    known = rows.select("feed_publication", "pub_ord", "url_ord", "feed_url").distinct().withColumn(
        "feed_key", publications.feed_key(F.col("feed_url"))
    )
    root = scratch_path(spark, "landed")
    items = rows.orderBy("entry_ord").select(
        publications.feed_key(F.col("feed_url")).alias("feed_key"),
        F.col("entry_id").alias("guid"), "title", "link", "comments", F.col("summary").alias("description"),
        F.col("published").alias("pubDate"), "author",
    )
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").partitionBy("feed_key").save(root)
    return root, materialize(known, "feeds")


@query
def feed_files(spark, sf):
    root, known = land(spark, dv.entries(spark, sf))
    got = feeds.read_feed_files(spark, root, known)
    return got.select(
        "feed_publication", "feed_url", "entry_id", "title", "link", "comments", "summary", "author",
        time_text("published_parsed", "published_at"),
    )


# --- rules ------------------------------------------------------------------------------------


def _marks(df):
    return df.select("id", "score", "reason")


@query
def tag_marks(spark, sf):
    return _marks(rules.mark_by_tags(dv.articles(spark, sf), dv.tags(spark)))


@query
def tag_marks_many_tags(spark, sf):
    """The join by name, taken here by allowing no tags in the plan."""
    return _marks(rules.mark_by_tags(_worded(spark, sf), dv.word_tags(spark, sf), most_literals=0))


def _worded(spark, sf):
    """Articles whose own tags are the words of their title."""
    return dv.articles(spark, sf).withColumn("tags", F.split("title", " "))


@query
def text_marks(spark, sf):
    return _marks(rules.mark_by_text(dv.articles(spark, sf), dv.tags(spark)))


@query
def text_marks_many_tags(spark, sf):
    return _marks(rules.mark_by_text(dv.articles(spark, sf), dv.word_tags(spark, sf)))


def _results(df):
    return df.select("id", "agent", "score", "reason")


@query
def rule_results(spark, sf):
    return _results(rules.run_rules(dv.articles(spark, sf), dv.tags(spark)))


@query
def rule_results_rescored(spark, sf):
    a = dv.articles(spark, sf).withColumn("agent", F.when(F.col("agent") == "user", "TAG").otherwise(F.col("agent")))
    return _results(rules.run_rules(a, dv.tags(spark), rescore=True))


@query
def rule_results_many_tags(spark, sf):
    return _results(rules.run_rules(_worded(spark, sf), dv.word_tags(spark, sf)))


# --- merges -----------------------------------------------------------------------------------


def _payloads(spark, sf):
    """One JSON array per document: a first opinion about it and a last word about the next one."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS batch_ord",
        """concat('[{"id": "', doc_id, '", "agent": "TAG", "score": "', doc_id % 7 - 3, '", "reason": "r', doc_id, '"},',
                  '{"id": ', doc_id + 1, ', "agent": "TITLE", "score": ', doc_id % 5 - 2, '}]') AS payload""",
    )


@query
def payload_rows(spark, sf):
    rows = payloads.typed_updates(payloads.explode_payloads(_payloads(spark, sf)))
    return rows.select("batch_ord", "pos", "id", "agent", F.col("score").cast("long"), "reason")


@query
def payloads_applied(spark, sf):
    merged = merges.apply_payloads(dv.articles(spark, sf), _payloads(spark, sf), AS_OF)
    return merged.select(
        "id", "title", "agent", F.col("score").cast("long"), "reason", time_text("updated_at", "updated_at")
    )


def _stored_entries(spark, sf):
    return materialize(ingest.collect(dv.entries(spark, sf), AS_OF), "collected")


def _articles_from_entries(spark, sf):
    """A table that holds the links of two publications already."""
    links = dv.entries(spark, sf).where("feed_publication in ('HackerNews', 'Guardian')").groupBy("link").agg(F.min("entry_ord").alias("id"))
    known = links.select("id", "link", F.lit("old title").alias("title"), F.lit("old summary").alias("summary"),
                         F.lit("AI").alias("agent"))
    return materialize(conform(known, ARTICLE), "articles")


@query
def absent_entries(spark, sf):
    new = merges.absent_by_link(_articles_from_entries(spark, sf), _stored_entries(spark, sf))
    return new.select("link", "title", "summary")


@query
def inserted_articles(spark, sf):
    known = _articles_from_entries(spark, sf)
    new = merges.insert_absent(known, _stored_entries(spark, sf), AS_OF)
    return new.select("link", "title", time_text("created_at", "created_at"), (F.count("id").over(merges.Window.partitionBy("id"))).alias("rows_with_id"))


@query
def upserted_articles(spark, sf):
    got = merges.upsert_title_and_summary(_articles_from_entries(spark, sf), _stored_entries(spark, sf), AS_OF)
    return got.select("link", "title", "summary", "agent")


@query
def ingested_articles(spark, sf):
    got = ingest.ingest(_articles_from_entries(spark, sf), dv.entries(spark, sf), AS_OF, HACKER_NEWS)
    return got.select("link", "title", "summary", "agent", "publication")


@query
def embeddings_saved(spark, sf):
    a = dv.articles(spark, sf)
    new = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.reverse("embedding").alias("embedding2"))
    return merges.save_embeddings(a, new).select("id", *vector_digest("embedding2"))


@query
def records_saved(spark, sf):
    a = dv.articles(spark, sf)
    new = table(spark, sf, "labels").selectExpr("doc_id AS id", "CASE WHEN toxic = 1 THEN 'AI' END AS agent",
                                                "quality AS score", "toxic AS ai_score")
    got = merges.save_records(a, new)
    return got.select("id", "agent", "score", "ai_score")


@query
def versioned_table(spark, sf):
    """Two versions of the table: as it is, and with the rule results merged in."""
    base = scratch_path(spark, "article-versions")
    tables.write_version(dv.articles(spark, sf), base)
    current = tables.read_version(spark, base)
    results = materialize(rules.run_rules(current, dv.tags(spark)), "rule-results")
    tables.write_version(merges.apply_rule_results(current, results, AS_OF), base)
    return tables.read_version(spark, base).select("id", "agent", "score", "reason")


@query
def partitioned_table(spark, sf):
    """Only the publications with a changed row are written again."""
    path = scratch_path(spark, "article-partitions")
    tables.append_rows(dv.articles(spark, sf), path, ["publication"])
    current = tables.read_articles(spark, path)
    new = materialize(
        current.where("publication in ('src1', 'src2')").select("id", F.lit("TAG").alias("agent"), F.lit(-10).alias("score"),
                                                                F.col("publication").alias("reason")), "updates")
    merged = merges.apply_rule_results(tables.touched_rows(current, new, "publication"), new, AS_OF)
    tables.replace_partitions(merged, path, ["publication"])
    return tables.read_articles(spark, path).select("id", "agent", "score", "reason")


# --- model replies ----------------------------------------------------------------------------


def _replies(spark, sf):
    """A reply for every document, in the shapes models answer in."""
    plain = """concat('{"scope": ["', source, '"], "topic": ["', lang, '", "x"], "mood": ["UNKNOWN"], "score": ', doc_id % 21 - 10, '}')"""
    quoted = f"replace({plain}, '\"', chr(39))"
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id",
        f"""CASE doc_id % 14
            WHEN 0 THEN {plain}
            WHEN 1 THEN concat('Here you are:\\n```json\\n', {plain}, '\\n```\\nDone.')
            WHEN 2 THEN concat('```\\n', {plain}, '\\n```')
            WHEN 3 THEN {quoted}
            WHEN 4 THEN concat('  "', {plain}, '" ')
            WHEN 5 THEN replace({plain}, 'UNKNOWN', concat('it', chr(39), 's'))
            WHEN 6 THEN ''
            WHEN 7 THEN NULL
            WHEN 8 THEN '[1, 2]'
            WHEN 9 THEN replace({plain}, 'UNKNOWN', chr(233))
            WHEN 10 THEN replace({plain}, 'UNKNOWN', concat(chr(92), 'u00e9'))
            WHEN 11 THEN concat({plain}, ' as asked')
            WHEN 12 THEN '{{"score": 7.5}}'
            ELSE concat('{{"score":', chr(10), ' 3}}') END AS reply""",
    )


def _error_kind(col: str) -> Column:
    return F.substring_index(col, ":", 1)


@query
def reply_results(spark, sf):
    parsed = _replies(spark, sf).select("id", parse_reply(F.col("reply")).alias("r"))
    return parsed.select(
        "id", joined("r.scope", "scope"), joined("r.topic", "topic"), joined("r.mood", "mood"),
        F.col("r.score").cast("long").alias("score"), _error_kind("r.error").alias("error_kind"),
    )


def _scored(spark, sf):
    answered = dv.articles(spark, sf).join(_replies(spark, sf), "id")
    return inference.apply_results(answered.withColumn("result", parse_reply(F.col("reply")).cast(TAGGING_RESULT)))


def _score_list() -> list:
    return [
        "id", "agent", F.col("score").cast("long"), F.col("ai_score2").cast("long"),
        joined("tags_scope"), joined("tags_topic"), joined("tags_mood"),
    ]


@query
def scored_articles(spark, sf):
    status = F.substring_index("scoring_status", ":", 2).alias("status")
    return _scored(spark, sf).select(*_score_list(), status)


@query
def scores_saved(spark, sf):
    scored = materialize(_scored(spark, sf).select("id", *merges.SCORE_COLUMNS), "scored")
    return merges.save_scores(dv.articles(spark, sf), scored).select(*_score_list())


@query
def scoring_counts(spark, sf):
    return counters.scoring_counts(_scored(spark, sf))


@query
def mean_event_seconds(spark, sf):
    timed = table(spark, sf, "events").select((F.col("value")).alias("seconds"))
    return counters.mean_seconds(timed).select(F.round("mean_seconds", 4).alias("mean_seconds"))


@query
def embedding_counts(spark, sf):
    return counters.embedding_counts(dv.articles(spark, sf))


@query
def filled_counts(spark, sf):
    return counters.filled_counts(dv.articles(spark, sf), ["embedding2", *sel.SCORE_COLUMNS])


def _taxonomy(spark, sf):
    """Sources as scopes and languages as topics, with their numbers of documents; no moods."""
    d = table(spark, sf, "documents")
    about = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" documents")).alias("description")
    scopes = d.groupBy("source").agg(about).selectExpr("'scope' AS dimension", "source AS tag", "description")
    topics = d.groupBy("lang").agg(about).selectExpr("'topic' AS dimension", "lang AS tag", "description")
    return scopes.unionByName(topics).withColumn("ord", F.col("tag"))


@query
def taxonomy_text(spark, sf):
    return format_taxonomy(_taxonomy(spark, sf))


@query
def scoring_prompts(spark, sf):
    a = sel.prepare_for_models(dv.articles(spark, sf))
    taxonomy = format_taxonomy(_taxonomy(spark, sf)).scalar()
    prompt = build_prompt(PROMPT, taxonomy, F.lit(PROFILE), F.col("combined"))
    return digest(a, "id", prompt=prompt)


def _embed(texts):
    """Stand-in for a model: length, blanks and letters e of each text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@query
def embedded_articles(spark, sf):
    todo = sel.prepare_for_models(dv.articles(spark, sf).where("embedding2 is null")).select("id", "combined", "embedding2")
    got = inference.embed_articles(todo, _embed, batch_size=64)
    part = lambda i, name: F.get("embedding2", F.lit(i)).cast("long").alias(name)
    return got.select("id", part(0, "length"), part(1, "blanks"), part(2, "es"))


def _complete(prompt):
    """Stand-in for a model: answers from the prompt's length and refuses some prompts."""
    if len(prompt) % 7 == 0:
        raise RuntimeError("refused")
    return f'{{"scope": ["UNKNOWN"], "topic": ["len"], "mood": ["calm"], "score": {len(prompt) % 21 - 10}}}'


@query
def articles_scored_by_model(spark, sf):
    todo = sel.prepare_for_models(dv.articles(spark, sf)).select("id", "agent", "score", "combined", *sel.SCORE_COLUMNS)
    got = inference.tag_and_score(todo, _complete, _taxonomy(spark, sf), PROFILE, PROMPT)
    return got.select(*_score_list(), "scoring_status")
