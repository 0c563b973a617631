"""Registered queries over landed feed documents, dates and the stream, each with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_published
from newsloom.operators import entries as en
from newsloom.plans import derived_views as dv
from newsloom.plans.derived_views import AS_OF, AS_OF_SQL, HACKER_NEWS, sql_with, table
from newsloom.plans.registered import land, query, time_text
from newsloom.plans.registered_sql import _N, ORACLE, _time
from newsloom.session import instant, materialize, scratch_path
from newsloom.sources import feeds
from newsloom.streaming.feed_stream import start_ingest
from newsloom.streaming.link_table import read_table

# --- damaged documents ------------------------------------------------------------------------

# Pages go to documents of 25 records, RSS and Atom by turns; every third one is cut off in its last record.
_PER_DOCUMENT = 25
_TITLES = {0: "C & D p", 1: "N&nbsp;p", 6: "<![CDATA[a <item> & b p", 7: "x &lt;b&gt; p"}


def _record_sql(atom: bool) -> str:
    """A page's record with the damage its number asks for."""
    tag = "entry" if atom else "item"
    title = "concat(CASE page_id % 12 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in _TITLES.items()) + " ELSE 'T p' END, page_id, CASE WHEN page_id % 12 = 6 THEN ']]>' ELSE '' END)"
    link = "concat('https://e.example.org/', page_id)"
    if atom:
        rest = f"""concat(CASE WHEN page_id % 12 = 4 THEN '<link href="' ELSE '<link rel="self" href="s"/><link rel="alternate" href="' END, {link}, '?a=1&amp;b=2"/>',
            '<id>p', page_id, '</id>', CASE WHEN page_id % 12 = 5 THEN '<content>' ELSE '<summary>' END, 'S', page_id,
            CASE WHEN page_id % 12 = 5 THEN '</content>' ELSE '</summary>' END)"""
    else:
        rest = f"""concat(CASE WHEN page_id % 12 = 4 THEN '<guid>https://e.example.org/p' ELSE concat('<link>', {link}, '</link><guid isPermaLink="false">p') END,
            page_id, '</guid>', CASE WHEN page_id % 12 = 5 THEN '<content:encoded><![CDATA[S' ELSE '<description>S' END, page_id,
            CASE WHEN page_id % 12 = 5 THEN ']]></content:encoded>' ELSE '</description>' END)"""
    return f"""CASE WHEN last AND document % 3 = 1 THEN concat('<{tag}><title>Cut p', page_id)
        WHEN page_id % 12 = 3 THEN concat('<{tag}><title>Bad p', page_id, '</link></{tag}>')
        WHEN page_id % 12 = 2 THEN concat('<{tag}><title>', {title}, '</title>', {rest}, chr(10))
        ELSE concat('<{tag}>', CASE WHEN page_id % 12 = 8 THEN '<!-- <{tag}> -->' ELSE '' END, '<title>', {title}, '</title>', {rest}, '</{tag}>', chr(10)) END"""


def _land_damaged(spark: SparkSession, sf: str) -> str:
    """Documents of bounded size, a file each, and for every fourth an error page in place of a feed."""
    pages = table(spark, sf, "pages").selectExpr("page_id", f"page_id DIV {_PER_DOCUMENT} AS document")
    last = pages.groupBy("document").agg(F.max("page_id").alias("_last"))
    numbered = pages.join(last, "document").withColumn("last", F.col("page_id") == F.col("_last"))
    records = numbered.select("document", "page_id", F.expr(f"CASE WHEN document % 2 = 1 THEN {_record_sql(True)} ELSE {_record_sql(False)} END").alias("record"))
    bodies = records.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "record"))), lambda x: x["record"]), "").alias("body"))
    feed = "CASE WHEN document % 2 = 1 THEN concat('<?xml version=\"1.0\"?><feed>', body, '</feed>') ELSE concat('<rss><channel><title>f</title>', body, '</channel></rss>') END"
    error = "'<html><body>Service unavailable</body></html>'"
    documents = bodies.selectExpr("document", f"explode(CASE WHEN document % 4 = 0 THEN array({feed}, {error}) ELSE array({feed}) END) AS value")
    root = scratch_path(spark, "damaged")
    keyed = documents.select(F.concat(F.lit("d"), "document").alias("feed_key"), "value")
    # thousands of folders but few bytes: all cores get some, and tasks put their files in place themselves, the driver would do it one by one;
    # nobody reads the folder before the write has ended
    writer = keyed.repartition(spark.sparkContext.defaultParallelism, "feed_key").write.option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("feed_key").text(root)
    return root


@query
def damaged_feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of broken RSS and Atom documents: an entry, a mended one, or why it is none."""
    records = materialize(feeds.read_feed_records(spark, _land_damaged(spark, sf)), "records")
    page = F.regexp_extract(F.coalesce("entry_id", "record", F.lit("")), r"p(\d+)", 1)
    return records.select(
        "feed_key", F.when(page != "", page.cast("long")).alias("page_id"),
        F.coalesce("damage", F.when(F.col("mended"), "mended").otherwise("sound")).alias("status"), "title", "link", "summary",
    )


_RECORDS = f"""numbered AS (SELECT page_id, page_id // {_PER_DOCUMENT} AS document,
      page_id = max(page_id) OVER (PARTITION BY page_id // {_PER_DOCUMENT}) AS last FROM pages),
    status AS (SELECT *, CASE WHEN last AND document % 3 = 1 THEN 'unclosed' WHEN page_id % 12 = 3 THEN 'malformed'
      WHEN page_id % 12 IN (0, 1, 2) THEN 'mended' ELSE 'sound' END AS status FROM numbered)"""
ORACLE["damaged_feed_files"] = f"""WITH {_RECORDS} SELECT concat('d', document) AS feed_key, page_id, status,
    CASE WHEN status IN ('unclosed', 'malformed') THEN NULL ELSE concat(CASE page_id % 12 WHEN 0 THEN 'C & D p' WHEN 1 THEN 'N&nbsp;p'
      WHEN 6 THEN 'a <item> & b p' WHEN 7 THEN 'x <b> p' ELSE 'T p' END, page_id) END AS title,
    CASE WHEN status IN ('unclosed', 'malformed') THEN NULL WHEN document % 2 = 1 THEN concat('https://e.example.org/', page_id, '?a=1&b=2')
      WHEN page_id % 12 = 4 THEN concat('https://e.example.org/p', page_id) ELSE concat('https://e.example.org/', page_id) END AS link,
    CASE WHEN status IN ('unclosed', 'malformed') THEN NULL ELSE concat('S', page_id) END AS summary FROM status
  UNION ALL SELECT concat('d', document), NULL, 'no_entries', NULL, NULL, NULL FROM (SELECT DISTINCT document FROM numbered) WHERE document % 4 = 0"""

# --- dates ------------------------------------------------------------------------------------

_MOMENT = f"{AS_OF_SQL} - make_dt_interval(cast(page_id % 10 AS int), 0, 0, cast(page_id * 7 % 86400 AS int))"
# Forms a feed writes dates in, by page_id % 16: pattern, hours the text is ahead of UTC, what follows.
_FORMS = {
    0: ("EEE, dd MMM yyyy HH:mm:ss", 0, " GMT"), 1: ("EEE, dd MMM yyyy HH:mm", 0, " GMT"), 2: ("EEE, dd MMM yy HH:mm:ss", 0, " UT"),
    3: ("dd MMMM yyyy HH:mm:ss", 1, " +0100"), 4: ("dd MMM yyyy HH:mm:ss", 0, ""), 5: ("EEE MMM d HH:mm:ss yyyy", 0, ""),
    6: ("EEE, dd MMM yyyy HH:mm:ss", -4, " EDT"), 7: ("yyyy-MM-dd'T'HH:mm:ss", 0, "Z"), 8: ("yyyy-MM-dd'T'HH:mm:ss", 5, "+05:00"),
    9: ("yyyy-MM-dd", 0, ""), 11: ("MMM d, yyyy HH:mm:ss", -8, " PST"), 12: ("EEE, dd-MMM-yyyy HH:mm:ss", 0, " GMT"),
    13: ("yyyy-MM-dd HH:mm:ss", 0, ".000 GMT+0"), 14: ("yyyyMMdd", 0, ""),
}


def _with_forms(spark: SparkSession, sf: str) -> DataFrame:
    forms = " ".join(
        f"""WHEN {k} THEN concat(date_format({_MOMENT} + INTERVAL {h} HOURS, "{p}"), '{after}')""" for k, (p, h, after) in _FORMS.items()
    )
    texts = table(spark, sf, "pages").selectExpr("page_id AS entry_ord", f"CASE page_id % 16 {forms} WHEN 10 THEN 'yesterday' END AS published")
    return dv.entries(spark, sf).drop("published", "published_parsed").join(texts, "entry_ord").withColumn("published_parsed", parse_published(F.col("published")))


@query
def published_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Dates in all their forms; entries whose date cannot be read are rejects."""
    return en.normalize_entries(_with_forms(spark, sf), AS_OF).select("entry_ord", time_text("published_at", "published_at"), "reject_reason")


_MOMENT_SQL = f"{AS_OF_SQL} - to_seconds(page_id % 10 * 86400 + page_id * 7 % 86400)"
_DATED = f"""dated AS (SELECT page_id AS entry_ord, CASE WHEN page_id % 16 IN (10, 15) THEN NULL WHEN page_id % 16 IN (9, 14) THEN date_trunc('day', {_MOMENT_SQL})
    WHEN page_id % 16 = 1 THEN date_trunc('minute', {_MOMENT_SQL}) ELSE {_MOMENT_SQL} END AS moment FROM pages)"""
ORACLE["published_forms"] = f"""WITH {_DATED} SELECT entry_ord, {_time('moment', 'published_at')},
    CASE WHEN moment IS NULL THEN 'no_date' WHEN moment < {AS_OF_SQL} - INTERVAL '5 days' THEN 'too_old'
      WHEN entry_ord % 23 = 0 THEN 'no_title' END AS reject_reason FROM dated"""

# --- reasons and authors ----------------------------------------------------------------------


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh entries, each with one fault or none by ``entry_ord % 11``."""
    k, null = F.col("entry_ord") % 11, F.lit(None).cast("string")
    plain = dv.entries(spark, sf).withColumns(
        {"title": F.lit("T"), "published_parsed": instant(AS_OF), "entry_id": F.lit("urn:x"), "summary": F.lit("<p>s</p>"), "link": F.lit("https://e.org/1"),
         "wsj_articletype": null}
    )
    return plain.withColumns(
        {
            "published_parsed": F.when(k == 0, F.lit(None)).when(k == 1, instant(AS_OF) - F.expr("interval 6 days")).otherwise(F.col("published_parsed")),
            "link": F.when(k == 2, null).when(k == 3, "https://e.org/x?ref=ft.com").when(k == 4, "https://www.wsj.com/a").otherwise(F.col("link")),
            "feed_tags": F.when(k == 4, F.array(*[F.lit(t) for t in "abc"])),
            "summary": F.when(k == 5, "<![what[x]]><p>a").otherwise(F.col("summary")),
            "title": F.when(k == 6, null).otherwise(F.col("title")),
            "entry_id": F.when(k == 7, "https://news.ycombinator.com/item/1").otherwise(F.col("entry_id")),
            "comments": F.when(k == 7, null).otherwise(F.col("comments")),
            "published": F.when(k == 8, null).otherwise(F.col("published")),
        }
    )


@query
def rejected_for_every_reason(spark: SparkSession, sf: str) -> DataFrame:
    return en.normalize_entries(_faulty(spark, sf), AS_OF).select("entry_ord", F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))


_REASONS = ["no_date", "too_old", "no_link", "unexpected_link", "too_many_tags", "bad_html", "no_title", "no_comments", "no_published"]
ORACLE["rejected_for_every_reason"] = (
    "SELECT page_id AS entry_ord, CASE page_id % 11 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS)) + " ELSE 'accepted' END AS reason FROM pages"
)


@query
def entry_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Authors of entries that give one, a list, both or none."""
    k = F.col("entry_ord") % 4
    listed = F.array(F.struct(F.concat(F.lit("listed-"), F.col("entry_ord")).alias("name")), F.struct(F.lit("second").alias("name")))
    given = dv.entries(spark, sf).withColumns(
        {"author": F.when(k < 2, F.concat(F.lit("author-"), F.col("entry_ord"))), "authors": F.when(k.isin(0, 2), listed)}
    )
    return en.normalize_entries(given, AS_OF).select("entry_ord", "route", "author")


ORACLE["entry_authors"] = (
    _N + """SELECT entry_ord, route, CASE WHEN route = 'wsj_ft' THEN NULL WHEN entry_ord % 4 < 2 THEN concat('author-', entry_ord)
      WHEN entry_ord % 4 = 2 AND route <> 'guardian_nyt' THEN concat('listed-', entry_ord) END AS author FROM routed"""
)

# --- stream -----------------------------------------------------------------------------------


def _shown(articles: DataFrame) -> DataFrame:
    return articles.select("link", "title", "summary", "publication", time_text("created_at", "created_at"))


@query
def streamed_entries(spark: SparkSession, sf: str) -> DataFrame:
    root, known = land(spark, dv.entries(spark, sf))
    out = scratch_path(spark, "streamed")
    start_ingest(spark, root, known, out, scratch_path(spark, "stream-state"), AS_OF).awaitTermination()
    return _shown(read_table(spark, out))


_STREAMED = f"{_time(AS_OF_SQL, 'created_at')} FROM collected"
ORACLE["streamed_entries"] = _N + f"SELECT link, title, summary, publication, {_STREAMED}"


@query
def streamed_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs; in the second every title is new, and known links of one publication take it on."""
    first, known = land(spark, dv.entries(spark, sf))
    again = dv.entries(spark, sf).withColumn("title", F.concat("title", F.lit(" again")))
    second, _ = land(spark, again.where("link not like 'https://www.nytimes.com%' or entry_ord % 2 = 0"))
    out = scratch_path(spark, "streamed")
    for root in (first, second):
        state = scratch_path(spark, "stream-state")
        start_ingest(spark, root, known, out, state, AS_OF, updating_publication=HACKER_NEWS).awaitTermination()
    return _shown(read_table(spark, out))


# which entry claims a link in the second run; only those of the publication refresh
ORACLE["streamed_refresh"] = (
    _N + f""", second AS (SELECT link, concat(title, ' again') AS title, coalesce(summary, '') AS summary, publication FROM accepted
      WHERE entry_ord NOT IN (SELECT entry_ord FROM entry WHERE link LIKE 'https://www.nytimes.com%' AND entry_ord % 2 <> 0)
      QUALIFY row_number() OVER (PARTITION BY link ORDER BY pub_ord, url_ord, entry_ord) = 1)
    SELECT c.link, coalesce(s.title, c.title) AS title, coalesce(s.summary, c.summary) AS summary, c.publication, {_time(AS_OF_SQL, 'created_at')}
    FROM collected c LEFT JOIN (SELECT * FROM second WHERE publication = '{HACKER_NEWS}') s ON c.link = s.link"""
)
