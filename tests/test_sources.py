from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from newsloom.operators import counters, selection
from newsloom.plans import derived_views, enrich, ingest, jobs
from newsloom.schema import ARTICLE, conform
from newsloom.session import materialize, scratch_path
from newsloom.sources import feeds, publications, tables
from newsloom.streaming import feed_stream, link_table
from newsloom.streaming.feed_stream import start_ingest

AS_OF = datetime(2024, 1, 31)
RSS = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:wsj="http://dowjones.net/rss/">
<channel><title>Feed</title>{items}</channel></rss>"""
ITEM = """<item><title>{title}</title><link>https://e.org/{link}</link><guid isPermaLink="false">g{link}</guid>
<description><![CDATA[<p>one &amp; two</p>]]></description><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate>
<dc:creator>Ann</dc:creator><category>a</category><category>b</category></item>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">Atom &amp;amp; x</title><id>urn:1</id>
<link rel="self" href="https://e.org/self"/><link rel="alternate" href="https://e.org/atom"/><summary>s</summary>
<published>2024-01-30T10:00:00Z</published><author><name>Bob</name></author><category term="t"/></entry></feed>"""

CONFIG = "publication string, urls array<string>, enabled boolean, pub_ord int"


@pytest.fixture(scope="module")
def config(spark):
    return spark.createDataFrame([("P", ["u1", "u2"], True, 0), ("Q", ["u3"], False, 1), ("R", ["u4"], True, 2)], CONFIG)


def land(spark, root, files):
    """Write the files through Spark's text sink, one folder per feed."""
    for url, name, text in files:
        rows = spark.createDataFrame([(text, url)], "value string, url string")
        rows = rows.withColumn("feed_key", publications.feed_key(F.col("url"))).drop("url").coalesce(1)
        rows.write.mode("append").partitionBy("feed_key").text(root)


def items(*pairs):
    return RSS.format(items="".join(ITEM.format(title=t, link=n) for t, n in pairs))


def test_publication_feeds(spark, config):
    got = sorted(values(publications.publication_feeds(config), "feed_publication", "url_ord", "feed_url"))
    assert got == [("P", 0, "u1"), ("P", 1, "u2"), ("R", 0, "u4")]
    assert values(counters.configuration_counts(config)) == [(3, 2, 3)]
    broken = config.withColumn("enabled", F.lit(None).cast("boolean"))
    with pytest.raises(PySparkException, match="without enabled flag"):
        publications.enabled_publications(broken).collect()


def test_feed_files(spark, config):
    root = scratch_path(spark, "feeds")
    land(spark, root, [("u1", "a", items(("A", 1), ("B", 2))), ("u2", "a", ATOM), ("u3", "a", items(("off", 9))), ("u4", "a", "<rss><broken")])
    got = feeds.read_feed_files(spark, root, publications.publication_feeds(config)).orderBy("pub_ord", "url_ord", "entry_ord").collect()
    assert [(r["feed_publication"], r["title"], r["link"], r["author"]) for r in got] == [
        ("P", "A", "https://e.org/1", "Ann"),
        ("P", "B", "https://e.org/2", "Ann"),
        ("P", "Atom &amp; x", "https://e.org/atom", "Bob"),
    ]
    first, atom = got[0], got[2]
    assert (first["entry_id"], first["summary"], first["feed_tags"]) == ("g1", "<p>one &amp; two</p>", ["a", "b"])
    assert first["published_parsed"] == datetime(2024, 1, 30, 10) == atom["published_parsed"]
    assert (atom["entry_id"], atom["summary"], atom["feed_tags"]) == ("urn:1", "s", ["t"])
    known = publications.publication_feeds(config)
    assert feeds.read_feed_files(spark, root, known, files="*.atom").count() == 0
    entries, damaged = feeds.read_feed_output(spark, root, known)
    assert entries.count() == 3 and values(damaged, "damage") == [("no_entries",)]


def test_ingest_files_into_a_table(spark, config):
    root = scratch_path(spark, "feeds")
    land(spark, root, [("u1", "a", items(("New", 1), ("Seen", 2))), ("u4", "a", items(("Again", 1), ("More", 3)))])
    known = conform(spark.createDataFrame([(7, "https://e.org/2", "old", "s"), (8, "https://e.org/x", "old", "s")],
                                          "id long, link string, title string, summary string"), ARTICLE)
    got = ingest.ingest_files(spark, known, root, config, AS_OF, "P")
    assert sorted(values(got, "link", "title", "summary", "publication"), key=str) == [
        ("https://e.org/1", "New", "one & two", "P"),
        ("https://e.org/2", "Seen", "one & two", None),
        ("https://e.org/3", "More", "one & two", "R"),
        ("https://e.org/x", "old", "s", None),
    ]
    assert sorted(i for (i,) in values(got, "id")) == [7, 8, 9, 10]


def test_stream_equals_batch_and_runs_again(spark, config):
    root, table, state = (scratch_path(spark, n) for n in ("landing", "table", "state"))
    known = materialize(publications.publication_feeds(config), "feeds")
    land(spark, root, [("u1", "a", items(("A", 1), ("B", 2))), ("u4", "a", items(("C", 2), ("D", 3)))])
    start_ingest(spark, root, known, table, state, AS_OF, buckets=4).awaitTermination()
    batch = ingest.collect(feeds.read_feed_files(spark, root, known), AS_OF)
    columns = ["link", "title", "summary", "author", "publication", "published_at"]
    assert sorted(values(link_table.read_table(spark, table), *columns)) == sorted(values(batch, *columns))
    land(spark, root, [("u2", "b", items(("E", 4), ("A2", 1))), ("u4", "b", ATOM)])
    start_ingest(spark, root, known, table, state, AS_OF).awaitTermination()
    # the same files under a new checkpoint: everything is known already
    start_ingest(spark, root, known, table, scratch_path(spark, "state"), AS_OF).awaitTermination()
    got = sorted(values(link_table.read_table(spark, table), "link", "title", "id"))
    assert [g[:2] for g in got] == [(f"https://e.org/{i}", t) for i, t in ((1, "A"), (2, "B"), (3, "D"), (4, "E"))] + [
        ("https://e.org/atom", "Atom &amp; x")
    ]
    assert len({g[2] for g in got}) == 5


def test_enrichment_end_to_end(spark, sf_dir):
    articles = materialize(conform(derived_views.articles(spark, sf_dir), ARTICLE), "articles")
    recent = selection.recent(articles, derived_views.AS_OF, ["embedding2"]).count()
    embedded = enrich.add_embeddings(articles, derived_views.AS_OF, lambda texts: [[float(len(t))] for t in texts])
    added = embedded.where("size(embedding2) = 1").count()
    assert added == recent > 0 and embedded.count() == articles.count()
    taxonomy = spark.createDataFrame([("scope", 1, "s", "d")], "dimension string, ord int, tag string, description string")
    scored = enrich.add_scores(articles, derived_views.AS_OF, lambda p: '{"score": 4}', taxonomy, "{}", "{article}", max_articles=5)
    assert values(scored.where("ai_score2 is not null").agg(F.count("*"), F.max("ai_score2"))) == [(5, 4)]
    ruled = enrich.add_rule_results(articles, derived_views.tags(spark), derived_views.AS_OF)
    assert ruled.where("agent is null").count() == 0
    assert ruled.where("updated_at is not null").count() == articles.where("agent is null").count()


def test_recent_articles_use_a_bounded_sort_and_pushed_filters(spark, sf_dir):
    articles = materialize(conform(derived_views.articles(spark, sf_dir), ARTICLE), "articles")
    plan = selection.recent(articles, derived_views.AS_OF, ["embedding2"]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(created_at" in plan and "IsNull(embedding2)" in plan


def test_damage_stays_where_it_is(spark):
    rss = """<?xml version="1.0" encoding="{encoding}"?><rss><channel><title>caf\xe9</title>{items}</channel></rss>"""
    broken = rss.format(encoding="UTF-8", items="""<item><title>C & D</title><link>https://e/1</link></item>
        <item><title>G</title><guid>https://e/2</guid><content:encoded><![CDATA[<item> & </item>]]></content:encoded></item>
        <item><title>N&nbsp;x</title><guid isPermaLink="false">g</guid>
        <item><title>Bad</link></title></item><!-- <item><title>no</title></item> -->
        <item><title>Cut""").encode()
    files = {
        "a": broken,
        "b": rss.format(encoding="ISO-8859-1", items="<item><title>caf\xe9</title></item>").encode("latin-1"),
        "c": b"<rss><item><title>x\xff\x01y</title></item><item/></rss>",
        "d": rss.format(encoding="UTF-16", items="<item><title>caf\xe9</title></item>").encode("utf-16"),
        "e": b"<html>gone</html>",
        "f": b" ",
        "g": None,
    }
    documents = spark.createDataFrame([("k", n, c and bytearray(c)) for n, c in files.items()], "feed_key string, file string, content binary")
    rows = sorted(values(feeds.feed_records(documents), "entry_ord.file", "entry_ord.place", "title", "link", "summary", "damage", "mended"), key=str)
    assert rows == [
        ("a", 0, "C & D", "https://e/1", None, None, True),
        ("a", 1, "G", "https://e/2", "<item> & </item>", None, False),
        ("a", 2, "N&nbsp;x", None, None, None, True),
        ("a", 3, None, None, None, "malformed", False),
        ("a", 4, None, None, None, "unclosed", False),
        ("b", 0, "caf\xe9", None, None, None, False),
        ("c", 0, "x\ufffdy", None, None, None, True),
        ("c", 1, None, None, None, None, False),
        ("d", 0, "caf\xe9", None, None, None, False),
        ("e", 0, None, None, None, "no_entries", False),
        ("f", 0, None, None, None, "unreadable", False),
        ("g", 0, None, None, None, "unreadable", False),
    ]
    records = feeds.feed_records(documents)
    assert [r for (r,) in values(records.where("damage = 'unclosed'"), "record")] == ["<item><title>Cut</channel></rss>"]
    assert feeds.feed_records(documents.limit(0)).count() == 0


def test_each_file_is_read_once(spark, config):
    root = scratch_path(spark, "feeds")
    land(spark, root, [("u1", "a", items(("A", 1))), ("u2", "a", ATOM)])
    plan = feeds.read_feed_files(spark, root, publications.publication_feeds(config))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") + plan.count("BinaryFile") == 1 or plan.count("FileScan binaryFile") == 1


def test_a_batch_reads_only_the_buckets_it_touches(spark):
    table = scratch_path(spark, "bucketed")
    frame = lambda *links: spark.createDataFrame([(link, f"t {link}", "s", "P") for link in links], "link string, title string, summary string, publication string")
    link_table.merge_entries(spark, table, frame(*[f"l{i}" for i in range(40)]), AS_OF, buckets=8)
    link_table.merge_entries(spark, table, frame("l1", "n1", "n2"), AS_OF, updating="P", buckets=99)
    got = link_table.read_table(spark, table)
    assert got.count() == 42 and sorted(v for (v,) in values(got, "id")) == list(range(1, 43))
    plan = link_table.stored_rows(spark, table, [1, 3]).select("link")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [link_bucket" in plan and "ReadSchema: struct<link:string>" in plan
    assert {r for (r,) in values(link_table.stored_rows(spark, table).select("link_bucket").distinct())} <= set(range(8))
    # a later title lies over the row, one of another publication doesn't
    later = frame("l2", "l3").withColumn("title", F.lit("later")).withColumn("publication", F.when(F.col("link") == "l2", "P").otherwise("Q"))
    link_table.merge_entries(spark, table, later, AS_OF, updating="P")
    assert sorted(values(link_table.read_table(spark, table).where("link in ('l2', 'l3')"), "link", "title")) == [("l2", "later"), ("l3", "t l3")]


def test_ids_are_reserved_once(spark):
    table = scratch_path(spark, "ids")
    assert [link_table.reserve_ids(spark, table, n) for n in (5, 1, 10)] == [1, 6, 7]
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda _: link_table.reserve_ids(spark, table, 3), range(8)))
    assert sorted(firsts) == list(range(17, 17 + 24, 3))


def test_damaged_records_of_the_stream_and_its_own_clock(spark, config):
    root, table, rejects = (scratch_path(spark, n) for n in ("landing", "table", "rejects"))
    known = materialize(publications.publication_feeds(config), "feeds")
    land(spark, root, [("u1", "a", "<rss><item><title>Bad</link></title></item></rss>")])
    start_ingest(spark, root, known, table, scratch_path(spark, "state"), rejects=rejects).awaitTermination()
    assert values(spark.read.parquet(rejects), "place", "damage") == [(0, "malformed")]
    batch = spark.createDataFrame([(AS_OF,)], "read_at timestamp")
    assert feed_stream._batch_time(batch).replace(tzinfo=None) == AS_OF
    assert feed_stream._batch_time(batch.limit(0)) is None


def test_jobs_commit(spark, config):
    root, base, rejects = (scratch_path(spark, n) for n in ("feeds", "table", "rejects"))
    land(spark, root, [("u1", "a", items(("New", 1))), ("u4", "a", "<rss><item><title>Bad</link></title></item></rss>")])
    tables.write_version(spark.createDataFrame([], ARTICLE), base)
    assert jobs.ingest_job(spark, base, root, config, AS_OF, "P", rejects) == 2
    assert values(jobs.current(spark, base), "link", "title") == [("https://e.org/1", "New")]
    assert values(jobs.current(spark, rejects), "damage") == [("malformed",)]


def test_damaged_documents_are_landed_by_all_cores(spark, tmp_path):
    from newsloom.plans import registered_feeds

    spark.range(2000).selectExpr("id AS page_id", "'u' AS url", "'h' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    root = registered_feeds._land_damaged(spark, str(tmp_path))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(root)
    parts = files.selectExpr("regexp_extract(path, 'part-([0-9]+)', 1) AS task", "feed_key").collect()
    assert len(parts) == 80 + 20 and len({r["feed_key"] for r in parts}) == 80
    assert len({r["task"] for r in parts}) > 4
