from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import values
from newsloom.operators import counters, entries as en
from newsloom.plans import ingest
from newsloom.schema import ENTRY
from newsloom.session import materialize

AS_OF = datetime(2024, 1, 31, 12, 0, 0, 500_000)


def make(spark, *rows):
    base = dict(
        feed_publication="Pub", feed_url="u", pub_ord=0, url_ord=0, entry_ord=0, entry_id="urn:x", title="T",
        link="https://example.org/1", comments=None, summary=None, published="Wed, 31 Jan 2024 10:00:00 GMT",
        published_parsed=AS_OF, author=None, authors=None, feed_tags=None, wsj_articletype=None,
    )
    return spark.createDataFrame([Row(**{**base, "entry_ord": i, **r}) for i, r in enumerate(rows)], ENTRY)


def one(spark, **row):
    return en.normalize_entries(make(spark, row), AS_OF).collect()[0]


@pytest.mark.parametrize(
    "row, route",
    [
        (dict(entry_id="https://news.ycombinator.com/item?id=1", link="https://www.ft.com/x"), "hacker_news"),
        (dict(link="https://www.wsj.com/a"), "wsj_ft"),
        (dict(link="https://blog.microsoft.com/p"), "wsj_ft"),
        (dict(link="https://example.org/", wsj_articletype="x"), "wsj_ft"),
        (dict(link="https://www.theguardian.com/w"), "guardian_nyt"),
        (dict(link="https://www.nytimes.com/w"), "guardian_nyt"),
        (dict(link="https://example.org/w", entry_id=None), "default"),
    ],
)
def test_router(spark, row, route):
    assert one(spark, **row)["route"] == route


@pytest.mark.parametrize(
    "row, reason",
    [
        (dict(published_parsed=None), "no_date"),
        (dict(published_parsed=AS_OF - timedelta(days=6)), "too_old"),
        (dict(published_parsed=datetime(2024, 1, 26, 12, 0, 0)), None),
        (dict(published_parsed=datetime(2024, 1, 26, 11, 59, 59)), "too_old"),
        (dict(title=None), "no_title"),
        (dict(published=None), "no_published"),
        (dict(link=None), "no_link"),
        (dict(link="https://a.org/x?ref=ft.com"), "unexpected_link"),
        (dict(link="https://www.wsj.com/a", feed_tags=["a", "b", "c"]), "too_many_tags"),
        (dict(link="https://www.ft.com/a", feed_tags=["a", "b", "c"]), None),
        (dict(link="https://www.wsj.com/a", feed_tags=["a", "b"]), None),
        (dict(entry_id="news.ycombinator.com", comments=None), "no_comments"),
        (dict(summary="<![what[x]]><p>a"), "bad_html"),
    ],
)
def test_rejects(spark, row, reason):
    assert one(spark, **row)["reject_reason"] == reason


def test_wsj_and_ft_rows(spark):
    got = one(spark, link="https://www.ft.com/c/1;p?x", summary="<p>raw</p>", author="A")
    assert (got["link"], got["summary"], got["author"]) == ("https://www.ft.com/c/1", "<p>raw</p>", None)


def test_guardian_and_nyt_rows(spark):
    guardian = one(spark, link="https://www.theguardian.com/w?x", summary="<p>a</p><p>b</p>", authors=[("N",)])
    assert (guardian["link"], guardian["summary"], guardian["author"]) == ("https://www.theguardian.com/w", "a. b", None)
    # the unstripped link decides, New York Times first
    nyt = one(spark, link="https://www.theguardian.com/w?nytimes.com", summary="<p>a</p>", author="A")
    assert (nyt["link"], nyt["summary"], nyt["author"]) == ("https://www.theguardian.com/w", "<p>a</p>", "A")


def test_hacker_news_rows(spark):
    hn = dict(entry_id="news.ycombinator.com/1", comments="https://c?id=1")
    got = one(spark, **hn, summary="<p>Link</p><p>Points: 3</p><p># Points: 7</p>", authors=[("N",)])
    assert (got["link"], got["summary"], got["author"]) == ("https://c?id=1", "Points: 7", "N")
    assert one(spark, **hn, summary="no mark")["summary"] == "Points:no mark"
    assert one(spark, **hn)["summary"] is None


def test_default_rows(spark):
    got = one(spark, link="https://e.org/1?x#y", summary="a <b>b</b>", author=None, authors=[("N",), ("M",)])
    assert (got["link"], got["summary"], got["author"]) == ("https://e.org/1?x#y", "a <b>b</b>", "N")
    assert (got["tags"], got["publication"], got["media"]) == (["Pub"], "Pub", None)


def test_first_seen_order_and_rejects_do_not_claim(spark):
    raw = make(
        spark,
        dict(pub_ord=1, link="https://e.org/a"),
        dict(pub_ord=0, url_ord=1, link="https://e.org/a"),
        dict(pub_ord=0, url_ord=0, link="https://e.org/a", title=None),
        dict(pub_ord=2, link="https://e.org/b", summary="x &amp; <i>y</i>"),
        dict(pub_ord=3, link="https://e.org/b"),
    )
    got = sorted(values(ingest.collect(raw, AS_OF), "entry_ord", "summary"))
    assert got == [(1, ""), (3, "x & y")]


def test_unreadable_summary_claims_its_link(spark):
    bad = "x <![what[x]]>"
    raw = make(
        spark,
        dict(link="https://www.ft.com/a", summary=bad, feed_url="f1"),
        dict(link="https://www.ft.com/a?again", feed_url="f2"),
    )
    normalized = en.normalize_entries(raw, AS_OF)
    assert values(en.collect_entries(normalized)) == []
    assert sorted(values(counters.feed_counts(normalized))) == [("f1", 0, 0, 0, 1), ("f2", 0, 1, 0, 0)]


def test_undated_entry_can_end_its_feed(spark):
    raw = make(
        spark,
        dict(url_ord=0, link="https://e.org/a"),
        dict(url_ord=0, link="https://e.org/x", published_parsed=None),
        dict(url_ord=0, link="https://e.org/c"),
        dict(url_ord=1, link="https://e.org/a"),
        dict(url_ord=1, link="https://e.org/c"),
    )
    assert sorted(values(ingest.collect(raw, AS_OF), "entry_ord")) == [(0,), (2,)]
    # links before the undated entry stay taken, those after it were never seen
    assert values(ingest.collect(raw, AS_OF, drop_feed_on_bad_date=True), "entry_ord") == [(4,)]


def test_split_puts_missing_publication_with_the_others(spark):
    df = spark.createDataFrame([("a", "HN"), ("b", None), ("c", "X")], "link string, publication string")
    same, others = en.split_by_publication(df, "HN")
    assert values(same, "link") == [("a",)]
    assert sorted(values(others, "link")) == [("b",), ("c",)]


def test_a_link_shared_by_a_third_of_all_rows(spark):
    rows = spark.range(30_000).select(
        F.lit(0).alias("pub_ord"), F.lit(0).alias("url_ord"), F.col("id").alias("entry_ord"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"),
    )
    got = en.first_seen(rows)
    assert got.count() == 20_001
    assert values(got.where("link = 'hot'"), "entry_ord") == [(0,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_feed_counts_scan_the_entries_once(spark):
    stored = materialize(en.normalize_entries(make(spark, {}, dict(link="https://e.org/2")), AS_OF), "normalized")
    plan = counters.feed_counts(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_feed_counts_with_a_third_of_all_rows_on_one_link(spark):
    rows = spark.range(9000).select(
        F.lit(0).alias("pub_ord"), F.lit(0).alias("url_ord"), F.col("id").alias("entry_ord"), F.lit(None).cast("string").alias("reject_reason"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"), F.lit("s").alias("summary"),
        F.concat(F.lit("f"), F.col("id") % 2).alias("feed_url"),
    )
    assert sorted(values(counters.feed_counts(rows))) == [("f0", 3001, 1499, 0, 0), ("f1", 3000, 1500, 0, 0)]
