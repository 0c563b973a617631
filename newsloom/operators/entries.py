"""From raw feed entries to clean article rows.

Rejecting comes before de-duplication, so a rejected entry never claims a link; HTML is removed
after it, so an entry whose summary cannot be read still does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_published
from newsloom.functions.html import html_to_text, paragraphs_to_text
from newsloom.functions.text import strip_query
from newsloom.schema import conform_entries
from newsloom.session import broadcast_if_small, instant, materialize

# Fixed value: entries older than this many days are skipped.
MAX_AGE_DAYS = 5
FEED_ORDER = ("pub_ord", "url_ord", "entry_ord")
TOO_OLD, NO_DATE = "too_old", "no_date"


def _has(col: Column, part: str) -> Column:
    return F.coalesce(col.contains(part), F.lit(False))


def route(entry_id: Column, link: Column, wsj_articletype: Column) -> Column:
    """Which site rules an entry follows; the first match wins.

    Plain substrings decide, so ``blog.microsoft.com`` counts as ``ft.com``.
    """
    return (
        F.when(_has(entry_id, "news.ycombinator.com"), "hacker_news")
        .when(_has(link, "wsj.com") | _has(link, "ft.com") | wsj_articletype.isNotNull(), "wsj_ft")
        .when(_has(link, "guardian.") | _has(link, "nytimes.com"), "guardian_nyt")
        .otherwise("default")
    )


def is_fresh(published: Column, as_of: Column, max_age_days: int = MAX_AGE_DAYS) -> Column:
    """Published no earlier than ``max_age_days`` before ``as_of``; an equal second passes."""
    return published >= F.date_trunc("SECOND", as_of) - F.expr(f"interval {int(max_age_days)} days")


def normalize_entries(
    entries: DataFrame, as_of: datetime | Column, max_age_days: int = MAX_AGE_DAYS, only_fresh: bool = False
) -> DataFrame:
    """Apply the site rules; every entry comes out once, rejected ones with ``reject_reason``.

    ``only_fresh`` leaves stale and undated entries out altogether, by a filter the source can
    apply while reading.
    """
    at = as_of if isinstance(as_of, Column) else instant(as_of)
    raw = conform_entries(entries)
    fresh = is_fresh(F.col("published_parsed"), at, max_age_days)
    if only_fresh:
        raw = raw.where(fresh)
    e = (
        raw.withColumn("route", route(F.col("entry_id"), F.col("link"), F.col("wsj_articletype")))
        .withColumn("bare_link", strip_query(F.col("link")))
        .withColumn("on_nyt", _has(F.col("link"), "nytimes.com"))
    )
    is_route = lambda name: F.col("route") == name
    wants_paragraphs = (
        is_route("hacker_news") | is_route("default") | (is_route("guardian_nyt") & ~F.col("on_nyt"))
    )
    # Stale entries are dropped before their markup is looked at.
    e = (
        e.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
        .withColumn("markup", F.when(wants_paragraphs & F.col("fresh"), F.col("summary")))
        .withColumn("paragraphs", paragraphs_to_text(F.col("markup")))
    )

    on_ft = _has(F.col("bare_link"), "ft.com")
    on_wsj = _has(F.col("bare_link"), "wsj.com") | F.col("wsj_articletype").isNotNull()
    many_tags = F.coalesce(F.size("feed_tags") > 2, F.lit(False))
    reject = (
        F.when(F.col("published_parsed").isNull(), NO_DATE)
        .when(~F.col("fresh"), TOO_OLD)
        .when(~is_route("hacker_news") & F.col("link").isNull(), "no_link")
        .when(is_route("wsj_ft") & ~on_ft & ~on_wsj, "unexpected_link")
        .when(is_route("wsj_ft") & ~on_ft & many_tags, "too_many_tags")
        .when(F.col("markup").isNotNull() & F.col("paragraphs").isNull(), "bad_html")
        .when(F.col("title").isNull(), "no_title")
        .when(is_route("hacker_news") & F.col("comments").isNull(), "no_comments")
        .when(F.col("published").isNull(), "no_published")
    )
    link = (
        F.when(is_route("hacker_news"), F.col("comments"))
        .when(is_route("default"), F.col("link"))
        .otherwise(F.col("bare_link"))
    )
    summary = (
        F.when(is_route("wsj_ft") | (is_route("guardian_nyt") & F.col("on_nyt")), F.col("summary"))
        .when(
            is_route("hacker_news"),
            F.concat(F.lit("Points:"), F.substring_index("paragraphs", "Points:", -1)),
        )
        .otherwise(F.col("paragraphs"))
    )
    author = (
        F.when(is_route("wsj_ft"), F.lit(None))
        .when(is_route("guardian_nyt"), F.col("author"))
        .otherwise(F.coalesce("author", F.get("authors", F.lit(0))["name"]))
    )
    return e.select(
        *FEED_ORDER,
        "feed_url",
        "route",
        "title",
        link.alias("link"),
        summary.alias("summary"),
        F.array("feed_publication").alias("tags"),
        F.lit(None).cast("string").alias("media"),
        author.cast("string").alias("author"),
        F.col("feed_publication").alias("publication"),
        F.coalesce(parse_published(F.col("published")), "published_parsed").alias("published_at"),
        F.col("published_parsed").isNotNull().alias("has_date"),
        reject.alias("reject_reason"),
    )


def first_seen(entries: DataFrame) -> DataFrame:
    """One row per link: the first in feed order over all publications and feeds.

    ``rank = 1`` is pushed below the shuffle, so a link repeated in a large share of all rows
    sends one row per task.
    """
    by_link = Window.partitionBy("link").orderBy(*FEED_ORDER)
    return entries.withColumn("_rank", F.row_number().over(by_link)).where("_rank = 1").drop("_rank")


def clean_summaries(entries: DataFrame) -> DataFrame:
    """Plain-text summaries; ``''`` for a missing one, NULL where the markup cannot be read."""
    return entries.withColumn("summary", html_to_text(F.col("summary")))


def feeds_with_undated(normalized: DataFrame) -> DataFrame:
    """Per feed the position of its first entry without a date."""
    return (
        normalized.where(~F.col("has_date"))
        .groupBy("pub_ord", "url_ord")
        .agg(F.min("entry_ord").alias("first_undated"))
    )


def collect_entries(normalized: DataFrame, drop_feed_on_bad_date: bool = False) -> DataFrame:
    """Accepted, de-duplicated, plain-text entries.

    By default an entry without a date is rejected alone. With ``drop_feed_on_bad_date`` its whole
    feed is left out; links seen before that entry stay taken, later entries are never looked at.
    """
    accepted = normalized.where("reject_reason is null")
    if drop_feed_on_bad_date:
        undated, _ = broadcast_if_small(materialize(feeds_with_undated(normalized), "undated-feeds"))
        accepted = accepted.join(undated, ["pub_ord", "url_ord"], "left").where(
            "first_undated is null or entry_ord < first_undated"
        )
        kept = first_seen(accepted).where("first_undated is null").drop("first_undated")
    else:
        kept = first_seen(accepted)
    return clean_summaries(kept).where("summary is not null").drop("reject_reason", "has_date")


def split_by_publication(entries: DataFrame, publication: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one publication and all others, those without a publication among the latter."""
    same = F.col("publication").eqNullSafe(F.lit(publication))
    return entries.where(same), entries.where(~same)
