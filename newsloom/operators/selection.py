"""Which articles a step works on, and the text prepared for models."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import instant
from newsloom.functions.text import combined_text, has_bad_content, plain_line, short_summary, short_title

# Defaults of the recent-article selection and the agent set by people.
MAX_RECENT_ARTICLES = 200
RECENT_HOURS = 24
USER = "USER"
SCORE_COLUMNS = ("ai_score2", "tags_topic", "tags_mood", "tags_scope")


def with_nulls_in(articles: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return articles
    return articles.where(reduce(and_, [F.col(c).isNull() for c in columns]))


def created_since(articles: DataFrame, as_of: datetime, hours: int = RECENT_HOURS) -> DataFrame:
    return articles.where(F.col("created_at") >= instant(as_of) - F.expr(f"interval {int(hours)} hours"))


def recent(
    articles: DataFrame,
    as_of: datetime,
    null_columns: list[str] | None = None,
    hours: int = RECENT_HOURS,
    max_articles: int = MAX_RECENT_ARTICLES,
) -> DataFrame:
    """Newest articles of the last ``hours`` with NULL in ``null_columns``; ties by id."""
    rows = created_since(with_nulls_in(articles, null_columns or []), as_of, hours)
    return rows.orderBy(F.col("created_at").desc(), F.col("id")).limit(max_articles)


def recent_for_models(articles: DataFrame, as_of: datetime, null_columns: list[str] | None = None, **limits) -> DataFrame:
    return prepare_for_models(recent(articles, as_of, null_columns, **limits))


def unprocessed(articles: DataFrame) -> DataFrame:
    return articles.where("agent is null")


def rescorable(articles: DataFrame) -> DataFrame:
    """Not set by a person and not negative; an article without agent is left out as well."""
    return articles.where((F.col("agent") != USER) & (F.col("score") >= 0))


def classified_without_embedding(articles: DataFrame) -> DataFrame:
    return prepare_for_models(articles.where((F.col("agent") == USER) & F.col("embedding2").isNull()))


def training_set(articles: DataFrame) -> DataFrame:
    return articles.where((F.col("agent") == USER) & F.col("embedding2").isNotNull())


def with_short_texts(articles: DataFrame) -> DataFrame:
    """Add title_short and summary_short. The markup is read once, in a step of its own."""
    c = F.col
    return (
        articles.withColumns({"_title": plain_line(c("title")), "_summary": plain_line(c("summary"))})
        .withColumns({"title_short": short_title(c("_title")), "summary_short": short_summary(c("_summary"))})
        .drop("_title", "_summary")
    )


def prepare_for_models(articles: DataFrame, use_short: bool = False) -> DataFrame:
    """Add title_short, summary_short, has_bad_content and combined; drop rows without text.

    ``use_short`` combines the shortened title and summary in place of the full ones.
    """
    c, suffix = F.col, "_short" if use_short else ""
    return (
        with_short_texts(articles)
        .withColumns(
            {
                "has_bad_content": has_bad_content(c("title_short"), c("summary_short")),
                "combined": combined_text(c("publication"), c(f"title{suffix}"), c(f"summary{suffix}"), c("author")),
            }
        )
        .where("combined is not null")
    )


def first_rows(articles: DataFrame, count: int | None) -> DataFrame:
    return articles if count is None else articles.orderBy("id").limit(count)


def require_empty(articles: DataFrame, columns: tuple[str, ...] | list[str]) -> None:
    """Raise ``ValueError`` when one of the columns already holds values; one aggregate pass."""
    counts = articles.agg(*[F.count(c).alias(c) for c in columns]).first()
    filled = {c: counts[c] for c in columns if counts[c]}
    if filled:
        found = ", ".join(f"{n} values in {c}" for c, n in filled.items())
        raise ValueError(f"already have {found}; set them to null to recompute")


def update_records(articles: DataFrame) -> DataFrame:
    return articles.select("id", "agent", "score", "ai_score")
