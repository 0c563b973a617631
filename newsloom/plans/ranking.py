"""Rank recent articles by the scores of their nearest neighbours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.neighbors import nearest_neighbors, neighbor_scores, rank_by_neighbors
from newsloom.session import instant, materialize


def top_results(
    articles: DataFrame,
    as_of: datetime,
    k: int = 10,
    per_article: bool = False,
    recent_days: int = 2,
    user_agent: str = "user",
    **options,
) -> DataFrame:
    """Neighbours, their mean score, and the article rows they belong to.

    Only recent articles can carry a score, so only those are read for the final join.
    """
    pairs = nearest_neighbors(articles, as_of, k=k, per_article=per_article, recent_days=recent_days, **options)
    # stored, because the scan behind them may outlast the time limit of a broadcast
    pairs = materialize(pairs, "neighbor-pairs")
    recent = articles.where(F.col("created_at") >= instant(as_of) - F.expr(f"interval {int(recent_days)} days"))
    return rank_by_neighbors(recent, neighbor_scores(pairs, user_agent), few=not per_article)
