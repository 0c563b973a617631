"""Embeddings, scores and rule results for articles that lack them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from newsloom.operators import inference
from newsloom.operators.merges import apply_rule_results, save_embeddings, save_scores
from newsloom.operators.rules import run_rules
from newsloom.operators.selection import SCORE_COLUMNS as TAG_AND_SCORE_COLUMNS
from newsloom.operators.selection import classified_without_embedding, recent_for_models
from newsloom.session import materialize

# only what the model step needs is stored; unused texts are then never computed
_FOR_EMBEDDING = ("id", "combined", "embedding2")


def add_embeddings(articles: DataFrame, as_of: datetime, embed: inference.EmbedFn, **limits) -> DataFrame:
    """The table with embeddings for recent articles that have none."""
    todo = recent_for_models(articles, as_of, ["embedding2"], **limits)
    todo = materialize(todo.select(*_FOR_EMBEDDING), "to-embed")
    return save_embeddings(articles, inference.embed_articles(todo, embed))


def add_embeddings_to_classified(articles: DataFrame, embed: inference.EmbedFn) -> DataFrame:
    """The same for all articles a person has classified, in one job instead of slices."""
    todo = materialize(classified_without_embedding(articles).select(*_FOR_EMBEDDING), "classified")
    return save_embeddings(articles, inference.embed_articles(todo, embed))


def add_scores(
    articles: DataFrame,
    as_of: datetime,
    complete: inference.CompleteFn,
    taxonomy: DataFrame,
    profile_json: str,
    template: str,
    **limits,
) -> DataFrame:
    """The table with model scores and tags for recent articles that have none."""
    todo = recent_for_models(articles, as_of, ["ai_score2"], **limits)
    todo = materialize(todo.select("id", "agent", "score", "combined", *TAG_AND_SCORE_COLUMNS), "to-score")
    return save_scores(articles, inference.tag_and_score(todo, complete, taxonomy, profile_json, template))


def add_rule_results(articles: DataFrame, tags: DataFrame, as_of: datetime, rescore: bool = False) -> DataFrame:
    results = materialize(run_rules(articles, tags, rescore), "rule-results")
    return apply_rule_results(articles, results, as_of)
