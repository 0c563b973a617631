"""Run caller-supplied model functions over articles.

Only the text column travels to Python; all other columns stay in the JVM. Model calls are
expensive and not repeatable, so their results are stored once before anything reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.prompts import build_prompt, format_taxonomy
from newsloom.functions.replies import parse_reply
from newsloom.functions.text import newlines_to_spaces
from newsloom.operators.selection import SCORE_COLUMNS, USER, first_rows, require_empty
from newsloom.schema import TAGGING_RESULT
from newsloom.session import materialize

# Fixed value: most texts a single embedding call may carry.
MAX_BATCH = 2048

EmbedFn = Callable[[list[str]], list[list[float]]]
CompleteFn = Callable[[str], str]


def embedding_column(embed: EmbedFn, batch_size: int = MAX_BATCH) -> Callable[[Column], Column]:
    """Column function around ``embed``, called with up to ``batch_size`` texts in row order.

    An error in one call fails the job. NULL texts give NULL and are not sent.
    """
    if not 0 < batch_size <= MAX_BATCH:
        raise ValueError(f"batch_size must be between 1 and {MAX_BATCH}")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = pd.Series([None] * len(texts), dtype=object)
            at = [i for i, text in enumerate(texts) if text is not None]
            for start in range(0, len(at), batch_size):
                part = at[start : start + batch_size]
                answers = embed([texts.iloc[i] for i in part])
                if len(answers) != len(part):
                    raise ValueError("the embedding function must return one vector per text")
                for i, answer in zip(part, answers):
                    vectors.iloc[i] = list(answer)
            yield vectors

    udf = run.asNondeterministic()
    return lambda text: udf(newlines_to_spaces(text))


def embed_articles(
    articles: DataFrame,
    embed: EmbedFn,
    dry_run: bool = False,
    count: int | None = None,
    batch_size: int = MAX_BATCH,
) -> DataFrame:
    """Fill embedding2 from ``combined``; refuses articles that already have one."""
    require_empty(articles, ["embedding2"])
    rows = first_rows(articles, count)
    if dry_run:
        return rows
    return materialize(rows.withColumn("embedding2", embedding_column(embed, batch_size)(F.col("combined"))), "embedded")


def completion_column(complete: CompleteFn) -> Callable[[Column], Column]:
    """Column function around ``complete``: struct of reply, error and seconds, row by row.

    An error concerns its own row only.
    """

    @F.pandas_udf("reply string, error string, seconds double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from time import perf_counter

        for prompts in batches:
            rows = []
            for prompt in prompts:
                start = perf_counter()
                try:
                    rows.append((complete(prompt), None, perf_counter() - start))
                except Exception as e:
                    rows.append((None, str(e), perf_counter() - start))
            yield pd.DataFrame(rows, columns=["reply", "error", "seconds"]).astype({"reply": object, "error": object})

    return run.asNondeterministic()


def apply_results(articles: DataFrame, result: str = "result") -> DataFrame:
    """Carry a tagging result over to the article columns.

    A success sets ai_score2 and the tag columns, and score and agent unless a person set the
    agent. A failure changes nothing but scoring_status.
    """
    r = F.col(result)
    ok = r["error"].isNull()
    by_model = ok & ~F.col("agent").eqNullSafe(F.lit(USER))
    keep = lambda name: F.col(name)
    new = {
        "ai_score2": F.when(ok, r["score"]).otherwise(keep("ai_score2")),
        "score": F.when(by_model, r["score"]).otherwise(keep("score")),
        "agent": F.when(by_model, F.lit("AI")).otherwise(keep("agent")),
        "tags_topic": F.when(ok, r["topic"]).otherwise(keep("tags_topic")),
        "tags_mood": F.when(ok, r["mood"]).otherwise(keep("tags_mood")),
        "tags_scope": F.when(ok, r["scope"]).otherwise(keep("tags_scope")),
        "scoring_status": F.when(ok, F.lit("SUCCESS")).otherwise(F.concat(F.lit("FAILED: "), r["error"])),
    }
    return articles.withColumns(new)


def tag_and_score(
    articles: DataFrame,
    complete: CompleteFn,
    taxonomy: DataFrame,
    profile_json: str,
    template: str,
    dry_run: bool = False,
    count: int | None = None,
) -> DataFrame:
    """Ask the model about every article and carry the answers over; one row in, one row out."""
    require_empty(articles, SCORE_COLUMNS)
    rows = first_rows(articles, count)
    if dry_run:
        return rows
    prompt = build_prompt(template, format_taxonomy(taxonomy).scalar(), F.lit(profile_json), F.col("combined"))
    asked = materialize(rows.withColumn("answer", completion_column(complete)(prompt)), "answers")
    parsed = asked.withColumn("result", parse_reply(F.col("answer.reply"), F.col("answer.error")).cast(TAGGING_RESULT))
    return apply_results(parsed).withColumn("seconds", F.col("answer.seconds")).drop("answer", "result")
