"""Model replies: clean-up, strict JSON check and the fields of the result."""

from __future__ import annotations

import json
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.schema import TAGGING_RESULT

FENCE = "```"
EMPTY_REPLY = "JSON Error: Empty input: line 1 column 1 (char 0)"
_INT_MAX = 2**31 - 1


def reply_body(reply: Column) -> Column:
    """Text between the first two code fences, if there are two, without blanks and quotes around."""
    parts = F.split(reply, FENCE)
    fenced = F.regexp_replace(F.get(parts, F.lit(1)), "^json", "")
    inner = F.when(F.size(parts) >= 3, fenced).otherwise(reply)
    return F.btrim(strip(inner), F.lit("\"'"))


def _names(value, key):
    """A list of texts or None; anything else cannot be stored as tags."""
    if value is not None and not (isinstance(value, list) and all(v is None or isinstance(v, str) for v in value)):
        raise TypeError(f"{key} is not a list of texts")
    if value is None:
        return None
    # halves of surrogate pairs are put together, single ones replaced
    return [v and v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in value]


def read_reply(body: str) -> tuple:
    """(scope, topic, mood, score, error) of a cleaned reply.

    Escapes are decoded bytewise, so text beyond ASCII turns into its Latin-1 reading; every
    apostrophe becomes a double quote, and line breaks are dropped before the JSON is read.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            text = body.encode().decode("unicode_escape")
        parsed = json.loads(text.replace("'", '"').replace("\n", ""))
    except json.JSONDecodeError as e:
        return None, None, None, None, f"JSON Error: {e}"
    except Exception as e:
        return None, None, None, None, f"Unexpected Error: {e}"
    if not isinstance(parsed, dict):
        return None, None, None, None, f"Unexpected Error: reply is a {type(parsed).__name__}, not an object"
    try:
        score = parsed.get("score")
        if score is not None and (type(score) is not int or abs(score) > _INT_MAX):
            raise TypeError("score is not an integer")
        scope, topic, mood = (_names(parsed.get(key), key) for key in ("scope", "topic", "mood"))
        return scope, topic, mood, score, None
    except TypeError as e:
        return None, None, None, None, f"Unexpected error: {e}"


@F.pandas_udf(TAGGING_RESULT)
def _read_replies(bodies: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 5 if body is None else read_reply(body) for body in bodies]
    frame = pd.DataFrame(rows, columns=["scope", "topic", "mood", "score", "error"], dtype=object)
    frame["score"] = frame["score"].astype("Int32")
    return frame


# computed once; the optimizer must not copy it into every use of a field
_read_replies = _read_replies.asNondeterministic()


def parse_reply(reply: Column, model_error: Column | None = None) -> Column:
    """Tagging result of a reply; ``model_error`` is the error of the model call, if any."""
    failed = model_error if model_error is not None else F.lit(None).cast("string")
    empty = F.coalesce(reply, F.lit("")) == ""

    def error(text: Column) -> Column:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in TAGGING_RESULT.fields[:-1]]
        return F.struct(*nothing, text.alias("error"))

    readable = failed.isNull() & ~empty
    return (
        F.when(failed.isNotNull(), error(F.concat(F.lit("LLM Error: "), failed)))
        .when(empty, error(F.lit(EMPTY_REPLY)))
        .otherwise(_read_replies(F.when(readable, reply_body(reply))))
    )
