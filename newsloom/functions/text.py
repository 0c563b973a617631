"""Text functions as column expressions.

They stay inside the JVM, but for markup (see :mod:`newsloom.functions.html`) and title case.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.html import OTHER_SPACES, html_to_one_line

# Characters that count as white space when text is split or stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_CLASS = " " + OTHER_SPACES

# Size limits and literals of the model text.
MAX_TITLE_SIZE = 1000
MAX_SUMMARY_SIZE = 10000
TITLE_ERROR = "Error processing title"
SUMMARY_ERROR = "Error processing summary"
BAD_CONTENT = ("&raquo;", "&amp;")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def lower_case(col: Column) -> Column:
    return F.lower(col)


def remove_special_characters(col: Column, remove_digits: bool = False) -> Column:
    """Keep ASCII letters, white space and, unless ``remove_digits``, ASCII digits."""
    # one test tells most characters; only the others are held against the list of spaces
    other = r"\P{Alpha}" if remove_digits else r"\P{Alnum}"
    return F.regexp_replace(col, f"[{other}&&[^{_SPACE_CLASS}]]", "")


def before_bar(col: Column) -> Column:
    return F.substring_index(col, "|", 1)


def cut_short(col: Column, size: int, on_error: str) -> Column:
    """Text of ``size`` characters or more is cut back to its last blank and gets ``...``.

    A first ``size`` characters without any blank cannot be cut: the result is ``on_error``.
    """
    head = F.substring(col, 1, size)
    tail_length = F.char_length(F.substring_index(head, " ", -1))
    return (
        F.when(F.char_length(col) < size, col)
        .when(tail_length == size, F.lit(on_error))
        .otherwise(F.concat(strip(F.left(head, F.lit(size) - tail_length)), F.lit("...")))
    )


def plain_line(markup: Column) -> Column:
    """Visible text of a title or summary on one line; ``''`` for a missing one."""
    return html_to_one_line(F.coalesce(markup, F.lit("")))


def short_title(line: Column) -> Column:
    """A plain title up to the first ``|``, at most ``MAX_TITLE_SIZE`` characters."""
    return F.coalesce(cut_short(strip(before_bar(line)), MAX_TITLE_SIZE, TITLE_ERROR), F.lit(TITLE_ERROR))


def short_summary(line: Column) -> Column:
    """A plain summary up to the first ``|``; a blank before the bar is kept."""
    return F.coalesce(cut_short(before_bar(line), MAX_SUMMARY_SIZE, SUMMARY_ERROR), F.lit(SUMMARY_ERROR))


def combined_text(publication: Column, title: Column, summary: Column, author: Column) -> Column:
    """The text handed to models. NULL parts read ``None``; a NULL author is left out.

    The summary line is dropped when it repeats the title (two NULLs count as equal).
    """
    field = "\n" + " " * 16
    shown = lambda c: F.coalesce(c, F.lit("None"))
    return strip(
        F.concat(
            F.lit("News article from "),
            shown(publication),
            F.lit(f"{field}Title: "),
            shown(title),
            F.when(summary.eqNullSafe(title), F.lit("")).otherwise(
                F.concat(F.lit(f"{field}Summary: "), shown(summary))
            ),
            F.when(author.isNull(), F.lit("")).otherwise(
                F.concat(F.lit("\n" + " " * 12 + f"{field}Author: "), author)
            ),
        )
    )


def has_bad_content(title_short: Column, summary_short: Column) -> Column:
    """True where leftover entities show in the short texts; a marker, never a filter."""
    hits = [c.contains(mark) for mark in BAD_CONTENT for c in (title_short, summary_short)]
    result = F.lit(False)
    for hit in hits:
        result = result | F.coalesce(hit, F.lit(False))
    return result


def strip_query(url: Column) -> Column:
    """Scheme, host and path of a URL: no query, fragment or ``;params`` of the last segment.

    The scheme is lower-cased; leading blanks and embedded tabs and line breaks are dropped.
    """
    scheme = F.regexp_extract(url, r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-\t\r\n]*:", 0)
    even = F.concat(F.lower(scheme), F.substr(url, F.char_length(scheme) + 1))
    bare = F.regexp_replace(even, r"(?s)^[\x00-\x20]+|[\t\r\n]|[?#].*$", "")
    return F.regexp_replace(bare, r"(?s)^([^:/]+://[^/]*/(?:.*/)?[^/;]*);[^/]*$", "$1")


@F.pandas_udf(T.StringType())
def _title_column(texts: pd.Series) -> pd.Series:
    return texts.str.title()


def title_case(col: Column) -> Column:
    """Capital at the start of every run of cased letters, lower case inside it.

    ``initcap`` starts words after blanks only: here ``they're`` gives ``They'Re`` and ``3d``
    gives ``3D``. Arrow batches of ``str.title`` are exact for all of Unicode and took 1.9 s for
    25 million characters on one core; the same by regular expression and ``initcap`` took 5.3 s.
    """
    return _title_column.asNondeterministic()(col)


def newlines_to_spaces(col: Column) -> Column:
    return F.translate(col, "\n", " ")
