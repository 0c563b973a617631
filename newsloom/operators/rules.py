"""Score articles by a table of liked and disliked tags.

``tags`` has tag_id, name and score; a negative score marks a disliked tag, a positive one a
liked tag, and ``tag_id`` is the order in which tags are tried on texts.

A short tag table becomes literals of the plan. A longer one is joined: to the articles' own tags by name,
to the distinct words of the texts by the first characters of the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import title_case
from newsloom.operators.selection import rescorable, unprocessed
from newsloom.session import broadcast_if_small, materialize

# Up to this many tags are written into the plan: as a hash set for the articles' own tags, as a
# chain of tests for texts.
LITERAL_OWN_TAGS = 2000
LITERAL_TEXT_TAGS = 48
# Up to this many distinct first characters of names are written into the plan, to skip all other positions.
LITERAL_HEADS = 1000

# Agents and scores of the rule results.
BY_TAG, BY_TITLE, BY_NONE = "TAG", "TITLE", "NONE"
TAG_SCORE, TITLE_SCORE = 10, 5


def negative_tags(tags: DataFrame) -> DataFrame:
    return tags.where("score < 0").select("name")


def positive_tags(tags: DataFrame) -> DataFrame:
    return tags.where("score > 0").select("name")


def _mark(negative: Column, positive: Column, weight: int) -> dict[str, Column]:
    """Score and reason when exactly one polarity was found."""
    only_negative = negative.isNotNull() & positive.isNull()
    only_positive = positive.isNotNull() & negative.isNull()
    return {
        "score": F.when(only_negative, -weight).when(only_positive, weight).otherwise(0),
        "reason": F.when(only_negative, negative).when(only_positive, positive),
    }


def _polar(tags: DataFrame) -> DataFrame:
    """Tags that count. An empty name is a tag like any other and part of every text."""
    return tags.where("score <> 0 and name is not null").select("tag_id", "name", (F.col("score") < 0).alias("bad"))


def _stored(tags: DataFrame) -> DataFrame:
    """The tags that count, written once: a tag table may itself be the result of a scan."""
    return materialize(tags.where("score <> 0 and name is not null").select("tag_id", "name", "score"), "tags")


def _literals(tags: DataFrame, most: int) -> tuple[list[str], list[str]] | None:
    """Disliked and liked names in tag order, or None when there are more than ``most``."""
    rows = _polar(tags).orderBy("tag_id", "name").limit(most + 1).collect()
    if len(rows) > most:
        return None
    return [r["name"] for r in rows if r["bad"]], [r["name"] for r in rows if not r["bad"]]


def _last_own_tag(own: Column, names: list[str], but_not: list[str] = ()) -> Column:
    names = [n for n in names if n not in but_not]
    if not names:
        return F.lit(None).cast("string")
    return F.try_element_at(F.filter(own, lambda t: t.isin(*names)), F.lit(-1))


def _own_hits(articles: DataFrame, tags: DataFrame, most_literals: int | None = None) -> DataFrame:
    """``articles`` with neg and pos, the last disliked and the last liked of their own tags."""
    names = _literals(tags, LITERAL_OWN_TAGS if most_literals is None else most_literals)
    if names is not None:
        bad, good = names
        own = F.col("tags")
        return articles.select("*", _last_own_tag(own, bad).alias("neg"), _last_own_tag(own, good, bad).alias("pos"))
    polarity = _polar(tags).groupBy("name").agg(F.bool_or("bad").alias("bad"))
    polarity, _ = broadcast_if_small(polarity)
    hits = articles.select("id", F.posexplode("tags").alias("place", "name")).join(polarity, "name")
    at = lambda bad: F.when(F.col("bad") == bad, F.col("place"))
    last = hits.groupBy("id").agg(F.max_by("name", at(True)).alias("neg"), F.max_by("name", at(False)).alias("pos"))
    return articles.join(last, "id", "left")


def mark_by_tags(articles: DataFrame, tags: DataFrame, most_literals: int | None = None) -> DataFrame:
    """(id, score, reason) from the articles' own tags.

    The last matching tag of each polarity counts; a name on both sides counts as disliked. Tag tables
    of more than ``most_literals`` rows are joined by name.
    """
    found = _own_hits(articles.select("id", "tags"), tags, most_literals)
    return found.select("id", *[c.alias(k) for k, c in _mark(F.col("neg"), F.col("pos"), TAG_SCORE).items()])


def search_text(title: Column, summary: Column) -> Column:
    """Title and summary without a separator; NULL without a title."""
    return F.concat(title, F.coalesce(summary, F.lit("")))


def _first_in_text(text: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in names])


def _prefix_length(name: Column) -> Column:
    """Largest power of two that is not above the length of a name: few lengths, at least half of every name."""
    return F.pow(F.lit(2), F.floor(F.log2(F.char_length(name)))).cast("int")


def _pieces(text: Column, length: int, heads: list[str] | None) -> Column:
    """Distinct pieces of ``length`` characters and as many of the ``length - 1`` after them as there are.

    They begin with one of ``heads``, or anywhere without them.
    """
    head = "." if heads is None else "[" + "".join(f"\\x{{{ord(c):x}}}" for c in heads) + "]"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({head}.{{{length - 1}}}.{{0,{length - 1}}}))"), F.lit(1)))


def _windows(text: Column, words: int) -> Column:
    """Distinct runs of ``words`` pieces between blanks; a text with fewer pieces is one run."""
    split = F.split(text, " ", -1)
    if words == 1:
        return F.array_distinct(split)
    starts = F.sequence(F.lit(1), F.greatest(F.size(split) - (words - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(split, i, F.lit(words)), " ")))


def _first_of_side(bad: bool) -> Column:
    return F.min(F.when(F.col("bad") == bad, F.col("place")))


def _named_windows(vocabulary: DataFrame, names: DataFrame, sizes: list) -> DataFrame:
    """``window, no, yes``: the places of the first disliked and the first liked name in each window that has one.

    A prefix holds at least half of its name, so a piece of twice its size holds any name it begins. A piece is cut
    to the lengths of the names with its prefix and met by equality, so its work doesn't grow with their number.
    """
    found = None
    for row in sizes:
        heads = sorted(row["heads"]) if len(row["heads"]) <= LITERAL_HEADS else None
        pieces = vocabulary.select("number", F.explode(_pieces(F.col("shown"), row["size"], heads)).alias("around"))
        pieces = pieces.withColumn("piece", F.left("around", F.lit(row["size"])))
        found = pieces if found is None else found.union(pieces)
    lengths, _ = broadcast_if_small(names.groupBy("piece").agg(F.collect_set(F.char_length("name")).alias("lengths")), 1_000_000)
    cut = F.transform(F.filter("lengths", lambda n: n <= F.char_length("around")), lambda n: F.left(F.col("around"), n))
    begun = found.join(lengths, "piece").select("number", F.explode(cut).alias("name"))
    places = names.groupBy("name").agg(_first_of_side(True).alias("no"), _first_of_side(False).alias("yes"))
    places, _ = broadcast_if_small(places, 1_000_000)
    first = begun.join(places, "name").groupBy("number").agg(F.min("no").alias("no"), F.min("yes").alias("yes"))
    return vocabulary.select("number", "window").join(first, "number").select("window", "no", "yes")


def _joined_hits(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """``texts`` with neg and pos, from the distinct words of all texts.

    A blank ends a run of cased letters, so words take their title case alone, and a name without a blank lies
    inside one word. Names are searched in each distinct word once, and texts meet the words that have
    some. A name with blanks is searched in the same way in runs of words: the power of two that covers it.
    """
    spark = texts.sparkSession
    order = F.col("tag_id").cast("long")
    # places in tag order are single numbers, whose minimum needs no sort
    polar = materialize(_polar(tags).orderBy(order, "name").select(F.monotonically_increasing_id().alias("place"), "name", "bad"), "numbered")
    blanks = F.char_length("name") - F.char_length(F.replace("name", F.lit(" "), F.lit("")))
    words = F.pow(F.lit(2), F.ceil(F.log2(blanks + 1))).cast("int")
    prefixes = polar.where("name <> ''").withColumns({"words": words, "size": _prefix_length(F.col("name"))})
    prefixes = prefixes.withColumn("piece", F.left("name", F.col("size")))
    # a row for each power of two up to the longest name, in characters and in words
    sizes = prefixes.groupBy("words", "size").agg(F.slice(F.collect_set(F.left("piece", F.lit(1))), 1, LITERAL_HEADS + 1).alias("heads")).collect()
    stored = materialize(texts.withColumn("searchable", F.col("text").isNotNull()), "searched")
    met = spark.createDataFrame([], "no long, yes long").select(F.lit(None).cast(stored.schema["id"].dataType).alias("id"), "no", "yes")
    for n in sorted({row["words"] for row in sizes}):
        runs = stored.where("searchable").select("id", F.explode(_windows(F.col("text"), n)).alias("window"))
        shown = runs.select("window").distinct().select(F.monotonically_increasing_id().alias("number"), "window", title_case(F.col("window")).alias("shown"))
        vocabulary = materialize(shown, "vocabulary")
        names = prefixes.where(F.col("words") == n).select("piece", "place", "name", "bad")
        named = materialize(_named_windows(vocabulary, names, [row for row in sizes if row["words"] == n]), "named")
        named, _ = broadcast_if_small(named, 1_000_000)
        met = met.unionByName(runs.join(named, "window").groupBy("id").agg(F.min("no").alias("no"), F.min("yes").alias("yes")))
    hits = met.groupBy("id").agg(F.min("no").alias("no"), F.min("yes").alias("yes"))
    everywhere = polar.where("name = ''").agg(_first_of_side(True).alias("no"), _first_of_side(False).alias("yes")).first()
    found = stored.drop("text").join(hits, "id", "left")
    for side, name in (("no", "neg"), ("yes", "pos")):
        if everywhere[side] is not None:
            found = found.withColumn(side, F.least(side, F.when(F.col("searchable"), F.lit(everywhere[side]))))
        named, _ = broadcast_if_small(polar.select(F.col("place").alias(side), F.col("name").alias(name)))
        found = found.join(named, side, "left")
    return found.drop("searchable", "no", "yes")


def _text_hits(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """``texts`` with neg and pos, the first disliked and the first liked tag in column ``text``."""
    names = _literals(tags, LITERAL_TEXT_TAGS)
    if names is None:
        return _joined_hits(texts, tags)
    bad, good = names
    texts = texts.withColumn("text", title_case(F.col("text")))
    text = F.col("text")
    return texts.select("*", _first_in_text(text, bad).alias("neg"), _first_in_text(text, good).alias("pos"))


def mark_by_text(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, score, reason) from tags contained in title and summary, both in title case.

    The first tag in ``tag_id`` order of each polarity counts. A lower-case tag matches only
    inside a word, one with several capitals in a row not at all.
    """
    found = _text_hits(articles.select("id", search_text(F.col("title"), F.col("summary")).alias("text")), _stored(tags))
    return found.select("id", *[c.alias(k) for k, c in _mark(F.col("neg"), F.col("pos"), TITLE_SCORE).items()])


def set_by_user(agent: Column) -> Column:
    """Whether a person set the row, in any spelling of the agent."""
    return F.lower(F.coalesce(agent, F.lit(""))) == "user"


def guard_user_rows(articles: DataFrame) -> DataFrame:
    """Fail the job when a row set by a person would be rescored."""
    by_user = set_by_user(F.col("agent"))
    stop = F.raise_error(F.concat(F.lit("about to rescore a row set by a user, id "), F.col("id").cast("string")))
    return articles.where(F.when(by_user, stop.cast("boolean")).otherwise(F.lit(True)))


def run_rules(articles: DataFrame, tags: DataFrame, rescore: bool = False) -> DataFrame:
    """One (id, agent, score, reason) row per selected article: own tags, then text, then none."""
    selected = guard_user_rows(rescorable(articles) if rescore else unprocessed(articles))
    tags = _stored(tags)
    own = _own_hits(selected.select("id", "title", "summary", "tags"), tags)
    by_tag = _mark(F.col("neg"), F.col("pos"), TAG_SCORE)
    own = own.select("id", "title", "summary", by_tag["score"].alias("own_score"), by_tag["reason"].alias("own_reason"))
    # texts are only searched where the tags decided nothing
    undecided = F.when(F.col("own_score") == 0, search_text(F.col("title"), F.col("summary")))
    found = _text_hits(own.select("id", "own_score", "own_reason", undecided.alias("text")), tags)
    by_text = _mark(F.col("neg"), F.col("pos"), TITLE_SCORE)
    tagged = F.col("own_score") != 0
    return found.select(
        "id",
        F.when(tagged, BY_TAG).when(by_text["score"] != 0, BY_TITLE).otherwise(BY_NONE).alias("agent"),
        F.when(tagged, F.col("own_score")).otherwise(by_text["score"]).alias("score"),
        F.when(tagged, F.col("own_reason")).otherwise(by_text["reason"]).alias("reason"),
    )
