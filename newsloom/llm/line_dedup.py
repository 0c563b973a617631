"""Line de-duplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, so the first ones of a line (its prefix) are
shared by few lines, and similar lines share one of them. Lines that meet in a prefix word pass length
and positional filters and a parity signature, all of them bounds that no similar pair violates;
the signature grows with the line, since longer lines may differ in more words. The rest is verified by
Jaccard on the sets. A line goes when an earlier line (smaller doc_id, then smaller line number) is
similar to it, whether or not that one stays. Built-in functions only.

Equal lines are collapsed before the join. A line then meets the first and the previous line of each of
its prefix words, on their way to a table of all of these, and the nearest one by parity is verified, which
finds a partner for nearly all copies in linear work; only lines without a partner so far are joined with
all lines of their prefix words. Words of a single line are not in the table.

The rarity of a word is the count of its hash bucket: a table of fixed size, counted over all words,
decides the order alone and never which lines are similar. Words are compared by 56 bits of hash and the
rarity class, lines by 128 bits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import word_array
from newsloom.session import broadcast_if_small, materialize, scratch_path


COLUMNS = ["n", "pos", "even", "odd", "wide", "doc_id", "line_no"]


@dataclass(frozen=True)
class Settings:
    """Similarity in percent; ``buckets`` (a power of two) is the fixed size of the rarity table, a byte each.

    A line's signature has 64 bits, twice that beyond ``short`` words, four times that beyond twice as many, and so on up
    to ``widest`` times (a power of two).
    """

    percent: int = 80
    buckets: int = 1 << 18
    short: int = 96
    widest: int = 16


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of every line with a word; line numbers start from 0.

    The outer form of the generators keeps the optimizer from adding a filter on their size, which would
    compute the array several times over. The row it adds for a NULL text is no line with a word.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = texts.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^ \t-\r]"))


def _words(text: Column) -> Column:
    """Words of a text, faster where the space is its only separator."""
    plain = F.array_remove(F.split(text, " "), "")
    controls = reduce(or_, (F.contains(text, F.lit(c)) for c in "\t\n\v\f\r"))
    return F.when(controls, word_array(text)).otherwise(plain)


def rarity_table(docs: DataFrame, s: Settings) -> list[int]:
    """The rarity class of each hash bucket: three times the binary logarithm of its count."""
    words = docs.select(F.explode_outer(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    bucket = F.xxhash64("word").bitwiseAND(F.lit(s.buckets - 1)).alias("id")
    counts = words.groupBy(bucket).agg(F.least(F.floor(3 * F.log2(F.count(F.lit(1)) + 1)), F.lit(127)).cast("int").alias("class"))
    every = docs.sparkSession.range(s.buckets).join(counts, "id", "left")
    pairs = F.collect_list(F.struct("id", F.coalesce("class", F.lit(0)).alias("class")))
    classes = F.transform(F.sort_array(pairs), lambda x: x["class"])
    return every.agg(classes.alias("classes")).first()["classes"]  # of fixed size


def _ranked_words(line: Column, classes: list[int], s: Settings) -> Column:
    """Distinct words of a line as numbers in order of rarity."""
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<long>")  # folded into one constant

    def rank(h: Column) -> Column:
        # never NULL, so that the sort below is one of plain numbers
        rarity = F.coalesce(table[h.bitwiseAND(F.lit(s.buckets - 1))], F.lit(0).cast("long"))
        return F.shiftleft(rarity, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    hashes = F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, rank))


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _place() -> Column:
    """Document and line number as one number of the same order: its minimum is found by hashing, that of a struct by sorting."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")


def _repeated(docs: DataFrame) -> DataFrame:
    """``h1, h2, first``: lines that occur more than once, with the first place of each."""
    lines = lines_of(docs).select(_place().alias("place"), *_identity(F.col("line")))
    firsts = lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return materialize(firsts.where("n > 1").select("h1", "h2", "first"), "repeated_lines")


def _postings(docs: DataFrame, repeated: DataFrame, s: Settings) -> DataFrame:
    """``token, pos, n, even, odd, wide, doc_id, line_no`` for the prefix words of the first line of each kind.

    A copy of an earlier line is one row, at the position -1 of a token made of its place.
    """
    classes = rarity_table(docs, s)
    repeated, _ = broadcast_if_small(repeated, 1_000_000)
    lines = lines_of(docs).select("doc_id", "line_no", "line", *_identity(F.col("line"))).join(repeated, ["h1", "h2"], "left")
    lines = lines.select("doc_id", "line_no", "line", F.coalesce(_place() > F.col("first"), F.lit(False)).alias("copy"))
    words = lines.select("doc_id", "line_no", F.when(~F.col("copy"), _ranked_words(F.col("line"), classes, s)).alias("words"))
    sized = words.select("doc_id", "line_no", "words", F.size("words").alias("n"), _shares(F.size("words"), s).alias("shares"))
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda u, v: u.bitwiseXOR(v))
    size = F.size("signature")
    rows = _signed(sized).select(
        "doc_id",
        "line_no",
        "n",
        F.when(size == 1, F.get("signature", F.lit(0))).otherwise(xor(F.filter("signature", lambda _, i: i % 2 == 0))).alias("even"),
        F.when(size > 1, xor(F.filter("signature", lambda _, i: i % 2 == 1))).alias("odd"),
        F.when(size > 2, F.col("signature")).alias("wide"),
        F.slice("words", F.lit(1), _kept(F.col("n"), s)).alias("prefix"),
    )
    rows = rows.select(F.posexplode_outer("prefix").alias("pos", "token"), "n", "even", "odd", "wide", "doc_id", "line_no")
    return rows.withColumns({"pos": F.coalesce("pos", F.lit(-1)), "token": F.coalesce("token", F.xxhash64("doc_id", "line_no"))})


def _shares(n: Column, s: Settings) -> Column:
    """Numbers in the signature of a line of ``n`` words."""
    wide = F.least(F.lit(s.widest), F.pow(F.lit(2), F.ceil(F.log2(n / s.short)))).cast("int")
    return F.when(n > s.short, wide).otherwise(F.lit(1))


def _signed(sized: DataFrame) -> DataFrame:
    """``sized (doc_id, line_no, words, n, shares)`` with ``signature``: ``shares`` numbers, each of them the parities of a share of the words.

    Those of the first share are what the other ones leave of the parities of all words.
    """
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda u, v: u.bitwiseXOR(v))
    parity = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(_bit(x)))
    share = lambda i: F.filter("words", lambda x: x.bitwiseAND(F.col("bits")) == i)
    step = F.lit(64).cast("long")
    others = F.transform(F.sequence(step, F.col("bits"), step), lambda i: parity(share(i)))
    split = sized.withColumn("bits", (F.col("shares") - 1) * step)  # the bits of a word that tell its share
    split = split.withColumns({"all": parity(F.col("words")), "others": F.when(F.col("bits") > 0, others)})
    wide = F.concat(F.array(F.col("all").bitwiseXOR(xor(F.col("others")))), F.col("others"))
    return split.withColumn("signature", F.coalesce(wide, F.array("all"))).drop("bits", "all", "others", "shares")


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def _by_token(postings: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """The postings as a bucketed table in the shared folder, so the join on the token does without a shuffle.

    On the way there each posting meets the first and the previous line of its token: ``met`` is the nearer one of those that
    may be similar, as ``far, y_doc, y_line``. Postings alone with their token are left out; copies are not.
    """
    spark = postings.sparkSession
    name = f"line_postings_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("token").orderBy("doc_id", "line_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # by rows, the first one is looked up once a token
    others = [F.first(c).over(whole).alias(f"first_{c}") for c in COLUMNS] + [F.lag(c).over(order).alias(f"previous_{c}") for c in COLUMNS]
    ranked = postings.repartition(parts, "token").select("token", *COLUMNS, *others, F.lead("doc_id").over(order).alias("next"))
    here = {c: F.col(c) for c in COLUMNS}

    def met(other: str) -> Column:
        there = {c: F.col(f"{other}_{c}") for c in COLUMNS}
        found = (here["pos"] >= 0) & (there["pos"] >= 0) & _later(here, there) & _may_be_similar(here, there, s) & _of_one_kind_widely(here, there, s)
        return F.when(found, F.struct(_far(here, there).alias("far"), there["doc_id"].alias("y_doc"), there["line_no"].alias("y_line")))

    shared = ranked.where("previous_doc_id is not null or next is not null or pos < 0")
    rows = shared.select("token", *COLUMNS, F.least(met("first"), met("previous")).alias("met"))
    writer = rows.write.format("parquet").bucketBy(parts, "token").option("compression", "zstd")
    # the rarity table is a constant in these expressions: the texts of the plan, which the driver keeps, are made without them;
    # a task has one bucket, for which its rows need no sort if it may keep writers open
    during = {"spark.sql.debug.maxToStringFields": "0", "spark.sql.maxConcurrentOutputFileWriters": "2"}
    before = {key: spark.conf.get(key) for key in during}
    for key, value in during.items():
        spark.conf.set(key, value)
    try:
        writer.option("path", scratch_path(spark, "line_postings")).saveAsTable(name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.table(name), name


def _later(x: dict[str, Column], y: dict[str, Column]) -> Column:
    return (y["doc_id"] < x["doc_id"]) | ((y["doc_id"] == x["doc_id"]) & (y["line_no"] < x["line_no"]))


def _needed(x: dict[str, Column], y: dict[str, Column], s: Settings) -> Column:
    """The smallest number of common words with which two lines are similar."""
    return F.ceil((x["n"] + y["n"]) * s.percent / (100 + s.percent) - 1e-9)


def _of_one_kind(x: dict[str, Column], y: dict[str, Column], s: Settings) -> Column:
    """Length and parity filters: true for every pair of similar lines."""
    of_length = 100 * F.least(x["n"], y["n"]) >= s.percent * F.greatest(x["n"], y["n"])
    return of_length & (_far(x, y) <= _most(x, y, s))


def _most(x: dict[str, Column], y: dict[str, Column], s: Settings) -> Column:
    """The largest number of words in one of two similar lines only."""
    t = s.percent / 100
    return (x["n"] + y["n"]) * (1 - t) / (1 + t) + 1e-9


def _of_one_kind_widely(x: dict[str, Column], y: dict[str, Column], s: Settings) -> Column:
    """The parity filter of wide signatures; it has lambdas, for which Spark makes no code."""
    wide = x["wide"].isNotNull() & y["wide"].isNotNull()
    return F.when(wide, _differing(x["wide"], y["wide"]) <= _most(x, y, s)).otherwise(F.lit(True))


def _far(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Differing bits of two signatures folded to 128 bits, or to 64 where one has no more."""
    even, odd = x["even"].bitwiseXOR(y["even"]), x["odd"].bitwiseXOR(y["odd"])
    rest = F.coalesce(x["odd"], F.lit(0)).bitwiseXOR(F.coalesce(y["odd"], F.lit(0)))
    return F.when(odd.isNotNull(), F.bit_count(even) + F.bit_count(odd)).otherwise(F.bit_count(even.bitwiseXOR(rest)))


def _differing(x: Column, y: Column) -> Column:
    """Differing bits of two wide signatures, the wider one folded to the size of the other."""

    def folded(a: Column, size: Column) -> Column:
        share = lambda i: F.filter(a, lambda _, j: j % size == i)
        xor = lambda i: F.aggregate(share(i), F.lit(0).cast("long"), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(a) == size, a).otherwise(F.transform(F.sequence(F.lit(0), size - 1), xor))

    size = F.least(F.size(x), F.size(y))
    bits = F.zip_with(folded(x, size), folded(y, size), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def _may_be_similar(x: dict[str, Column], y: dict[str, Column], s: Settings) -> Column:
    """With the positional filter: true for every pair of similar lines that shares its first common word here."""
    return (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= _needed(x, y, s)) & _of_one_kind(x, y, s)


def _kept(n: Column, s: Settings) -> Column:
    """Length of the prefix of a line."""
    return n - F.ceil(n * s.percent / 100).cast("int") + 1


def _verified(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Later lines ``doc_id, line_no`` of those ``pairs (doc_id, line_no, y_doc, y_line)`` that reach the similarity.

    The later line travels once, to where its partner is, as text: that compresses, hashes of its words don't.
    """
    later, _ = broadcast_if_small(pairs, 2_000_000)
    earlier, _ = broadcast_if_small(pairs.select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line_no")).distinct(), 2_000_000)

    def lines_in(side: DataFrame) -> DataFrame:
        """Lines of the documents of one side; the others are not cut into lines."""
        ids, _ = broadcast_if_small(side.select(F.col("doc_id").alias("_id")).distinct(), 2_000_000)
        return lines_of(docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("long") == F.col("_id"), "left_semi"))

    x = lines_in(pairs).join(later, ["doc_id", "line_no"]).select("doc_id", "line_no", "y_doc", "y_line", F.col("line").alias("x"))
    y = lines_in(earlier).join(earlier, ["doc_id", "line_no"], "left_semi").select(F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line"), F.col("line").alias("y"))
    # each word list and each intersection is an element of an array, so that it is computed once
    sets = F.array(F.struct(*(F.array_distinct(_words(F.col(c))).alias(c) for c in "xy")))
    sizes = F.transform(sets, lambda p: F.struct((F.size(p.x) + F.size(p.y)).alias("sum"), F.size(F.array_intersect(p.x, p.y)).alias("both")))
    similar = F.exists(sizes, lambda p: 100 * p.both >= s.percent * (p.sum - p.both))
    return x.join(y, ["y_doc", "y_line"]).where(similar).select("doc_id", "line_no").distinct()


def _gone(docs: DataFrame, repeated: DataFrame, s: Settings) -> DataFrame:
    """Copies, and first lines of their kind that are similar to an earlier line of another kind."""
    postings, table = _by_token(_postings(docs, repeated, s), s)
    # one partner for each line: the one with the fewest different bits
    met = postings.where("met is not null").groupBy("doc_id", "line_no").agg(F.min("met").alias("y"))
    pairs = materialize(met.select("doc_id", "line_no", "y.y_doc", "y.y_line"), "line_pairs")
    found = materialize(_verified(docs, pairs, s), "similar_lines")
    copies = materialize(postings.where("pos < 0").select("doc_id", "line_no"), "copied_lines")

    postings = postings.where("pos >= 0").drop("met")
    known, _ = broadcast_if_small(found, 2_000_000)
    open_ = postings.join(known, ["doc_id", "line_no"], "left_anti").alias("x")
    every = postings.alias("y")
    x, y = ({c: F.col(f"{side}.{c}") for c in COLUMNS} for side in "xy")
    # a similar pair passes where its first common word meets, so the other meetings need not be counted
    rest = open_.join(every, (F.col("x.token") == F.col("y.token")) & _later(x, y) & _may_be_similar(x, y, s))
    # behind the generator the wide filter stays out of the join, which would run without generated code for it
    both = F.array(F.struct(F.struct(x["n"], x["wide"]).alias("x"), F.struct(y["n"], y["wide"]).alias("y")))
    rest = rest.select(x["doc_id"].alias("doc_id"), x["line_no"].alias("line_no"), y["doc_id"].alias("y_doc"), y["line_no"].alias("y_line"), F.explode_outer(both).alias("both"))
    wide = ({c: F.col(f"both.{side}.{c}") for c in ("n", "wide")} for side in "xy")
    rest = rest.where(_of_one_kind_widely(*wide, s)).select("doc_id", "line_no", "y_doc", "y_line").distinct()
    rest = materialize(rest.join(pairs, ["doc_id", "line_no", "y_doc", "y_line"], "left_anti"), "line_pairs")
    docs.sparkSession.sql(f"drop table {table}")
    return copies.unionByName(found).unionByName(_verified(docs, rest, s)).distinct()


def removed_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, line_no`` of every line that goes: copies of an earlier line and lines similar to one."""
    return materialize(_gone(docs, _repeated(docs), settings), "removed_lines")


def line_report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed_lines``: lines with a word, and the numbers of those that go.

    One row per row of ``docs``. Lines without a word are no lines here. Rows that share an id share
    line numbers and the report. Rows with a NULL id and NULL or empty texts have no lines.
    """
    gone = removed_lines(docs, settings).groupBy("doc_id")
    gone = gone.agg(F.count(F.lit(1)).alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("removed_lines"))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(lines).alias("n_lines"))
    zero = {"n_removed": 0, "removed_lines": ""}
    return counted.join(gone, "doc_id", "left").fillna(zero)


def remove_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the lines that go. A document of which no line with a word is left goes too.

    Documents that lose nothing stay as they are, also NULL and empty texts and NULL ids.
    """
    gone = removed_lines(docs, settings).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone, _ = broadcast_if_small(materialize(gone, "lines_by_document"))
    # the table's own columns stay in one struct, whatever they are called
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"))
    joined = whole.join(gone, "doc_id", "left")
    lines = F.split("row.text", "\n", -1)
    left = F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    kept = joined.withColumn("left", text).where(F.col("gone").isNull() | F.col("left").rlike(r"[^ \t-\r]"))
    return kept.select(*(F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
