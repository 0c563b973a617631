"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by their number of distinct word shingles, and every partition gets as many minima
of the shingle hashes as its sizes need: of q shingles a document that contains the share c misses at
most (1 - c) q, so the (1 - c) q + 1 smallest hashes of the item meet it at least once. A document is
probed with all its shingles, whatever its length, and only where it has enough of them for the
partition. Candidates are verified by exact shingle containment. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import word_array
from newsloom.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class Settings:
    """Word shingles of ``words`` words; a document is contaminated by an item at ``percent`` containment."""

    words: int = 5
    percent: int = 80


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with their ``words`` replaced by a row per place of ``width`` words, hashed to ``shingle``.

    Places are rows before they are hashed, so that hashing and the join that follows are compiled code. The outer
    explode keeps the optimizer from splitting texts a second time for a filter below it.
    """
    places = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))
    placed = rows.withColumn("place", F.explode_outer(places)).where("place is not null")
    shingle = F.xxhash64(*[F.get("words", F.col("place") + k) for k in range(width)])
    return placed.withColumn("shingle", shingle).drop("words", "place")


def _all_widths(rows: DataFrame, widths: list[int]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_shingles(rows.withColumn("width", F.lit(w)), w) for w in widths])


def item_shingles(items: DataFrame, s: Settings) -> DataFrame:
    """``item_id, width, shingle, n``: distinct shingles, ``n`` of them; an item below ``words`` words is one shingle."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), word_array(F.lower("text")).alias("words"))
    own = F.col("width") == F.least("n_words", F.lit(s.words))
    each = _all_widths(words.withColumn("n_words", F.size("words")), list(range(1, s.words + 1))).where(own)
    each = each.select("item_id", "width", "shingle").distinct()
    return each.join(each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id")


def _document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """``doc_id, n_words, width, shingle`` for every place of every text."""
    words = docs.select("doc_id", word_array(F.lower("text")).alias("words"))
    return _all_widths(words.withColumn("n_words", F.size("words")), widths)


def contained_items(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found``: every document with every item it contains.

    NULL or empty texts contain nothing and are contained in nothing, NULL ids are left out. Rows that
    share an id count as one text for their shingles. Other columns are ignored; an empty table on
    either side gives an empty result.
    """
    s = settings
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shingles = materialize(item_shingles(items, s), "item_shingles")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect()) or [s.words]  # at most `words` values

    # size partitions: powers of two of the number of shingles, with the minima the largest of them needs
    size = F.floor(F.log2("n")).cast("int")
    minima = F.floor((100 - s.percent) * F.least(F.col("n").cast("double"), F.pow(F.lit(2.0), size + 1)) / 100) + 1
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("shingle"))
    sketch = shingles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= minima)
    # the words a document needs at least, by the smallest size of the partition
    sketch = sketch.select("item_id", "width", "shingle", F.ceil(s.percent * F.pow(F.lit(2.0), size) / 100).alias("least"))
    sketch, _ = broadcast_if_small(materialize(sketch, "item_sketches"))

    probed = _document_shingles(docs, widths).join(sketch, ["width", "shingle"]).where("n_words - width + 1 >= least")
    candidates = materialize(probed.select("doc_id", "item_id").distinct(), "candidates")

    ids, _ = broadcast_if_small(candidates.select("doc_id").distinct(), 2_000_000)
    wanted, _ = broadcast_if_small(shingles)
    found = _document_shingles(docs.join(ids, "doc_id", "left_semi"), widths).join(wanted, ["width", "shingle"])
    found = found.select("doc_id", "item_id", "shingle", "n").distinct().join(candidates, ["doc_id", "item_id"], "left_semi")
    counts = found.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_shingles"), F.count(F.lit(1)).alias("n_found"))
    return counts.where(100 * F.col("n_found") >= s.percent * F.col("n_shingles"))


def remove_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs``, unchanged, that contain no item."""
    gone = materialize(contained_items(docs, items, settings).select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    gone, _ = broadcast_if_small(gone, 2_000_000)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


CONTAINED_SQL = """
with item_words as (
    select item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') as words
    from benchmark where item_id is not null and text is not null
), sized as (
    select item_id, words, least(5, len(words)) as width from item_words where len(words) > 0
), item_shingles as (
    select distinct item_id, width, unnest(list_transform(range(1, len(words) - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) as shingle
    from sized
), widths as (select distinct width from sized),
doc_words as (
    select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') as words
    from documents where doc_id is not null and text is not null
), doc_shingles as (
    select distinct doc_id, width, unnest(list_transform(range(1, len(words) - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) as shingle
    from doc_words, widths
), sizes as (select item_id, count(*) as n from item_shingles group by item_id)
select doc_id, item_id, any_value(n) as n_shingles, count(*) as n_found
from doc_shingles join item_shingles using (width, shingle) join sizes using (item_id)
group by doc_id, item_id having 100 * count(*) >= 80 * any_value(n)
"""
