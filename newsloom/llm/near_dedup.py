"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its distinct word shingles. One hash of every shingle gives all bins of its
signature; empty bins are filled by optimal densification. Bands of bins form buckets. Documents with equal
sets are one node, and a bucket gives star-shaped candidate edges: every node with the bucket's
centre, so pair counts stay linear in the bucket. Candidates are confirmed on full sets.

A node that the centre doesn't link may still be linked to another node of the bucket. Two more rounds
try other centres, among nodes of different components only; then what is left of a bucket outside its
largest component is compared with all of the bucket. These rounds only pair documents whose sizes and
parity signatures allow the similarity, bounds that hold for every pair that has it. No bucket, group or
candidate list is cut off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, bytes_of, map_batches, map_texts, pieces_of
from newsloom.llm.components import connected_components
from newsloom.session import broadcast_if_small, materialize

WORDS = re.compile(WORD)
# Word hashes that a task remembers, about 20 MB; the memory is emptied when it is full.
REMEMBERED = 100_000
PARITY_BITS = 1024
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """A pair of similarity 0.8 shares one of 25 bands of 4 bins with probability 0.999998."""

    words: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 4
    seed: int = 5


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes, width: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width`` are one shingle."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    value = ids[: len(ids) - width + 1].copy()
    for k in range(1, width):
        value = (value ^ (value >> np.uint64(29))) * MULTIPLIER + ids[k : len(ids) - width + 1 + k]
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(value ^ (value >> np.uint64(32)))


def probe_order(bins: int, seed: int) -> np.ndarray:
    """For every bin a permutation of all bins: where an empty one looks for a value."""
    return np.random.default_rng(seed).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def band_hashes(shingles: np.ndarray, s: Settings, order: np.ndarray) -> np.ndarray:
    """One 64-bit value per band of a non-empty set."""
    bins = s.bands * s.rows
    where = (shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)  # ascending, as the hashes are
    filled, first = np.unique(where, return_index=True)
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[filled], full[filled] = shingles[first], True
    if len(filled) < bins:
        empty = np.flatnonzero(~full)
        source = order[empty, full[order[empty]].argmax(axis=1)]
        values[empty] = values[source]
    value = np.arange(1, s.bands + 1, dtype=np.uint64) * MULTIPLIER
    for column in values.reshape(s.bands, s.rows).T:
        value = ((value ^ column) * MULTIPLIER) ^ (value >> np.uint64(31))
    return value.view(np.int64)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For every bit the parity of the shingles that fall on it: two sets differ in at least as many
    shingles as their bits do."""
    odd = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(s: Settings) -> Column:
    """Size and parity bounds between a row and the ``other_`` one beside it."""
    n, m = F.col("n_shingles"), F.col("other_n")
    different = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("other_parity")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return (100 * F.least(n, m) >= s.percent * F.greatest(n, m)) & (different * (100 + s.percent) <= (n + m) * (100 - s.percent))


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, parity``; the last three are NULL for an empty set."""

    def run(batches):
        order, hashes = probe_order(s.bands * s.rows, s.seed), _WordHashes()
        for whole in batches:
            for batch in pieces_of(whole):
                sizes, digests, bands, parity = [], [], [], []
                for text in bytes_of(batch):
                    shingles = shingle_set(text, s.words, hashes)
                    sizes.append(len(shingles))
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    bands.append(band_hashes(shingles, s, order) if len(shingles) else None)
                    parity.append(parity_bits(shingles) if len(shingles) else None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(parity, longs)],
                    ["doc_id", "n_shingles", "digest", "bands", "parity"],
                )

    return map_texts(docs, run, "doc_id long, n_shingles long, digest binary, bands array<long>, parity array<long>", bounded=True)


def linked(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sets reach the similarity, judged on the full sets."""
    ids, _ = broadcast_if_small(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), 2_000_000)

    def sets_of(batches):
        hashes = _WordHashes()
        for whole in batches:
            for batch in pieces_of(whole):
                sets = [shingle_set(t, s.words, hashes).tobytes() for t in bytes_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    needed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = materialize(map_texts(needed, sets_of, "doc_id long, shingles binary", bounded=True), "shingle_sets")

    def confirm(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, most = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * least >= s.percent * most else 0
                good.append(100 * both >= s.percent * (least + most - both) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"]
            )

    sides = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    sides = sides.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return map_batches(sides.select("a", "b", "x", "y"), confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    NULL and empty texts are linked with nothing. Equal sets are always linked. Rows that share an id are
    taken for one document. Rows with a NULL id are compared with nothing: NULL component, kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    s = settings
    signed = materialize(signatures(docs, s), "signatures")
    identified = signed.where("doc_id is not null and digest is not null")
    nodes = identified.groupBy("digest").agg(F.min("doc_id").alias("node"))
    firsts = identified.join(nodes.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"], "left_semi")
    placed = firsts.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"))
    several = placed.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = materialize(placed.join(several.select("bucket", "first"), "bucket").distinct(), "buckets")

    tested = materialize(members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    facts = firsts.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    facts = materialize(facts.select(F.col("doc_id").alias("node"), "n_shingles", "parity").dropDuplicates(["node"]), "node_facts")
    links = materialize(linked(docs, tested, s), "links")
    components = materialize(connected_components(links), "components")
    for attempt in (1, 2, None):
        known = members.select("bucket", "node").join(components, "node", "left")
        known = known.select("bucket", "node", F.coalesce("component", "node").alias("component"))
        mixed = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        open_ = materialize(known.join(mixed.select("bucket"), "bucket", "left_semi").join(facts, "node"), "open_buckets")
        as_other = [F.col(c).alias(f"other{d}") for c, d in (("node", ""), ("component", "_component"), ("n_shingles", "_n"), ("parity", "_parity"))]
        if attempt:
            mark = F.struct(F.xxhash64("node", F.lit(attempt)).alias("h"), "node", "component", "n_shingles", "parity")
            others = open_.groupBy("bucket").agg(F.min(mark).alias("c")).select("bucket", "c.*").select("bucket", *as_other)
        else:
            sizes = open_.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
            largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m")).select("bucket", F.col("m.component").alias("largest"))
            others = open_.join(largest, "bucket").where("component != largest").select("bucket", *as_other)
        pairs = open_.join(others, "bucket").where(F.expr("component != other_component") & _may_be_similar(s))
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count() == 0:
            if attempt is None:
                break
            continue
        found = materialize(linked(docs, pairs, s), "links")
        tested = tested.unionByName(pairs)
        if found.limit(1).count():
            links = links.unionByName(found)
            components = materialize(connected_components(links), "components")

    result = signed.select("doc_id", "n_shingles", "digest").join(nodes, "digest", "left").join(components, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the near duplicates of documents with a smaller id."""
    gone = near_duplicates(docs, settings).where("not kept").select("doc_id").distinct()
    gone, _ = broadcast_if_small(materialize(gone, "duplicates"), 2_000_000)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
