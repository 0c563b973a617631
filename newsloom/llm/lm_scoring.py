"""Language-model scoring: interpolated modified Kneser-Ney over words, two at a time.

Counts come from all training documents: tasks count within pieces of text, Spark brings equal words and
pairs together, and every shard of the counts is written once as sorted arrays to the shared folder.
Workers map the files into memory and look words and pairs up by binary search, so a worker's own
memory doesn't grow with the model.

A word's number is its place among the sorted hashes of all words; a pair is one number made of two.
Pairs are dealt to shards by their first word, those of very frequent words by their second, so that no
shard holds more than its share. A token is a lower-cased word or the end of a text.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, bytes_of, id_remainder, map_texts, pieces_of
from newsloom.session import materialize, scratch_path

WORDS = re.compile(WORD)
END = 0  # stands for the hash of the end token
REMEMBERED = 500_000


@dataclass(frozen=True)
class Settings:
    """Bytes of text per shard of the word and of the pair counts, and per piece that a task counts at once."""

    word_shard_bytes: int = 64 << 20
    pair_shard_bytes: int = 16 << 20
    piece_bytes: int = 8 << 20


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that go with them."""

    folder: str
    word_base: list[int] = field(default_factory=lambda: [0])  # first number of every word shard, then V
    pair_shards: int = 1
    tokens: int = 0
    documents: int = 0
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_kinds: int = 0  # different pairs
    word_rest: float = 1.0  # share of the lower order that goes to the uniform distribution
    frequent: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # pairs seen once, twice, more often

    @property
    def words(self) -> int:
        return self.word_base[-1]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word) or 1
        return value


def token_hashes(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, end tokens included, and the number of tokens of each."""
    parts, counts = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = WORDS.findall(text.lower())
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        parts.append(np.full(1, END, np.uint64))
        counts[i] = len(words) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def _previous(ids: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The token before each, ``start`` for the first of a text."""
    before = np.r_[np.int64(start), ids[:-1]]
    before[np.cumsum(counts) - counts] = start
    return before


def _long_rows(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False), pa.int64()) for c in columns], names)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array so that a repeated or doubled task leaves one whole file."""
    path = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(path, "wb") as out:
        np.save(out, array)
    os.replace(path, f"{folder}/{name}.npy")


class Arrays:
    """The files of a model, mapped when first used."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[str, np.ndarray] = {}
        self.base = np.array(model.word_base, np.int64)

    def get(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = np.load(f"{self.model.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending ``hashes``, -1 for unknown ones."""
        shards = len(self.base) - 1
        ids = np.full(len(hashes), -1, np.int64)
        for shard, part in _runs(_shard_of_hash(hashes, shards)):
            stored = self.get(f"words-{shard}")
            if len(stored):
                at = np.minimum(np.searchsorted(stored, hashes[part]), len(stored) - 1)
                ids[part] = np.where(stored[at] == hashes[part], at + self.base[shard], -1)
        return ids

    def of_words(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array that runs along the word numbers, for ascending ``ids``."""
        result = np.zeros(len(ids), np.int64)
        for shard, part in _runs(np.searchsorted(self.base, ids, side="right") - 1):
            result[part] = self.get(f"{name}-{shard}")[ids[part] - self.base[shard]]
        return result

    def of_firsts(self, ids: np.ndarray) -> np.ndarray:
        """Pairs seen once, twice and more often, for ascending first words ``ids``."""
        m = self.model
        result = np.zeros((len(ids), 3), np.int64)
        for shard, part in _runs(_shard_of_first(ids, m)):
            low = _first_of_shard(shard, m)
            result[part] = self.get(f"firsts-{shard}")[ids[part] - low]
        for i in np.flatnonzero(np.isin(ids, np.fromiter(m.frequent, np.int64, len(m.frequent)))):
            result[i] = m.frequent[int(ids[i])]
        return result

    def pair_counts(self, firsts: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        m = self.model
        keys, shards = _pair_keys(firsts, seconds, m), _pair_shard(firsts, seconds, m)
        order = np.lexsort((keys, shards))
        keys, shards = keys[order], shards[order]
        counts = np.zeros(len(keys), np.int64)
        for shard, part in _runs(shards):
            stored = self.get(f"pairs-{shard}")
            if len(stored):
                at = np.minimum(np.searchsorted(stored, keys[part]), len(stored) - 1)
                counts[part] = np.where(stored[at] == keys[part], self.get(f"counts-{shard}")[at], 0)
        result = np.empty_like(counts)
        result[order] = counts
        return result


def _runs(ascending: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Values of an ascending array with the slice each fills."""
    edges = np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1], True]) if len(ascending) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(ascending[a]), slice(int(a), int(b))


def _shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _shard_of_first(ids: np.ndarray, m: Model) -> np.ndarray:
    return ids * m.pair_shards // (m.words + 1)  # the number V stands for the start of a text


def _first_of_shard(shard: int, m: Model) -> int:
    return -(-shard * (m.words + 1) // m.pair_shards)


def _pair_keys(firsts: np.ndarray, seconds: np.ndarray, m: Model) -> np.ndarray:
    return firsts.astype(np.int64) * (m.words + 1) + seconds


def _pair_shard(firsts: np.ndarray, seconds: np.ndarray, m: Model) -> np.ndarray:
    shard = _shard_of_first(firsts, m)
    if m.frequent:
        often = np.isin(firsts, np.fromiter(m.frequent, np.int64, len(m.frequent)))
        shard[often] = seconds[often] * 0x9E3779B1 % 0xFFFFFFFB % m.pair_shards
    return shard


def _discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many were seen once to four times, 0.1 at least."""
    n1, n2, n3, n4 = (max(1, n) for n in counts)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.1), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *discounts])[np.minimum(counts, 3)]


def _local(path: str) -> str:
    """The shared folder as a path that workers can map into memory."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError("the model's arrays are mapped into memory: spark.checkpoint.dir must be a mounted folder")
    return path


def _train_words(docs: DataFrame, model: Model, shards: int, s: Settings) -> None:
    """Write ``words-i`` and ``totals-i``; set the numbering and the number of tokens."""

    def count(batches):
        known = _WordHashes()
        for whole in batches:
            for batch in pieces_of(whole, s.piece_bytes):
                hashes, n = np.unique(token_hashes(bytes_of(batch), known)[0], return_counts=True)
                yield _long_rows(["h", "n", "shard"], [hashes.view(np.int64), n, _shard_of_hash(hashes, shards)])

    folder = model.folder

    def write(batches):
        shard, h, n = _gathered(batches, ["shard", "h", "n"])
        h = h.view(np.uint64)
        order = np.lexsort((h, shard))
        for i, part in _runs(shard[order]):
            rows = order[part]
            new = np.flatnonzero(np.r_[True, h[rows][1:] != h[rows][:-1]])
            totals = np.add.reduceat(n[rows], new)
            _save(folder, f"words-{i}", h[rows][new])
            _save(folder, f"totals-{i}", totals)
            yield _long_rows(["shard", "words", "tokens"], [np.array([x]) for x in (i, len(new), totals.sum())])

    dealt = map_texts(docs, count, "h long, n long, shard long").repartition(shards, "shard")
    sizes = {r["shard"]: r for r in dealt.mapInArrow(write, "shard long, words long, tokens long").collect()}  # a row per shard
    for i in range(shards):
        if i not in sizes:
            _save(folder, f"words-{i}", np.zeros(0, np.uint64))
            _save(folder, f"totals-{i}", np.zeros(0, np.int64))
    model.word_base = np.cumsum([0, *(sizes[i]["words"] if i in sizes else 0 for i in range(shards))]).tolist()
    model.tokens = sum(r["tokens"] for r in sizes.values())


def _gathered(batches, names: list[str]) -> list[np.ndarray]:
    """Columns of all batches of a task; the number of shards bounds their length."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)


def _find_frequent(spark, model: Model) -> None:
    """Words with more than one shard's share of the tokens: fewer than there are shards."""
    least = max(1, model.tokens // model.pair_shards)
    folder, base = model.folder, model.word_base

    def often(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                found = np.flatnonzero(np.load(f"{folder}/totals-{i}.npy", mmap_mode="r") > least)
                yield _long_rows(["word"], [found + base[i]])

    shards = spark.range(0, len(base) - 1, 1, len(base) - 1)
    model.frequent = {r["word"]: (0, 0, 0) for r in shards.mapInArrow(often, "word long").collect()} if model.pair_shards > 1 else {}
    if model.documents > least and model.pair_shards > 1:
        model.frequent[model.words] = (0, 0, 0)


def _train_pairs(docs: DataFrame, model: Model, s: Settings) -> None:
    """Write ``pairs-i``, ``counts-i``, ``firsts-i`` and ``before-i``; set discounts and what belongs to them."""
    spark, shards = docs.sparkSession, model.pair_shards
    _find_frequent(spark, model)

    def count(batches):
        known, arrays = _WordHashes(), Arrays(model)
        for whole in batches:
            for batch in pieces_of(whole, s.piece_bytes):
                hashes, counts = token_hashes(bytes_of(batch), known)
                distinct, where = np.unique(hashes, return_inverse=True)
                ids = arrays.word_ids(distinct)[where]
                keys, n = np.unique(_pair_keys(_previous(ids, counts, model.words), ids, model), return_counts=True)
                yield _long_rows(["key", "n", "shard"], [keys, n, _pair_shard(*np.divmod(keys, model.words + 1), model)])

    def write(batches):
        shard, key, n = _gathered(batches, ["shard", "key", "n"])
        order = np.lexsort((key, shard))
        for i, part in _runs(shard[order]):
            rows = order[part]
            keys = key[rows]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, totals = keys[new], np.add.reduceat(n[rows], new)
            firsts, seconds = np.divmod(keys, model.words + 1)
            _save(model.folder, f"pairs-{i}", keys)
            _save(model.folder, f"counts-{i}", totals.astype(np.uint8 if totals.max() < 256 else np.uint32 if totals.max() < 1 << 32 else np.uint64))
            low, high = _first_of_shard(i, model), _first_of_shard(i + 1, model)
            own = (firsts >= low) & (firsts < high)
            kinds = np.minimum(totals, 3) - 1
            table = np.bincount((firsts[own] - low) * 3 + kinds[own], minlength=3 * (high - low)).reshape(-1, 3)
            _save(model.folder, f"firsts-{i}", table.astype(np.uint32 if table.size == 0 or table.max() < 1 << 32 else np.uint64))
            names = ["kind", "id", "a", "b", "c", "d"]
            words, times = np.unique(seconds, return_counts=True)
            nothing = np.zeros(len(words), np.int64)
            yield _long_rows(names, [nothing, words, times, nothing, nothing, nothing])
            seen = [np.array([(totals == k).sum()]) for k in (1, 2, 3, 4)]
            yield _long_rows(names, [np.array([1]), np.array([len(keys)]), *seen])
            for word in model.frequent:
                split = np.bincount(kinds[firsts == word], minlength=3)
                if split.any():
                    yield _long_rows(names, [np.array([x]) for x in (2, word, *split, 0)])

    dealt = map_texts(docs, count, "key long, n long, shard long").repartition(shards, "shard")
    found = materialize(dealt.mapInArrow(write, "kind long, id long, a long, b long, c long, d long"), "pair_counts")
    sums = [F.sum(c).alias(c) for c in "abcd"]
    row = found.where("kind = 1").agg(F.sum("id").alias("id"), *sums).first()
    model.pair_kinds = row["id"] or 0
    model.pair_discounts = _discounts([row[c] or 0 for c in "abcd"])
    for r in found.where("kind = 2").groupBy("id").agg(*sums).collect():  # fewer than there are shards
        model.frequent[r["id"]] = (r["a"], r["b"], r["c"])

    base = np.array(model.word_base, np.int64)
    folder = model.folder
    present = [f"{i}" for i in range(shards) if not os.path.exists(f"{folder}/pairs-{i}.npy")]
    for i in map(int, present):
        _save(folder, f"pairs-{i}", np.zeros(0, np.int64))
        _save(folder, f"counts-{i}", np.zeros(0, np.uint8))
        _save(folder, f"firsts-{i}", np.zeros((_first_of_shard(i + 1, model) - _first_of_shard(i, model), 3), np.uint32))

    def shard_column(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield _long_rows(["id", "n", "shard"], [ids, batch.column("a").to_numpy(zero_copy_only=False), np.searchsorted(base, ids, side="right") - 1])

    def write_before(batches):
        shard, ids, n = _gathered(batches, ["shard", "id", "n"])
        order = np.argsort(shard, kind="stable")
        for i, part in _runs(shard[order]):
            rows = order[part]
            kinds = np.bincount(ids[rows] - base[i], n[rows], minlength=base[i + 1] - base[i]).astype(np.int64)
            _save(folder, f"before-{i}", kinds.astype(np.uint32 if kinds.max() < 1 << 32 else np.uint64))
            seen = [np.array([(kinds == k).sum()]) for k in (1, 2, 3, 4)]
            yield _long_rows(["a", "b", "c", "d", "more"], [*seen, np.array([(kinds > 2).sum()])])

    after = found.where("kind = 0").select("id", "a").mapInArrow(shard_column, "id long, n long, shard long")
    seen = after.repartition(len(base) - 1, "shard").mapInArrow(write_before, "a long, b long, c long, d long, more long").collect()
    total = [sum(r[c] for r in seen) for c in ("a", "b", "c", "d", "more")]
    model.word_discounts = _discounts(total[:4])
    d1, d2, d3 = model.word_discounts
    model.word_rest = (d1 * total[0] + d2 * total[1] + d3 * total[4]) / model.pair_kinds


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Count all ``docs`` with an id whose ``crc32(doc_id as text) mod 7`` is not 2; NULL texts count as empty ones."""
    s = settings
    spark = docs.sparkSession
    training = docs.where(F.col("doc_id").isNotNull()).where(id_remainder(F.col("doc_id"), 7) != 2)
    row = training.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    model = Model(_local(scratch_path(spark, "language_model")), documents=row["n"])
    os.makedirs(model.folder, exist_ok=True)
    if not row["n"]:
        return model
    size = row["bytes"] or 0
    _train_words(training, model, 1 + size // s.word_shard_bytes, s)
    if (model.words + 1) ** 2 >= 1 << 63:
        raise ValueError("more words than a pair of them fits 64 bits")
    model.pair_shards = 1 + size // s.pair_shard_bytes
    _train_pairs(training, model, s)
    return model


def token_scores(hashes: np.ndarray, counts: np.ndarray, arrays: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token its count in training, its log10 base probability and its log10 model probability."""
    m = arrays.model
    distinct, where = np.unique(hashes, return_inverse=True)
    if not m.tokens:
        zero = np.zeros(len(hashes))
        return zero.astype(np.int64), zero, zero
    ids = arrays.word_ids(distinct)
    known = ids >= 0
    total, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    total[known], before[known] = arrays.of_words("totals", ids[known]), arrays.of_words("before", ids[known])
    base = np.log10((total + 1) / (m.tokens + m.words + 1))
    lower = _discounted(before, m.word_discounts) / m.pair_kinds + m.word_rest / (m.words + 1)

    # the last word is the start of a text
    kinds, times = np.zeros((len(ids) + 1, 3), np.int64), np.zeros(len(ids) + 1, np.int64)
    kinds[:-1][known] = arrays.of_firsts(ids[known])
    kinds[-1] = arrays.of_firsts(np.array([m.words]))[0]
    times[:-1], times[-1] = total, m.documents
    rest = np.where(times > 0, kinds @ np.array(m.pair_discounts) / np.maximum(1, times), 1.0)

    here = where.astype(np.int64)
    pairs, which = np.unique(_previous(here, counts, len(ids)) * len(ids) + here, return_inverse=True)
    first, second = np.divmod(pairs, len(ids))
    numbers = np.r_[ids, m.words]
    both = (numbers[first] >= 0) & (ids[second] >= 0)
    seen = np.zeros(len(pairs), np.int64)
    seen[both] = arrays.pair_counts(numbers[first[both]], ids[second[both]])
    p = _discounted(seen, m.pair_discounts) / np.maximum(1, times[first]) + rest[first] * lower[second]
    return total[where], base[where], np.log10(p)[which]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    NULL and empty texts are their end token alone. Rows with a NULL id are scored, not learned from and not
    held out. Repeated rows score alike; other columns are ignored. Without training text all
    probabilities are those of an empty vocabulary, 1.
    """
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, perplexity double"
    )

    def run(batches):
        known, arrays = _WordHashes(), Arrays(model)
        for whole in batches:
            for batch in pieces_of(whole, 4 << 20):
                hashes, counts = token_hashes(bytes_of(batch), known)
                total, base, own = token_scores(hashes, counts, arrays)
                starts = np.cumsum(counts) - counts
                scores = np.add.reduceat(own, starts)
                columns = [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(counts),
                    pa.array(np.add.reduceat((total > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(counts), model.tokens)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(scores),
                    pa.array(10 ** np.minimum(300, -scores / counts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    held_out = (id_remainder(docs["doc_id"], 7) == 2).alias("held_out")
    return map_texts(docs, run, schema, held_out)
