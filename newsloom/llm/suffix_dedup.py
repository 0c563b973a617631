"""Repeated substrings by ranks of positions that double in reach.

A byte goes when a string of ``length`` bytes that covers it also starts earlier. Suffix arrays by prefix
doubling rank positions by a few bytes, then by pairs of ranks at growing offsets, and drop positions once they
are unique or the reach passes the threshold. A row per byte and round doesn't fit any sensible disk, so
the positions are thinned without loss:

* The start is the rank by ``gram`` bytes of *anchors*: in every window of ``length`` bytes the gram with the
  smallest hash. Equal windows have equal anchors at equal places, so no repeat is missed.
* Anchors are sorted by the pair of their rank and the rank of their reach, all bytes that a
  window around the anchor can touch. A unique gram is dropped. Every anchor but the first of equal reach
  is past the threshold: all its windows occur earlier.
* What is left, the first of each reach with other reaches beside it, is where repeats begin or end. There
  every window is ranked on its own, among those of its gram.

Ranks are names: hashes that stand for equal strings, of 128 bits together with the gram's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bytes_of, map_texts, pieces_of
from newsloom.llm.spans import without_spans
from newsloom.session import broadcast_if_small, materialize

# Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Settings:
    """Length of the strings and of the grams; texts are read ``segment`` bytes at a time.

    Grams with up to ``group_rows`` undecided anchors are compared within a task, others row by row.
    """

    length: int = 100
    gram: int = 24
    segment: int = 4 << 20
    group_rows: int = 50_000
    seed: int = 9


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


class Names:
    """Hashes of any substring of a text from running sums: sum(code[b_i] base^i), shifted to a common power."""

    def __init__(self, s: Settings):
        self.codes = np.random.default_rng(s.seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 1 << 16)
            inverse = pow(BASE, -1, 1 << 64)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])

    def read(self, data: np.ndarray) -> None:
        self._grow(len(data))
        sums = np.cumsum(self.codes[data] * self.powers[: len(data)], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts])

    def of_all(self, size: int) -> np.ndarray:
        """Of every run of ``size`` bytes."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.inverses[:n])


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """Best of every run of ``size`` values."""
    reach = 1
    while 2 * reach <= size:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    rest = size - reach
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def anchors_of(names: Names, s: Settings) -> np.ndarray:
    """Positions whose gram has the smallest hash of some window of the text that ``names`` has read."""
    n = len(names.sums) - 1
    if n < s.length:
        return np.zeros(0, np.int64)
    grams = names.of_all(s.gram)
    width = s.length - s.gram + 1
    lowest = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, lowest, edge]), width, np.maximum)
    return np.flatnonzero(highest == grams)


def _segments(raw: bytes, s: Settings) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """``first, last, data, offset``: anchors in [first, last) of the text can be found in ``data``."""
    slack = 2 * s.length
    for first in range(0, len(raw), s.segment):
        last = min(len(raw), first + s.segment)
        offset = max(0, first - slack)
        yield first, last, np.frombuffer(raw, np.uint8, min(len(raw), last + slack) - offset, offset), offset


KINDS = "key long, reach long, doc_id long, start long, end long, place long"


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in KINDS.split(", ")])


def _anchor_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """Anchors with their reach ``[start, end)``; repeats within a batch are marked by a negative place.

    Of equal reaches in a batch only the first goes on, so a passage that a third of all rows share sends
    one row per batch to the task of its gram. The others are known to be covered: their key is spread.
    """

    def run(batches):
        names = Names(s)
        for whole in batches:
            for batch in pieces_of(whole):
                found = []
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), bytes_of(batch), strict=True):
                    if doc_id is None or len(raw) < s.length:
                        continue
                    for first, last, data, offset in _segments(raw, s):
                        names.read(data)
                        p = anchors_of(names, s)
                        p = p[(p + offset >= first) & (p + offset < last)]
                        start, end = np.maximum(p - (s.length - s.gram), 0), np.minimum(p + s.length, len(data))
                        shape = (p - start).astype(np.uint64) << np.uint64(32) | (end - p).astype(np.uint64)
                        reach = _mix(names.of(start, end) + shape * np.uint64(BASE))
                        found.append((names.of(p, p + s.gram), reach, np.full(len(p), doc_id), start + offset, end + offset, p + offset))
                if not found:
                    continue
                key, reach, doc, start, end, place = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((place, doc, reach, key))
                key, reach, doc, start, end, place = (c[order] for c in (key, reach, doc, start, end, place))
                again = np.r_[False, (key[1:] == key[:-1]) & (reach[1:] == reach[:-1])]
                yield _rows([key[~again], reach[~again], doc[~again], start[~again], end[~again], place[~again]])
                if again.any():
                    doc, start, end = _joined(doc[again], start[again], end[again])
                    yield _rows([_mix(doc.astype(np.uint64)), np.zeros_like(doc), doc, start, end, np.full(len(doc), -1)])

    return map_texts(docs, run, KINDS)


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with those that touch their predecessor in the same document joined; spans have like lengths."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    return doc[new], start[new], np.maximum.reduceat(end, new)


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Covered spans (negative place) and undecided anchors, from rows sorted by key, reach and position."""

    def run(batches):
        last_key = last_reach = None
        held: list[np.ndarray] | None = None  # the first row of the last gram, while no other reach has come
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, reach, place = columns[0], columns[1], columns[5]
            same_key = np.r_[last_key is not None and key[0] == last_key, key[1:] == key[:-1]]
            same = same_key & np.r_[last_reach is not None and reach[0] == last_reach, reach[1:] == reach[:-1]]
            known = place < 0
            live = ~known
            covered = (same & live) | known
            firsts = np.flatnonzero(live & ~same)
            fresh = ~same_key[firsts]
            last_key, last_reach = key[-1], reach[-1]
            undecided = firsts[~fresh].tolist()
            starts = np.flatnonzero(fresh)
            if held is not None and len(firsts) and not fresh[0]:
                yield _rows(held)
                held = None
            undecided += [int(firsts[i]) for i in starts if i + 1 < len(firsts) and not fresh[i + 1]]
            if len(starts):
                i = int(starts[-1])
                held = None if i + 1 < len(firsts) else [c[firsts[i] : firsts[i] + 1] for c in columns]
            if covered.any():
                doc, start, end = _joined(*(c[covered] for c in columns[2:5]))
                yield _rows([np.zeros_like(doc), np.zeros_like(doc), doc, start, end, np.full(len(doc), -1)])
            if undecided:
                yield _rows([c[undecided] for c in columns])

    return rows.repartition("key").sortWithinPartitions("key", "reach", "doc_id", "place").mapInArrow(run, KINDS)


def _contexts(docs: DataFrame, undecided: DataFrame, s: Settings) -> DataFrame:
    """``key, doc_id, place, start, context``: the bytes that the windows around each undecided anchor touch."""
    lists = undecided.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set("place")).alias("places"))
    lists, _ = broadcast_if_small(materialize(lists, "places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= s.length)
    joined = texts.join(lists, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "places")
    schema = "key long, doc_id long, place long, start long, context binary"
    types = [pa.int64()] * 4 + [pa.binary()]

    def run(batches):
        names = Names(s)
        for whole in batches:
            for batch in pieces_of(whole, 1 << 20):
                rows: list[tuple] = []
                for doc_id, raw, places in zip(
                    batch.column("doc_id").to_pylist(), bytes_of(batch), batch.column("places").to_pylist(), strict=True
                ):
                    grams = np.frombuffer(b"".join(raw[p : p + s.gram] for p in places), np.uint8)
                    names.read(grams)
                    at = np.arange(len(places)) * s.gram
                    for p, key in zip(places, names.of(at, at + s.gram).view(np.int64).tolist(), strict=True):
                        start = max(0, p - (s.length - s.gram))
                        rows.append((key, doc_id, p, start, raw[start : p + s.length]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], [x.split()[0] for x in schema.split(", ")]
                )

    return joined.mapInArrow(run, schema)


def _windows_of(batch: pa.RecordBatch, names: Names, s: Settings) -> tuple[np.ndarray, ...]:
    """Row, place of the anchor in the window, name and start in the document of every window of the contexts."""
    texts = batch.column("context").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    names.read(np.frombuffer(b"".join(texts), np.uint8))
    counts = np.maximum(0, sizes - s.length + 1)
    row = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[row] + within
    place, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "start"))
    return row, (place - start)[row] - within, names.of(at, at + s.length), start[row] + within


def _repeated_in_groups(contexts: DataFrame, s: Settings) -> DataFrame:
    """Spans of windows that occur earlier, gram by gram; a task holds the names of one gram's windows."""

    def run(batches):
        names, open_key = Names(s), None
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))  # windows of the last gram so far
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                key, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id"))
                group = np.cumsum(np.r_[key[0] != open_key, key[1:] != key[:-1]])
                row, inside, name, start = _windows_of(batch, names, s)
                shape = group[row] * s.length + inside
                if group[0]:
                    held = (held[0][:0], held[1][:0])
                shapes, all_names = np.r_[held[0], shape], np.r_[held[1], name]
                order = np.lexsort((np.arange(len(shapes)), all_names, shapes))
                shapes, all_names = shapes[order], all_names[order]
                again = np.r_[False, (shapes[1:] == shapes[:-1]) & (all_names[1:] == all_names[:-1])]
                found = order[again] - len(held[0])
                if len(found):
                    d, a, b = _joined(doc[row[found]], start[found], start[found] + s.length)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, a, b)], ["doc_id", "start", "end"])
                last = ~again & (shapes >= group[-1] * s.length)
                held = (shapes[last] - group[-1] * s.length, all_names[last])
                open_key = key[-1]

    order = ("key", "doc_id", "place")
    return contexts.repartition("key").sortWithinPartitions(*order).mapInArrow(run, "doc_id long, start long, end long")


def _repeated_by_rows(contexts: DataFrame, s: Settings) -> DataFrame:
    """The same for grams of any number of rows: one row per window, spread by its name."""

    def run(batches):
        names = Names(s)
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                key, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id"))
                row, inside, name, start = _windows_of(batch, names, s)
                shape = key[row].view(np.uint64) + inside.astype(np.uint64) * np.uint64(BASE)
                arrays = [shape.view(np.int64), name.view(np.int64), doc[row], start]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["key", "name", "doc_id", "start"])

    windows = contexts.mapInArrow(run, "key long, name long, doc_id long, start long")
    firsts = windows.groupBy("key", "name").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = windows.join(firsts.where("n > 1").select("key", "name", "first"), ["key", "name"]).where("struct(doc_id, start) > first")
    return again.select("doc_id", "start", (F.col("start") + s.length).alias("end"))


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, start, end``: bytes of documents that an earlier equal string of ``length`` bytes covers."""
    s = settings
    sorted_out = materialize(_sorted_out(_anchor_rows(docs, s)), "anchors")
    spans = sorted_out.where("place < 0").select("doc_id", "start", "end")
    undecided = sorted_out.where("place >= 0").select("key", "doc_id", "place")
    large = materialize(undecided.groupBy("key").count().where(F.col("count") > s.group_rows).select("key"), "large_grams")
    if large.limit(1).count():
        large, _ = broadcast_if_small(large)
        spans = spans.unionByName(_repeated_by_rows(_contexts(docs, undecided.join(large, "key", "left_semi"), s), s))
        undecided = undecided.join(large, "key", "left_anti")
    return spans.unionByName(_repeated_in_groups(_contexts(docs, undecided, s), s))


def dedup_suffixes(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """Documents without repeated strings, as ``without_spans`` returns them.

    One row per row of ``docs``; NULL and empty texts have no bytes. Rows with a NULL id stay whole. Rows
    that share an id are taken for one document. Other columns are ignored.
    """
    return without_spans(docs, materialize(repeated_spans(docs, settings), "repeated_spans"), with_text)
