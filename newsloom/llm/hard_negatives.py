"""Hard-negative mining with a secondary-sort shuffle.

Rows are scored against the anchors in blocks, by matrix products inside tasks. Scored pairs travel under
packed keys of anchor, descending score and id; the shuffle sorts by the key within partitions, and an
iterator reads each anchor's pairs in that order: a positive opens a window below its score, negatives
are emitted into the windows open for them. An anchor's pairs are never held. Before the shuffle every
task keeps the pairs that can still be among the first of a window, which loses none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize, measure

# Bytes of anchors that are sent to the tasks at once.
ANCHOR_BLOCK_BYTES = 8 << 20
# Scores held at once by a task.
SCORES_AT_ONCE = 1 << 22
# Below this, sums of products of doubles are exact.
EXACT_DOUBLES = 2**53
LEAST, MOST = -(2**63), 2**63 - 1
POSITIVE, NEGATIVE = 0, 1


@dataclass(frozen=True)
class Settings:
    """First ``positives`` per anchor; first ``negatives`` per positive from ``low_percent`` of its score up to it."""

    positives: int = 5
    negatives: int = 5
    low_percent: int = 80

    def lowest(self, score: int) -> int:
        """Least integer score that is at least the share of ``score``."""
        return -((-self.low_percent * score) // 100)


def whole_vectors(vector: Column, scale: int = 256) -> Column:
    """Components as ``floor(scale * x)``; NULL for a NULL vector or one with a NULL or non-finite component."""
    numbers = vector.cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(numbers, lambda x: F.floor(F.lit(float(scale)) * x)))


def _matrix(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length; only equal lengths have a score."""
    lengths = np.array([len(v) for v in vectors], dtype=np.int64)
    return {int(n): (at := np.flatnonzero(lengths == n), np.array([vectors[i] for i in at], dtype=np.int64).reshape(len(at), n)) for n in np.unique(lengths)}


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; beyond 64 bits the nearest 64-bit integer."""
    bound = a.shape[1] * int(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))) * int(max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))))
    if bound < EXACT_DOUBLES:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound <= MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


@dataclass
class _Windows:
    """Score windows of a block of anchors, with the best pairs a task has seen for each."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    anchor: np.ndarray  # position of each window's anchor
    low: np.ndarray
    high: np.ndarray
    same: bool
    keep: int

    def __post_init__(self):
        empty = np.empty(0, np.int64)
        self.best = (empty, empty, empty)  # window, score, id
        self.floor = self.low.copy()

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: list) -> None:
        for n, (at, rows) in _matrix(vectors).items():
            if n not in self.vectors:
                continue
            mine, matrix = self.vectors[n]
            place = np.full(len(self.ids), -1)
            place[mine] = np.arange(len(mine))
            windows = np.flatnonzero(place[self.anchor] >= 0)
            column = place[self.anchor[windows]]
            step = max(1, SCORES_AT_ONCE // max(1, len(matrix), len(windows)))
            for i in range(0, len(at), step):
                self._add(ids[at[i : i + step]], labels[at[i : i + step]], _products(rows[i : i + step], matrix)[:, column], windows)

    def _add(self, ids, labels, scores, windows) -> None:
        anchors = self.anchor[windows]
        fits = (scores >= self.floor[windows]) & (scores <= self.high[windows])
        fits &= (labels[:, None] == self.labels[anchors]) == self.same
        fits &= ids[:, None] != self.ids[anchors]
        row, column = np.nonzero(fits)
        window, score, found = (np.concatenate(x) for x in zip(self.best, (windows[column], scores[row, column], ids[row]), strict=True))
        order = np.lexsort((found, ~score, window))
        window, score, found = window[order], score[order], found[order]
        start = np.searchsorted(window, window)
        first = np.arange(len(window)) - start < self.keep
        self.best = window, score, found = window[first], score[first], found[first]
        # a full window takes no score below its last
        last = np.flatnonzero(np.arange(len(window)) - np.searchsorted(window, window) == self.keep - 1)
        self.floor[window[last]] = np.maximum(self.floor[window[last]], score[last])

    def pairs(self, kind: int) -> pa.RecordBatch:
        window, score, found = self.best
        columns = (self.ids[self.anchor[window]], score, np.full(len(window), kind, np.int64), found)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "score", "kind", "id"])


PAIR_SCHEMA = "anchor long, score long, kind long, id long"


def _scored(rows: DataFrame, block: dict, windows: tuple, same: bool, keep: int, kind: int) -> DataFrame:
    """The first ``keep`` pairs that each task finds for every window."""

    def run(batches):
        seen = _Windows(block["ids"], block["labels"], _matrix(block["vectors"]), *windows, same, keep)
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label", "vector")]
            seen.add(columns[0].astype(np.int64), columns[1].astype(np.int64), list(columns[2]))
        yield seen.pairs(kind)

    return rows.select("id", "label", "vector").mapInArrow(run, PAIR_SCHEMA)


def packed_key(anchor: Column, score: Column, kind: Column, row_id: Column) -> Column:
    """Sortable key: anchor, descending score, positives before negatives, id."""
    parts = (anchor, F.bitwise_not(score), kind, row_id)
    # the sign bit turned, so that the hexadecimal digits of the bits sort as the numbers do
    return F.concat(*(F.lpad(F.hex(p.bitwiseXOR(F.lit(LEAST))), 16, "0") for p in parts))


def unpacked_key(key: str) -> tuple[int, int, int, int]:
    anchor, score, kind, row_id = (x - 2**63 for x in struct.unpack(">4Q", bytes.fromhex(key)))
    return anchor, ~score, kind, row_id


def windows_of(keys: Iterator[str], settings: Settings) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``anchor, positive, rank, negative, positive score, negative score`` from sorted keys.

    Holds the open windows of one anchor. Scores fall, so a window is shut for good once a score is below
    its lower end; equal scores bring the positives first.
    """
    current, opened, count, last = None, [], 0, None
    for key in keys:
        if key == last:  # tasks find a row once each; a window may be named by several
            continue
        last = key
        anchor, score, kind, row_id = unpacked_key(key)
        if anchor != current:
            current, opened, count = anchor, [], 0
        if kind == POSITIVE:
            if count < settings.positives:
                count += 1
                opened.append([row_id, score, settings.lowest(score), 0])
            continue
        opened = [w for w in opened if w[2] <= score and w[3] < settings.negatives]
        for window in opened:
            if score <= window[1]:
                window[3] += 1
                yield anchor, window[0], window[3], row_id, window[1], score


RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _stream(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The secondary sort: dealt by anchor, sorted by the packed key, read once."""

    def run(batches):
        names = [x.split()[0] for x in RESULT_SCHEMA.split(", ")]
        types = [pa.int32() if n == "rank" else pa.int64() for n in names]
        found = windows_of((k for b in batches for k in b.column("key").to_pylist()), settings)
        rows: list[tuple] = []

        def batch():
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for row in found:
            rows.append(row)
            if len(rows) >= 8192:
                yield batch()
        yield batch()

    keyed = pairs.select("anchor", packed_key(F.col("anchor"), F.col("score"), F.col("kind"), F.col("id")).alias("key"))
    return keyed.repartition("anchor").sortWithinPartitions("key").select("key").mapInArrow(run, RESULT_SCHEMA)


def _blocks(anchors: DataFrame) -> Iterator[dict]:
    """Anchors in blocks of bounded size; the driver holds one at a time."""
    n, size = measure(anchors)
    blocks = max(1, -(-size // ANCHOR_BLOCK_BYTES))
    dealt = anchors.withColumn("_block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)))
    for b in range(blocks if n else 0):
        rows = dealt.where(F.col("_block") == b).select("id", "label", "vector").collect()
        yield {
            "ids": np.array([r["id"] for r in rows], np.int64),
            "labels": np.array([r["label"] for r in rows], np.int64),
            "vectors": [np.array(r["vector"], np.int64) for r in rows],
        }


def hard_negatives(rows: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """Negatives just below each positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``id``, ``label`` and ``vector`` (whole numbers); ``is_anchor`` picks the anchors. A score is the
    inner product; pairs go by descending score, then id. Rows with a NULL in any of the three take no part,
    copies of a row count once, and rows that share an id are never each other's partners. Several anchor
    rows of one id are one anchor, the least by label and vector. Vectors of unequal length have no score;
    beyond 64 bits a score is the nearest 64-bit integer. Other columns are ignored; an empty table, or one
    without anchors, gives no rows. Each block of anchors costs two scans of the rows.
    """
    spark = rows.sparkSession
    sound = rows.select(
        F.col("id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<long>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)")
    table = materialize(sound.distinct(), "vectors")
    anchors = materialize(
        table.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector"), "anchors"
    )
    pairs = None
    for block in _blocks(anchors):
        count = len(block["ids"])
        everything = (np.arange(count), np.full(count, LEAST), np.full(count, MOST))
        near = _scored(table, block, everything, True, settings.positives, POSITIVE)
        rank = F.row_number().over(_by_anchor())
        near = materialize(near.distinct().withColumn("_rank", rank).where(F.col("_rank") <= settings.positives).drop("_rank"), "positives")
        place = {a: i for i, a in enumerate(block["ids"].tolist())}
        # a positive with a score below zero has an empty window
        held = sorted({(place[r["anchor"]], settings.lowest(r["score"]), r["score"]) for r in near.where("score >= 0").collect()})
        windows = tuple(np.array([w[i] for w in held], np.int64) for i in range(3))
        both = near.union(_scored(table, block, windows, False, settings.negatives, NEGATIVE))
        pairs = both if pairs is None else pairs.union(both)
    if pairs is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return _stream(pairs, settings)


def _by_anchor():
    from pyspark.sql import Window

    return Window.partitionBy("anchor").orderBy(F.desc("score"), "id")


def mine(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the anchors whose ``vec_id`` is divisible by 100.

    Every seventh row has its label moved on, so that labels are noisy; components become ``floor(256 * x)``.
    """
    label = F.col("label").cast("long")
    rows = embeddings.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        whole_vectors(F.col("embedding")).alias("vector"),
    )
    return hard_negatives(rows, F.col("id") % 100 == 0)


NEGATIVES_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM sound a JOIN sound r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""
