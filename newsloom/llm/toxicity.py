"""Toxicity by subword bags.

A document is the average of the embeddings of its character n-grams (word edges included) and a
linear softmax reads it. Embeddings and softmax are trained together in numpy on a bounded sample of
labelled documents. An unseen misspelling shares most n-grams with words seen in training. Averaging and
the linear layer commute, so a trained model is one number per n-gram bucket and scoring is a mean.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bytes_of, id_remainder, map_batches, map_texts, pieces_of
from newsloom.session import materialize

# A to Z become a to z; separators and ASCII punctuation become spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256)
)
# Bytes of text scored at once; the n-grams take some eighty times as much.
SCORED_BYTES = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` toxic texts and ``clean_per_toxic`` times as many clean ones, of at most
    ``sample_chars`` characters each, bound the training sample."""

    sample_rows: int = 2000
    clean_per_toxic: int = 2
    sample_chars: int = 12_000
    bits: int = 18
    shortest: int = 3
    longest: int = 6
    dimensions: int = 6
    epochs: int = 6
    least_steps: int = 400
    scale: float = 100.0
    batch: int = 32
    rate: float = 0.1
    seed: int = 7
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Log odds per n-gram bucket, and the constant."""

    weights: np.ndarray
    constant: float
    settings: Settings


def ngram_buckets(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the text each belongs to. No n-gram crosses a word edge."""
    folded = [b" " + t.translate(FOLD) + b" " for t in texts]
    data = np.frombuffer(b"".join(folded), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in folded])
    mixed = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    blank = data == 32
    # blanks within data[i+1 .. i+n-2] are counted by a running sum
    before = np.concatenate(([0], np.cumsum(blank, dtype=np.int32)))
    value, ids, owners = mixed.copy(), [], []
    for n in range(2, s.longest + 1):
        value = value[:-1] * np.uint32(0x01000193) + mixed[n - 1 :]
        if n < s.shortest or not len(value):
            continue
        starts = np.flatnonzero(before[n - 1 : len(before) - 1] == before[1 : len(before) - n + 1])
        starts = starts[owner[starts] == owner[starts + n - 1]]
        hashed = (value[starts] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        ids.append(hashed >> np.uint32(32 - s.bits))
        owners.append(owner[starts])
    return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(owners or [np.zeros(0, np.int32)])


def train(texts: list[bytes], labels: list[int], s: Settings) -> Model:
    """Adagrad on the cross entropy of the two classes."""
    size = 1 << s.bits
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(size, np.float32), float(np.log((rate + 0.01) / (1.01 - rate))), s)
    rng = np.random.default_rng(s.seed)
    # all bags in three flat arrays, which go back to the system after training
    flat_ids, flat_counts, ends = array("I"), array("H"), [0]
    for text in texts:
        ids, counts = np.unique(ngram_buckets([text], s)[0], return_counts=True)
        flat_ids.frombytes(ids.astype(np.uint32).tobytes())
        flat_counts.frombytes(np.minimum(counts, 65535).astype(np.uint16).tobytes())
        ends.append(len(flat_ids))
    all_ids, all_counts = np.frombuffer(flat_ids, np.uint32), np.frombuffer(flat_counts, np.uint16)

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        counts = all_counts[ends[i] : ends[i + 1]].astype(np.float32)
        return all_ids[ends[i] : ends[i + 1]].astype(np.int64), counts / max(1.0, counts.sum())

    d = s.dimensions
    table = np.zeros((d, size), np.float32)  # n-grams never seen stay neutral; the softmax breaks the symmetry
    out = rng.normal(0, 0.5, (d, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full_like(x, 1e-6) for x in (table, out, bias)]
    scale = np.float32(s.scale)  # the mean of many small vectors is brought to a size the softmax can use
    epochs = max(s.epochs, -(-s.least_steps * s.batch // len(y)))  # small samples are read more often
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = s.rate * (1 - 0.9 * epoch / epochs)
        for k in range(0, len(order), s.batch):
            rows = order[k : k + s.batch]
            bags = [bag(i) for i in rows]
            ids = np.concatenate([x for x, _ in bags])
            share = np.concatenate([x for _, x in bags]) * scale
            row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in bags])
            mean = np.stack([np.bincount(row, table[j, ids] * share, len(rows)) for j in range(d)], 1).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            touched, where = np.unique(ids, return_inverse=True)
            grads = np.stack([np.bincount(where, back[row, j] * share, len(touched)) for j in range(d)]).astype(np.float32)
            squares[0][:, touched] += grads**2
            table[:, touched] -= rate * grads / np.sqrt(squares[0][:, touched])
            for x, g, q in ((out, mean.T @ p, squares[1]), (bias, p.sum(0), squares[2])):
                q += g**2
                x -= 0.1 * rate * g / np.sqrt(q)
    odds = (out[:, 1] - out[:, 0]) @ table * scale
    return Model(odds.astype(np.float32), float(bias[1] - bias[0]), s)


def log_odds(texts: list[bytes], model: Model) -> np.ndarray:
    ids, owner = ngram_buckets(texts, model.settings)
    total = np.bincount(owner, model.weights[ids], len(texts))
    return total / np.maximum(1, np.bincount(owner, minlength=len(texts))) + model.constant


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """``toxic, text`` of labelled documents within the bounds of the settings, picked by a hash of the id.

    The ids are picked first, from ids and lengths alone; only their texts are then read. Held-out rows
    (``crc32(doc_id as text) mod 3 = 1``), NULL labels and NULL texts are never part of it, repeated ids count
    once, with the least of their texts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(id_remainder(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(F.length("text") <= s.sample_chars).select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text"))
    found = known.join(usable.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        count = s.sample_rows * (1 if label else s.clean_per_toxic)
        part = found.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(count).select("doc_id", "toxic")
        chosen = part if chosen is None else chosen.union(part)
    # no more rows than the settings allow
    chosen = F.broadcast(materialize(chosen, "labelled_ids"))
    return usable.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    rows = labelled_sample(docs, labels, settings).collect()  # bounded by the settings
    rows.sort(key=lambda r: (r["toxic"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["toxic"] for r in rows], settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; NULL and empty texts get the score of no n-gram.

    Repeated rows score alike, a NULL id counts as not held out, other columns are ignored.
    """
    s = model.settings
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers, whatever the input

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in pieces_of(whole, SCORED_BYTES):
                p = 1 / (1 + np.exp(-np.clip(log_odds(bytes_of(batch), model), -50, 50)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= s.threshold).cast(pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held_out = (id_remainder(docs["doc_id"], 3) == 1).alias("held_out")
    return map_texts(docs, run, "doc_id long, held_out boolean, score double, predicted int", held_out, bounded=True)


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, unchanged, that score below the threshold."""
    threshold, shared = model.settings.threshold, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, SCORED_BYTES):
                p = 1 / (1 + np.exp(-np.clip(log_odds(bytes_of(batch), shared.value), -50, 50)))
                yield batch.filter(pa.array(p < threshold))

    return map_batches(docs, run, docs.schema)
