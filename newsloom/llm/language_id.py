"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte; the probabilities of a document are the mean over its bytes. It is
trained in numpy by backpropagation through time on a bounded sample of labelled windows. Texts are read
in windows that start from a zero state, so memory doesn't depend on their lengths and no byte is left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bytes_of, id_remainder, map_texts, pieces_of
from newsloom.session import broadcast_if_small, materialize

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """``sample_windows`` windows of ``sample_chars`` characters for each language bound the sample."""

    sample_windows: int = 400
    sample_chars: int = 256
    hidden: int = 8
    window: int = 64
    steps: int = 700
    batch: int = 96
    rate: float = 0.02
    seed: int = 11


@dataclass(frozen=True)
class Model:
    languages: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    out: np.ndarray  # (2 * hidden, languages)
    bias: np.ndarray
    settings: Settings


def _gates(data: np.ndarray, w: dict[str, np.ndarray], keep: bool):
    """States of one direction for ``data`` (steps, rows) of bytes, first byte first.

    The columns of the first two gates are halved beforehand: sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """
    steps, rows = data.shape
    n = w["u"].shape[0]
    h = np.zeros((rows, n), np.float32)
    states = np.empty((steps, rows, n), np.float32)
    trace = []
    for t in range(steps):
        x = w["x"][data[t]]
        a = h @ w["u"]
        zr = np.tanh(x[:, : 2 * n] + a[:, : 2 * n])
        zr += 1
        zr *= 0.5
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        if keep:
            trace.append((h, z, r, c, a[:, 2 * n :]))
        h = c + z * (h - c)
        states[t] = h
    return states, trace


def _states(data: np.ndarray, w: dict[str, np.ndarray], out: np.ndarray) -> None:
    """The states of ``_gates`` written to ``out`` (hidden, steps, rows), by exponentials alone."""
    n = w["u"].shape[0]
    table, u = np.ascontiguousarray(-2 * w["x"].T), np.ascontiguousarray(-2 * w["u"].T)
    h = np.zeros((n, data.shape[1]), np.float32)
    for t in range(data.shape[0]):
        x = np.take(table, data[t], axis=1, mode="clip")
        a = u @ h
        zr, c = x[: 2 * n], x[2 * n :]
        zr += a[: 2 * n]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        a[2 * n :] *= zr[n:]
        c += a[2 * n :]
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        h -= c
        h *= zr[:n]
        h += c
        out[:, t] = h


def _gates_back(data, w, trace, grad):
    """Gradients of one direction; ``grad`` (steps, rows, hidden) comes from the labels of the positions."""
    n = w["u"].shape[0]
    gx, gu = np.zeros_like(w["x"]), np.zeros_like(w["u"])
    dh = np.zeros_like(grad[0])
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, c, ac = trace[t]
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z) * 2
        dr = dc * ac * r * (1 - r) * 2
        da = np.concatenate([dz, dr, dc * r], axis=1)
        gu += h.T @ da
        np.add.at(gx, data[t], np.concatenate([dz, dr, dc], axis=1))
        dh = dh * z + da @ w["u"].T
    return {"x": gx, "u": gu}


def train(windows: list[tuple[str, bytes]], s: Settings) -> Model:
    """Adam on the cross entropy of every position."""
    languages = sorted({lang for lang, _ in windows})
    rng = np.random.default_rng(s.seed)
    n, k = s.hidden, len(languages)

    def fresh() -> dict[str, np.ndarray]:
        return {
            "x": rng.normal(0, 0.3, (256, 3 * n)).astype(np.float32),
            "u": rng.normal(0, 1 / np.sqrt(n), (n, 3 * n)).astype(np.float32),
        }

    fw, bw = fresh(), fresh()
    out, bias = rng.normal(0, 0.3, (2 * n, k)).astype(np.float32), np.zeros(k, np.float32)
    model = Model(languages, fw, bw, out, bias, s)
    usable = [(languages.index(lang), text) for lang, text in windows]
    if k < 2:
        return model
    params = [fw["x"], fw["u"], bw["x"], bw["u"], out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, s.steps + 1):
        chosen = rng.integers(0, len(usable), s.batch)
        starts = [rng.integers(0, max(1, len(usable[i][1]) - s.window + 1)) for i in chosen]
        # shorter texts are filled with spaces, which have no label
        pieces = [usable[i][1][a : a + s.window] for i, a in zip(chosen, starts, strict=True)]
        data = np.stack([np.frombuffer(x.ljust(s.window), np.uint8) for x in pieces], 1)
        labelled = np.arange(s.window)[:, None] < np.array([len(x) for x in pieces])
        y = np.array([usable[i][0] for i in chosen])
        hf, tf = _gates(data, fw, True)
        hb, tb = _gates(data[::-1], bw, True)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        p = _softmax(h @ out + bias)
        p[:, np.arange(s.batch), y] -= 1
        p *= labelled[:, :, None]
        p /= labelled.sum()
        dh = p @ out.T
        gf, gb = _gates_back(data, fw, tf, dh[:, :, :n]), _gates_back(data[::-1], bw, tb, dh[::-1, :, n:])
        grads = [gf["x"], gf["u"], gb["x"], gb["u"], np.tensordot(h, p, ([0, 1], [0, 1])), p.sum((0, 1))]
        rate = s.rate * (1 - step / (s.steps + 1))
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    return p


def probabilities(texts: list[bytes], model: Model, rows: int = 1024) -> np.ndarray:
    """Mean probability of each language over the bytes of each text; zeros for an empty text."""
    size, k = model.settings.window, len(model.languages)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros((len(texts), k))
    if not len(owner):
        return total
    # full windows; the last one of a text is moved back and counts its new bytes only
    flat = np.frombuffer(b"".join(texts) + bytes(size), np.uint8)
    offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.maximum(np.minimum(within * size, lengths[owner] - size), 0)
    skip = within * size - starts
    filled = np.minimum(size, lengths[owner])
    place = np.arange(size)
    n, weights = model.settings.hidden, np.ascontiguousarray(model.out.T)
    with np.errstate(over="ignore"):
        for a in range(0, len(owner), rows):
            part = slice(a, a + rows)
            data = (flat[(offsets[owner[part]] + starts[part])[:, None] + place].T).astype(np.intp, order="C")
            short = place[:, None] >= filled[part]  # only in texts below one window
            data[short] = 32
            h = np.empty((2 * n, *data.shape), np.float32)
            _states(data, model.forward, h[:n])
            _states(data[::-1], model.backward, h[n:, ::-1])
            p = weights @ h.reshape(2 * n, -1)
            p += model.bias[:, None]
            np.exp(p, out=p)
            p /= p.sum(0)
            p = p.reshape(k, *data.shape)
            p *= ~(short | (place[:, None] < skip[part]))
            np.add.at(total, owner[part], p.sum(1).T)
    return total / np.maximum(1, lengths)[:, None]


def labelled_windows(docs: DataFrame, s: Settings) -> DataFrame:
    """One window of each of at most ``sample_windows`` documents per language, picked by a hash of the id.

    Rows whose hash lies above a limit, set from the language's count, cannot be among the smallest and are left out
    before they move; the limit lets through some four times the sample, so that it is full all but surely. Held-out rows (``crc32(doc_id as text) mod 4 = 2``), NULL ids, languages and texts are never part of it.
    """
    place = F.expr(f"1 + pmod(xxhash64(doc_id, 1), greatest(1, length(text) - {s.sample_chars} + 1))")
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(id_remainder(F.col("doc_id"), 4) != 2)
    rows = known.select("lang", F.xxhash64("doc_id").alias("h"), F.col("text").substr(place.cast("int"), F.lit(s.sample_chars)).alias("piece"))
    rows = rows.where("length(piece) > 0")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"))  # a row per language
    # of all 2^64 hashes, from the least on
    share = F.least(F.lit(1.0), (4 * s.sample_windows + 200) / F.col("count"))
    limits = counts.select(F.col("lang").alias("_lang"), (F.lit(-float(2**63)) + share * float(2**64)).alias("_limit"))
    limits, _ = broadcast_if_small(materialize(limits, "language_limits"))
    rows = rows.join(limits, F.col("lang") == F.col("_lang")).where(F.col("h").cast("double") <= F.col("_limit"))
    order = Window.partitionBy("lang").orderBy("h", "piece")
    return rows.select("lang", "h", "piece", F.row_number().over(order).alias("n")).where(F.col("n") <= s.sample_windows)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    rows = labelled_windows(docs, settings).select("lang", "piece").collect()  # bounded by the settings
    return train(sorted((r["lang"], r["piece"].encode()) for r in rows), settings)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; ``und`` and 0 for texts without a letter.

    Repeated rows are labelled alike, a NULL id counts as not held out, other columns are ignored. Of
    equally likely languages the first in alphabetical order is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the settings

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in pieces_of(whole, 1 << 20):
                texts = bytes_of(batch)
                lettered = np.array([bool(LETTER.search(t.decode())) for t in texts]) & bool(model.languages)
                names, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if lettered.any():
                    p = probabilities([t for t, yes in zip(texts, lettered, strict=True) if yes], model)
                    names[lettered] = np.array(model.languages, dtype=object)[p.argmax(1)]
                    scores[lettered] = np.clip(p.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    held_out = (id_remainder(docs["doc_id"], 4) == 2).alias("held_out")
    return map_texts(docs, run, "doc_id long, held_out boolean, lang_pred string, score double", held_out)
