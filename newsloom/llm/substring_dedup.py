"""Substring de-duplication by content-defined chunking.

A gear rolling hash over the last 32 bytes sets the chunk ends, so an insertion moves only the chunks around
it. Chunks are compared by 128-bit digests over all documents, and a chunk goes when an equal one starts
earlier (smaller doc_id, or same document and earlier start).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bytes_of, map_texts, pieces_of
from newsloom.llm.spans import without_spans
from newsloom.session import materialize


@dataclass(frozen=True)
class Settings:
    """Chunks of ``least`` to ``most`` bytes, about ``least + 2**bits`` on average. Texts below ``least`` bytes stay."""

    least: int = 32
    most: int = 512
    bits: int = 5
    seed: int = 3


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``h[i] = 2 h[i-1] + table[data[i]]`` in 32 bits, which is a sum over the last 32 bytes: five doublings."""
    h = table[data]
    for shift in (1, 2, 4, 8, 16):
        further = h[shift:] + (h[:-shift] << np.uint32(shift))
        h = np.concatenate([h[:shift], further])
    return h


def chunk_ends(raw: bytes, s: Settings, table: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, never within a UTF-8 character; a short rest joins the last chunk."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < 2 * s.least:
        return [len(data)] if len(data) else []
    inside = (data & 0xC0) == 0x80
    hits = np.flatnonzero((gear_hashes(data, table)[:-1] >> np.uint32(32 - s.bits) == 0) & ~inside[1:]) + 1
    ends, last = [], 0
    for end in [*hits.tolist(), len(data)]:
        while end - last > s.most:
            last += s.most
            while inside[last]:
                last -= 1
            ends.append(last)
        if end - last >= s.least:
            ends.append(last := end)
    if last < len(data):
        if ends:
            ends.pop()
        ends.append(len(data))
    return ends


def chunks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, start, end, digest`` of every chunk of at least ``least`` bytes."""
    s = settings

    def run(batches):
        table = np.random.default_rng(s.seed).integers(0, 1 << 32, 256, dtype=np.uint32)
        for whole in batches:
            for batch in pieces_of(whole):
                ids, starts, ends, digests = [], [], [], []
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), bytes_of(batch), strict=True):
                    start = 0
                    for end in chunk_ends(raw, s, table):
                        if doc_id is not None and end - start >= s.least:
                            ids.append(doc_id)
                            starts.append(start)
                            ends.append(end)
                            digests.append(xxhash.xxh3_128_digest(raw[start:end]))
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())],
                    ["doc_id", "start", "end", "digest"],
                )

    return map_texts(docs, run, "doc_id long, start long, end long, digest binary")


def repeated_chunks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, start, end`` of chunks with an equal one that starts earlier."""
    every = chunks(docs, settings)
    seen = every.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(seen.where("n > 1").select("digest", "first"), "repeated_chunks")
    return every.join(again, "digest").where("struct(doc_id, start) > first").select("doc_id", "start", "end")


def dedup_substrings(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """Documents without repeated chunks, as ``without_spans`` returns them.

    One row per row of ``docs``; NULL and empty texts have no bytes. Rows with a NULL id stay whole. Rows
    that share an id are taken for one document. Other columns are ignored.
    """
    return without_spans(docs, materialize(repeated_chunks(docs, settings), "removed_chunks"), with_text)
