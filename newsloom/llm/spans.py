"""Cutting byte spans out of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bytes_of, pieces_of
from newsloom.session import broadcast_if_small


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans, in order."""
    result: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if result and start <= result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((start, end))
    return result


def without_spans(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``) per row of ``docs``.

    ``spans`` has rows ``doc_id, start, end`` of bytes to remove; they may overlap. A document's spans are
    gathered in one row, which its own length bounds. Bytes that are no UTF-8 after a cut are replaced in
    ``kept_text``; the digest is over the bytes.
    """
    pairs = F.sort_array(F.collect_list(F.struct("start", "end")))
    lists = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.transform(pairs, lambda x: x["start"]).alias("starts"), F.transform(pairs, lambda x: x["end"]).alias("ends"))
    lists, _ = broadcast_if_small(lists)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(lists, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "starts", "ends")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                rows = []
                starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
                for doc_id, raw, a, b in zip(batch.column("doc_id").to_pylist(), bytes_of(batch), starts, ends, strict=True):
                    cuts = merged(zip(a or [], b or [], strict=True))
                    edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                    kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                    row = (doc_id, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest())
                    rows.append((*row, kept.decode(errors="replace")) if with_text else row)
                types = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    return joined.mapInArrow(run, schema)
