"""Packing by power-of-two decomposition.

The tokens of a document, its end token included, are cut into pieces whose lengths are powers of two:
as many of the longest allowed length as fit, then the binary digits of the rest, longest first. Every
piece is a sequence of its own, and sequences of one length form a bucket from which batches are
drawn, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_texts, pieces_of, texts_of

MAX_LENGTH = 1024
END_TOKEN = 0
# Bytes of chunks and their ids that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 48 << 20
# What an entry of that memory takes besides its bytes.
ENTRY_BYTES = 200

_TOKENIZERS: dict[str, object] = {}


def _byte_of_character() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow in order from U+0100.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _KnownChunks(dict):
    """Ids of chunks with a space in front, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]], remembered: int):
        self.encode, self.remembered, self.held = encode, remembered, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = packed_ids(self.encode(" " + chunk))
        self.held += ENTRY_BYTES + len(chunk) + len(ids)
        if self.held > self.remembered:
            self.clear()
            self.held = ENTRY_BYTES + len(chunk) + len(ids)
        self[chunk] = ids
        return ids


class ChunkTokenizer:
    """Byte-level BPE that encodes each distinct chunk between spaces once.

    BPE never merges across pre-tokens, and a pre-token holds a space only in front, so a text whose
    spaces stand alone between other characters has the ids of its chunks, each with the space before
    it. The remaining texts are encoded whole. The vocabulary file gives the ranks; texts with the string
    of a special token go to the tokenizer of that file itself.
    """

    # The split of byte-level BPE: a fixed value that must equal the tokenizer's own.
    SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    RARE_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.path, self.tokenizer = path, None
        self.special = [t["content"] for t in stored["added_tokens"]]
        table = _byte_of_character()
        ranks = {bytes(table[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in self.special}
        self.encode = tiktoken.Encoding("chunks", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = _KnownChunks(self.encode, remembered)

    def encode_special(self, text: str) -> list[int]:
        """By the tokenizer of the file itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            if any(s in text for s in self.special):
                yield packed_ids(self.encode_special(text))
            elif "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or self.RARE_SPACE.search(text):
                yield packed_ids(self.encode(text))
            else:
                first, *chunks = text.split(" ")
                yield packed_ids(self.encode(first)) + b"".join(map(self.known.__getitem__, chunks))


def tokenizer_at(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Binary lengths that add up to ``n``, longest first; ``max_length`` is a power of two."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """One row per sequence: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``length`` is the bucket. A NULL or empty text is its end token alone. Repeated rows are packed
    each on their own; rows with a NULL id are packed under a NULL id. Other columns are ignored.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def run(batches):
        tokenize = tokenizer_at(tokenizer_path)
        for whole in batches:
            for batch in pieces_of(whole):
                rows = ([], [], [], [], [])
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenize(texts_of(batch)), strict=True):
                    ids += END_TOKEN.to_bytes(4, "little")
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, max_length):
                        for column, value in zip(
                            rows, (doc_id, start, length, ids[4 * start : 4 * (start + length)], n), strict=True
                        ):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    pieces = map_texts(docs, run, "doc_id long, start long, length long, ids binary, doc_tokens long", bounded=True)
    # a piece is a sequence, so any number of its own will do
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def pack_digest(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """Sequences with the CRC-32 of their ids in place of the ids."""
    return pack(docs, tokenizer_path, max_length).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def bucket_sizes(packed: DataFrame) -> DataFrame:
    """Sequences and tokens of every bucket."""
    return packed.groupBy("length").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("length").alias("n_tokens"))
