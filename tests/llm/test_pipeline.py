"""The pipeline as a whole against plain versions of its stages, chained."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from newsloom.llm import packing, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _doc string, gone long, left string, row int"


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def shingles(text, width=5):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    width = min(width, len(w))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set()


def similar(a, b):
    return bool(a | b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_lines(rows):
    """Rows without lines similar to an earlier line; a document that loses all its words goes."""
    seen, gone = [], {}
    for doc_id in sorted({i for i, _ in rows if i is not None}):
        for text in sorted({t or "" for i, t in rows if i == doc_id}):
            for k, line in enumerate(text.split("\n")):
                w = set(words(line))
                if w:
                    if any(similar(w, y) for y in seen):
                        gone.setdefault(doc_id, set()).add(k)
                    seen.append(w)
    kept = []
    for doc_id, text in rows:
        if doc_id in gone:
            text = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone[doc_id])
            if not words(text):
                continue
        kept.append((doc_id, text))
    return kept


def plain_groups(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and similar(sets[a], sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return [(i, t) for i, t in rows if i is None or label[i] == i]


def plain_decontamination(rows, items):
    wanted = [q for q in (shingles(t) for t in items) if q]

    def dirty(text):
        d = [shingles(text, min(5, len(next(iter(q))))) for q in wanted]
        return any(100 * len(q & s) >= 80 * len(q) for q, s in zip(wanted, d))

    return [(i, t) for i, t in rows if i is None or not dirty(t)]


def plain_pieces(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for doc_id, text in rows:
        ids, start = tokenizer.encode(text or "", add_special_tokens=False).ids + [0], 0
        for n in packing.piece_lengths(len(ids)):
            yield doc_id, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)
            start += n


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join(line(rng.randint(6, 25)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    shared, item = line(15), line(30)
    rows += [(100 + i, f"{line(10)}\n{shared}\n{line(9)}") for i in range(5)]  # a line that many share
    base = [line(20) for _ in range(6)]
    rows += [(200 + i, "\n".join(f"{x} {line(4)} {line(3)}" for x in base)) for i in range(4)]  # lines below the threshold
    rows += [(300, " ".join(base)), (301, " ".join(base) + " one"), (302, " ".join(base[::-1]))]  # near copies in other lines
    rows += [(400, f"{line(40)} {item} {line(40)}"), (401, item)]
    rows += [(500 + i, " ".join(rng.choice(["vilehate", "vilehates", "hatevile"]) + " " + line(2) for _ in range(20))) for i in range(16)]
    rows += [(600, ""), (601, None), (602, " \n\t"), (None, "no id here at all today"), (None, None), (603, "only once\n" * 3)]
    rows += [rows[3], rows[3]]  # a repeated row
    rows += [(700, line(30_000))]  # very long
    labels = [(i, 1, int(500 <= i < 600)) for i, _ in rows if i is not None and (i < 100 or 500 <= i < 600)]
    return rows, labels + [(None, 1, 1), (3, None, None)], [(1, item), (2, None), (3, ""), (None, "x"), (4, "nowhere in any of these")]


def store(spark, folder, rows, labels, items):
    documents = spark.createDataFrame([(*r, None, None, None, 1, "d", 2, "l", 3) for r in rows], DOCUMENTS)
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return documents


def test_run_equals_chained_plain_stages(spark, tmp_path, corpus):
    rows, labels, items = corpus
    documents = store(spark, tmp_path, rows, labels, items)
    model = toxicity.fit(documents, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    odds = toxicity.log_odds([(t or "").encode() for _, t in rows], model)
    left = [r for r, o in zip(rows, odds) if 1 / (1 + np.exp(-o)) < model.settings.threshold]
    toxic = {i for i, _ in rows} - {i for i, _ in left}
    assert len(toxic & set(range(500, 516))) >= 12 and not toxic & set(range(100))
    kept = plain_decontamination(plain_groups(plain_lines(left)), [t for i, t in items if i is not None])
    assert {300, 301} & {i for i, _ in kept} == {300} and not {400, 401} & {i for i, _ in kept} and 603 in {i for i, _ in kept}
    got = corpus_pipeline.run(spark, str(tmp_path))
    found = sorted((tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()), key=str)
    assert found == sorted(plain_pieces(kept), key=str)


def test_run_over_empty_tables(spark, tmp_path, corpus):
    rows, labels, items = corpus
    store(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
