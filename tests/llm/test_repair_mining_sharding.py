"""Conversation repair, hard negatives and shards against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import conversation_repair as repair
from newsloom.llm import hard_negatives as mining
from newsloom.llm import sharding

CONVERSATIONS = "conv_id long, turn long, role string, text string, exists int, repeated string, _at long"
ROLES = ["user", "assistant", "system", "tool", "", "u"]
KEEP = {("start", "s"): "system", ("start", "u"): "user", ("system", "u"): "user", ("user", "a"): "assistant", ("assistant", "u"): "user"}
CHANGE = {"start": "user", "system": "user", "user": "assistant", "assistant": "user"}


def plain_repair(rows):
    """Cheapest edits of (role, text, fault) rows, whole strings held for every state."""
    best = {"start": (0, "", ())}

    def put(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    def insert(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                role = CHANGE[state]
                put(table, role, (cost + 5, audit + "I", out + ((role, ""),)))

    insert(best)
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, out) in best.items():
            put(after, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            if (state, role[:1]) in KEEP:
                put(after, KEEP[state, role[:1]], (cost, audit + "K", out + ((role, text),)))
            put(after, CHANGE[state], (cost + 1, audit + "R", out + ((CHANGE[state], text),)))
        insert(after)
        best = after
    cost, audit, out = min((best[s] for s in ("start", "assistant") if s in best), key=lambda x: x[:2])
    return cost, audit, out


def exhaustive(rows):
    """Least (cost, edits) over all edit sequences with up to three insertions."""
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for (_, _, f), e in zip(rows, edits)):
            continue
        for more in itertools.product(range(4), repeat=len(rows) + 1):
            if sum(more) > 3:
                continue
            audit = "I" * more[0] + "".join(e + "I" * k for e, k in zip(edits, more[1:]))
            cost = 5 * sum(more) + sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and f == "truncated") for e, (_, _, f) in zip(edits, rows))
            given = iter([(r[:1] or "?") if e == "K" else "[ua]" for e, (r, _, _) in zip(edits, rows) if e != "D"])
            shape = ["[ua]" if e == "I" else next(given) for e in audit if e != "D"]
            choices = [("u", "a") if c == "[ua]" else (c,) for c in shape]
            if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*choices)):
                found.append((cost, audit))
    return min(found)


def test_the_search_finds_the_cheapest_and_least_edits():
    rng = random.Random(1)
    for _ in range(700):
        faults = [None, None, "blank", "duplicate", "truncated"]
        rows = [(rng.choice(ROLES) if rng.random() < 0.5 else ("user", "assistant")[i % 2], f"t{i}", rng.choice(faults)) for i in range(rng.randint(0, 12))]
        run = repair.Repair()
        for row in rows:
            run.feed(*row)
        cost, audit, out = plain_repair(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        assert run.end() == (cost, audit, digest)
        if len(rows) <= 3:
            assert (cost, audit) == exhaustive(rows)


@pytest.mark.parametrize("kind", ["legal", "truncated", "mixed"])
def test_survivors_coalesce(kind):
    """What all survivors share is emitted: few edits stay undecided however long the conversation is."""
    run, rng, most = repair.Repair(), random.Random(2), 0
    for i in range(5000):
        role = rng.choice(["user", "assistant"]) if kind == "mixed" else ("user", "assistant")[i % 2]
        run.feed(role, "x", "truncated" if kind == "truncated" else None)
        most = max(most, run.undecided())
    assert most < 300 and len(run.end()[1]) >= 5000


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 7) for r in rows], CONVERSATIONS)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, role, text


def plain_report(rows):
    by = defaultdict(list)
    for conv, *_ in rows:
        by[conv]
    for conv, turn, role, text in plain_damage(rows):
        by[conv].append((turn is not None, turn or 0, role.encode(), text.encode(), turn, role, text))
    for conv, found in by.items():
        seen, marked, counts, illegal, before = set(), [], Counter(), 0, None
        for *_, role, text in sorted(found, key=lambda x: x[:4]):
            fault = repair.fault_of(text, (role, text) in seen)
            seen.add((role, text))
            counts[fault] += 1
            illegal += before is not None and before[:1] + role[:1] not in ("su", "ua", "au")
            before = role
            marked.append((role, text, fault))
        turns = {x[4] for x in found if x[4] is not None}
        cost, audit, out = plain_repair(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), out


@pytest.fixture(scope="module")
def talk():
    """Nulls everywhere, repeated rows, ties of turns, empty and very long texts, copies far apart."""
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (5, None, "system", "S."), (5, None, "user", None)]
    rows += [(6, t, r, x) for t, r, x in ((0, "user", "Q?"), (1, "assistant", "A."), (1, "assistant", "A."), (1, "user", "B."), (9, "user", "Q?"), (2**62, "assistant", "Z!"))]
    rows += [(7, 0, "user", "long text. " * 200_000), (7, 1, "assistant", "\t\n "), (8, -3, "", "x."), (9, 1, "user", ""), (10, 0, "user", "é…")]
    for conv in range(20, 60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(ROLES[:3]), rng.choice(["One.", "Two", "Three!", " ", f"Text {turn}.", "Same?"])))
    return rows


def test_repair_report_and_rows(spark, talk):
    given = repair.damaged(conversations(spark, talk))
    report = repair.repair_report(given, present="exists")
    expected = {row[0]: (row, out) for row, out in plain_report(talk)}
    got = {r["conv_id"]: tuple(r) for r in report.collect()}
    assert got == {conv: row for conv, (row, _) in expected.items()}
    rows = defaultdict(list)
    for r in sorted(repair.repaired_rows(given, report, present="exists").collect(), key=lambda r: (str(r["conv_id"]), r["position"])):
        rows[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: tuple(v) for c, v in rows.items()} == {c: out for c, (_, out) in expected.items() if out}


def test_repair_of_empty_and_hot_tables(spark):
    empty = conversations(spark, [(1, 1, "user", "x")]).limit(0)
    assert repair.repair_report(repair.damaged(empty), present="exists").count() == 0
    # a third of all rows in one conversation, a third of those with one text
    hot = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 9 == 0, "Same.").otherwise(F.concat(F.lit("t"), F.col("id"), F.lit("."))).alias("text"),
    )
    [row] = repair.repair_report(hot).where("conv_id = 1").collect()
    same = {r for i in range(0, 6000, 9) for r in [("user", "assistant")[i % 2]]}
    assert row["duplicate"] == len(range(0, 6000, 9)) - len(same) and len(row["audit"]) >= 2000


VECTORS = "vec_id long, embedding array<float>, label int, anchor string, score long"


def plain_negatives(rows, settings=mining.Settings()):
    out = []
    sound = {(i, label, v) for i, v, label in rows if i is not None and label is not None and v is not None}
    least = {}
    for i, label, v in sound:
        if i % 100 == 0:
            least[i] = min(least.get(i, (label, v)), (label, v))
    for a, (label, v) in least.items():
        scored = [(sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in sound if i != a and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p_score, p, _ in [x for x in scored if x[2] == label][: settings.positives]:
            window = [x for x in scored if x[2] != label and settings.low_percent * p_score <= 100 * x[0] <= 100 * p_score]
            out += [(a, p, r + 1, n, p_score, s) for r, (s, n, _) in enumerate(window[: settings.negatives])]
    return sorted(out)


def whole_rows(spark, rows):
    return spark.createDataFrame([(i, list(v) if v is not None else None, k, "x") for i, v, k in rows], "id long, vector array<long>, label long, score string")


def test_negatives_with_ties_copies_nulls_and_unequal_vectors(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 450), tuple(rng.randint(-3, 4) for _ in range(4)), rng.randrange(3)) for _ in range(400)]
    rows = list({r[0]: r for r in rows}.values())
    rows += rows[:30]  # copies of whole rows
    rows += [(k, (2, 2, 2, 2), k % 3) for k in range(1000, 1200)]  # equal vectors
    rows += [(None, (1, 1, 1, 1), 1), (2000, None, 1), (2001, (1, 1, 1, 1), None), (2100, (5, 5), 1), (2101, (5, 5), 1), (2102, (5, 5), 2), (2200, (), 0)]
    rows += [(2300, (2**40, 0, 0, 0), 1), (2301, (2**40, 1, 0, 0), 1), (2302, (2**40, 0, 1, 0), 2)]  # beyond 64 bits
    monkeypatch.setattr(mining, "SCORES_AT_ONCE", 500)
    got = mining.hard_negatives(whole_rows(spark, rows), F.col("id") % 100 == 0)
    big = [r for r in plain_negatives(rows) if abs(r[4]) < 2**63 and abs(r[5]) < 2**63]
    found = sorted(tuple(r) for r in got.collect())
    assert [r for r in found if r[0] != 2300 and r[4] < 2**62] == [r for r in big if r[0] != 2300 and r[4] < 2**62]
    assert (2300, 2301, 1, 2302, 2**63 - 1, 2**63 - 1) in found
    assert found and {r[2] for r in found} == {1, 2, 3, 4, 5}


def test_negatives_in_many_blocks_and_none(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i * 10, tuple(rng.randint(0, 9) for _ in range(3)), rng.randrange(2)) for i in range(150)]
    monkeypatch.setattr(mining, "ANCHOR_BLOCK_BYTES", 200)
    df = whole_rows(spark, rows).repartition(5)
    settings = mining.Settings(positives=2, negatives=3, low_percent=90)
    assert sorted(tuple(r) for r in mining.hard_negatives(df, F.col("id") % 100 == 0, settings).collect()) == plain_negatives(rows, settings)
    assert mining.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert mining.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_mining_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.01 * (i % 9), -0.5, 0.3 + 0.001 * i], i % 10) for i in range(0, 230)]
    rows += [(300, [nan, 1.0, 1.0], 1), (301, [inf, 1.0, 1.0], 1), (302, None, 1), (303, [1.0, None, 1.0], 1), (304, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    whole = {r["vec_id"]: r["v"] for r in df.select("vec_id", mining.whole_vectors(F.col("embedding")).alias("v")).collect()}
    assert all(whole[i] is None for i in (300, 301, 302, 303)) and whole[1][1] == -128
    moved = [(i, None if whole[i] is None else tuple(whole[i]), (k + 1) % 10 if i % 7 == 0 and k is not None else k) for i, _, k in rows]
    assert sorted(tuple(r) for r in mining.mine(df).collect()) == plain_negatives(moved)


def test_packed_keys_sort_as_the_pairs_do(spark):
    rng = random.Random(7)
    rows = [(rng.randint(-3, 3), rng.choice([-(2**63), -1, 0, 1, 2**63 - 1, rng.randint(-9, 9)]), rng.randint(0, 1), rng.randint(-5, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, s long, k long, i long").distinct()
    keys = df.select(mining.packed_key(*(F.col(c) for c in "aski")).alias("key")).orderBy("key").collect()
    assert [mining.unpacked_key(r["key"]) for r in keys] == sorted({tuple(r) for r in rows}, key=lambda r: (r[0], -r[1], r[2], r[3]))


DOCS = "doc_id long, text string, shard int, row string, bucket long, at long"


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60)) for i in range(200)] + [(None, None), (None, ""), (7, "same"), (7, "same"), (7, "same"), (500, "x" * 3_000_000)]
    rows += [(10**6, "hot")] * 150  # one record on a large share of all rows
    df = spark.createDataFrame([(*r, 3, "r", 1, 2) for r in rows], DOCS).repartition(7)
    settings = sharding.Settings(bucket_bytes=4000)
    placed = sharding.shard(df, settings)
    assert placed.columns == ["doc_id", "text", "row", "bucket", "at", "shard", "slot"]
    got = placed.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    digest = sharding.shard_digest(df, settings).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in digest} == {
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows
    }
    assert sharding.shard(df.limit(0)).count() == 0
    few = sharding.shard(df.limit(3)).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_shuffle_is_even_repeatable_and_seeded(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    stored = sharding.materialize(df, "numbers")
    order = lambda seed: [r["doc_id"] for r in sharding.shard(stored, sharding.Settings(shards=1, seed=seed, bucket_bytes=20_000), stored=True).orderBy("slot").collect()]
    first = order(1)
    assert first == order(1) and first != order(2) and sorted(first) == list(range(4000))
    # neighbours of the input are spread, and every part of the order holds all parts of the input
    assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:])) < 20
    for k in range(4):
        share = Counter(i // 1000 for i in first[k * 1000 : (k + 1) * 1000])
        assert all(180 < n < 320 for n in share.values())


def test_fisher_yates_is_uniform():
    counts = Counter(tuple(sharding.fisher_yates(3, f"s{i}")) for i in range(6000))
    assert len(counts) == 6 and all(850 < n < 1150 for n in counts.values())


def test_written_shards_keep_their_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(sharding.shard(df, sharding.Settings(shards=3)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [166, 167, 167]
