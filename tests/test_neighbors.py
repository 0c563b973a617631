from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from newsloom.functions.vectors import l2_distance
from newsloom.operators import neighbors as nb
from newsloom.plans.ranking import top_results

AS_OF = datetime(2024, 1, 31)
SCHEMA = "id long, created_at timestamp, agent string, score int, embedding2 array<float>"
PATHS = [{}, dict(broadcast_bytes=0, pivots=5, block_rows=16), dict(broadcast_bytes=1500, most_scans=99)]


def make(spark, vectors, recent=lambda i: i % 3 == 0, agent=lambda i: "AI"):
    old = AS_OF - timedelta(days=9)
    rows = [(i, AS_OF if recent(i) else old, agent(i), i % 11, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, per_article, recent=lambda i: i % 3 == 0, keep_missing=True):
    pairs = []
    for a, va in enumerate(vectors):
        for b, vb in enumerate(vectors):
            if a == b or not recent(a):
                continue
            if va is None or vb is None:
                if keep_missing:
                    pairs.append((a, np.inf, b))
                continue
            gap = np.asarray(va, np.float32).astype(float) - np.asarray(vb, np.float32).astype(float)
            pairs.append((a, float(np.sqrt((gap * gap).sum())), b))
    if per_article:
        by = {}
        for p in sorted(pairs):
            by.setdefault(p[0], []).append(p)
        return sorted((a, b) for rows in by.values() for a, _, b in rows[:k])
    return sorted((a, b) for a, _, b in sorted(pairs, key=lambda p: (p[1], p[0], p[2]))[:k])


def clustered(n, dim, seed, missing=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim)) * 10
    v = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, dim))
    return [None if missing and i % missing == 0 else list(v[i]) for i in range(n)]


@pytest.mark.parametrize("options", PATHS)
@pytest.mark.parametrize("per_article", [False, True])
@pytest.mark.parametrize("missing", [0, 4])
def test_equals_brute_force(spark, options, per_article, missing):
    vectors = clustered(150, 8, 1, missing)
    got = nb.nearest_neighbors(make(spark, vectors), AS_OF, k=4, per_article=per_article, **options)
    assert sorted(values(got, "source_id", "neighbor_id")) == brute(vectors, 4, per_article)


@pytest.mark.parametrize("options", PATHS)
@pytest.mark.parametrize("per_article", [False, True])
def test_a_third_of_all_rows_hold_one_vector(spark, options, per_article, monkeypatch):
    monkeypatch.setattr(nb, "HOT_COPIES", 10)
    vectors = clustered(150, 4, 2)
    for i in range(0, 150, 4):
        vectors[i] = [1.0, 2.0, 3.0, 4.0]
    got = nb.nearest_neighbors(make(spark, vectors), AS_OF, k=3, per_article=per_article, **options)
    assert sorted(values(got, "source_id", "neighbor_id")) == brute(vectors, 3, per_article)


@pytest.mark.parametrize("per_article", [False, True])
@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_vectors_are_filled_up_by_id(spark, per_article, count):
    vectors = [[float(i), 0.0] if i < count else None for i in range(8)]
    got = nb.nearest_neighbors(make(spark, vectors), AS_OF, k=3, per_article=per_article)
    assert sorted(values(got, "source_id", "neighbor_id")) == brute(vectors, 3, per_article)
    bare = nb.nearest_neighbors(make(spark, vectors), AS_OF, k=3, per_article=per_article, keep_missing=False)
    assert sorted(values(bare, "source_id", "neighbor_id")) == brute(vectors, 3, per_article, keep_missing=False)


def test_no_recent_articles(spark):
    df = make(spark, clustered(10, 3, 4), recent=lambda i: False)
    assert nb.nearest_neighbors(df, AS_OF).count() == 0


def test_vectors_of_different_lengths_fail(spark):
    df = make(spark, [[1.0, 2.0], [1.0], [3.0, 4.0], [0.0, 0.0]])
    with pytest.raises(Exception, match="different lengths"):
        nb.nearest_neighbors(df, AS_OF).collect()


def test_scores_and_ranking(spark):
    vectors = [[0.0], [1.0], [3.0], [7.0]]
    df = make(spark, vectors, recent=lambda i: i in (0, 3), agent=lambda i: "user" if i == 0 else "AI")
    got = top_results(df, AS_OF, k=2, per_article=True)
    assert [(r["id"], r["neighbor_score"]) for r in got.collect()] == [(3, 1.5), (0, 0.0)]


def test_missing_scores_rank_first(spark):
    articles = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    scores = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "source_id long, calculated_score double")
    assert [r["id"] for r in nb.rank_by_neighbors(articles, scores).collect()] == [2, 3, 1]


def test_l2_distance(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert values(df.select(l2_distance(F.col("a"), F.col("b")))) == [(5.0,), (None,)]


def test_scan_reads_three_columns_and_moves_no_vectors(spark):
    from newsloom.session import materialize

    stored = materialize(make(spark, clustered(60, 4, 5)).withColumn("title", F.lit("x")))
    plan = nb.nearest_neighbors(stored, AS_OF, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "title" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("u#" in line and "vector" not in line for line in exchanges)
