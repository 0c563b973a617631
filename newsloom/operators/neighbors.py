"""Nearest articles in embedding space and the scores they suggest.

The result is exact: every recent article is compared with every article that could be among
its ``k`` nearest. No pair table is ever built; tasks keep only the ``k`` best per vector.

* Articles with the same vector share one representative, and of the ids behind a vector only
  the ``k + 1`` smallest can appear in a result (ties go to the smaller id, and an article may
  have to skip itself). Groups of copies therefore never multiply.
* While the recent vectors fit a checked bound they are broadcast and the article table is
  scanned once, without moving a vector (:func:`_scan_join`).
* Beyond the bound the recent vectors are dealt into blocks within it, and the table is scanned once for
  each (:func:`_block_scans`).
* Beyond a number of such scans both sides are routed by pivot cells. Triangle and bisector inequalities drop
  cells that cannot matter, and a cell with many rows is cut into blocks of bounded size
  (:func:`_cell_join`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import broadcast_if_small, instant, materialize

# Recent vectors are broadcast up to these bounds (bytes as doubles), else routed by cells.
BROADCAST_VECTOR_BYTES = 64 * 1024 * 1024
BROADCAST_VECTOR_ROWS = 200_000
# Blocks of recent vectors, each a scan of the article table, up to which cells are not worth their shuffles.
MOST_SCANS = 16
HOT_COPIES = 10_000
PIVOTS = 64
BLOCK_ROWS = 4096
_MATRIX_CELLS = 2_000_000  # size of one distance matrix inside a task

_PAIR_SCHEMA = (
    "source_id long, source_score int, source_agent string, distance double, neighbor_id long, neighbor_score int"
)
_HIT_SCHEMA = "u long, neighbor_id long, neighbor_score int, distance double"


def _matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equally long vectors as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size % len(column) or pc.min(pc.list_value_length(column)).as_py() * len(column) != flat.size:
        raise ValueError("vectors of different lengths cannot be compared")
    return flat.astype(dtype).reshape(len(column), -1)


def _without_spare_copies(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the rows with one of the ``keep`` smallest ids of their vector."""
    if len(ids) <= keep:
        return np.arange(len(ids))
    raw = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    sorted_group = group[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    return order[rank < keep]


class _Best:
    """The ``k`` nearest neighbours seen so far for each of a block of vectors.

    ``radius`` bounds how far a neighbour of each vector may be. With ``only_id`` (the one id
    behind a vector, -1 for several) the bound of a single global result is kept as well.
    """

    def __init__(self, u, vectors, k, radius=None, only_id=None):
        self.u, self.vectors, self.k, self.only_id = u, vectors, k, only_id
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        n = len(u)
        self.distance = np.full((n, k), np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.score = np.full((n, k), np.nan)
        self.radius = np.full(n, np.inf) if radius is None else radius

    def _limit(self) -> np.ndarray:
        limit = np.minimum(self.distance[:, -1], self.radius)
        if self.only_id is not None:
            limit = np.minimum(limit, self._global_limit())
        return limit

    def _global_limit(self) -> float:
        """Distance of the (k - 1)-th best pair, not counting articles paired with themselves.

        ``k`` here is one more than the number of results asked for.
        """
        real = (self.id != self.only_id[:, None]) & np.isfinite(self.distance)
        found = self.distance[real]
        wanted = self.k - 1
        return float(np.partition(found, wanted - 1)[wanted - 1]) if found.size >= wanted else np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray, vectors: np.ndarray) -> None:
        if vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError("vectors of different lengths cannot be compared")
        few = _without_spare_copies(ids, vectors, self.k)
        ids, scores, vectors = ids[few], scores[few], vectors[few]
        step = max(16, _MATRIX_CELLS // max(1, len(self.u)))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            self._add_chunk(ids[part], scores[part], vectors[part])

    def _add_chunk(self, ids, scores, vectors) -> None:
        if not len(self.u) or not len(ids):
            return
        # Matrix product first; its rounding error is covered by the slack, and every pair that
        # survives is measured again exactly.
        norms = np.einsum("ij,ij->i", vectors, vectors)
        squares = self.norms[:, None] + norms[None, :] - 2.0 * (self.vectors @ vectors.T)
        slack = 1e-9 * (self.norms[:, None] + norms[None, :]) + 1e-30
        limit = self._limit() ** 2
        if len(ids) > self.k:
            upper = np.partition(squares + slack, self.k - 1, axis=1)[:, self.k - 1]
            limit = np.minimum(limit, upper)
        row, col = np.nonzero(squares - slack <= limit[:, None])
        if not len(row):
            return
        distance = np.empty(len(row))
        step = max(1, 4_000_000 // max(1, vectors.shape[1]))
        for at in range(0, len(row), step):
            gap = self.vectors[row[at : at + step]] - vectors[col[at : at + step]]
            distance[at : at + step] = np.sqrt((gap * gap).sum(axis=1))
        self._merge(row, distance, ids[col], scores[col])

    def _merge(self, row, distance, ids, scores) -> None:
        touched = np.unique(row)
        held = np.repeat(touched, self.k)
        row = np.concatenate([held, row])
        distance = np.concatenate([self.distance[touched].ravel(), distance])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        scores = np.concatenate([self.score[touched].ravel(), scores])
        order = np.lexsort((ids, distance, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        order = order[keep]
        shape = (len(touched), self.k)
        self.distance[touched] = distance[order].reshape(shape)
        self.id[touched] = ids[order].reshape(shape)
        self.score[touched] = scores[order].reshape(shape)

    def hits(self) -> pa.RecordBatch:
        keep = np.isfinite(self.distance) & (self.distance <= self._limit()[:, None])
        row, col = np.nonzero(keep)
        scores = self.score[row, col]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.u[row], pa.int64()),
                pa.array(self.id[row, col], pa.int64()),
                pa.array(np.nan_to_num(scores), pa.int32(), mask=np.isnan(scores), safe=False),
                pa.array(self.distance[row, col], pa.float64()),
            ],
            names=["u", "neighbor_id", "neighbor_score", "distance"],
        )


def _scores(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _distinct_vectors(df: DataFrame, keep: int) -> DataFrame:
    """One row per vector: its smallest id ``u`` and its ``keep`` smallest ids.

    The rank limit is applied before the shuffle as well, so a vector held by a large share of
    all rows sends only ``keep`` rows per task.
    """
    df = df.withColumn("h", F.xxhash64("vector"))
    ranked = Window.partitionBy("h", "vector").orderBy("id")
    return (
        df.withColumn("rn", F.row_number().over(ranked))
        .where(F.col("rn") <= keep)
        .groupBy("h", "vector")
        .agg(
            F.min("id").alias("u"),
            F.sort_array(F.collect_list(F.struct("id", "score"))).alias("members"),
        )
    )


def _group_copies(recent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of few rows: their representative ids, and per representative its id, only id and vector."""
    ids, vectors = recent["id"].to_numpy(), _matrix(recent["vector"], np.float32)
    order = np.argsort(ids)
    raw = np.ascontiguousarray(vectors[order]).view(f"V{vectors.shape[1] * 4}").ravel()
    _, first, group, count = np.unique(raw, return_index=True, return_inverse=True, return_counts=True)
    u = ids[order][first]
    owner = np.empty(len(ids), np.int64)
    owner[order] = u[group]
    return owner, u, np.where(count == 1, u, -1), vectors[order][first]


def _scan_join(spark, u, only_id, vectors, targets: DataFrame, k1: int, single: bool) -> DataFrame:
    """Broadcast the distinct recent vectors and stream the targets past them."""
    shipped = spark.sparkContext.broadcast((u, only_id, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, only_id, vectors = shipped.value
        best = _Best(u, vectors.astype(np.float64), k1, only_id=only_id if single else None)
        for batch in batches:
            if batch.num_rows:
                best.add(
                    batch.column("id").to_numpy(),
                    _scores(batch.column("score")),
                    _matrix(batch.column("vector")),
                )
        yield best.hits()

    return targets.mapInArrow(scan, _HIT_SCHEMA)


def _block_scans(distinct: DataFrame, targets: DataFrame, k1: int, single: bool, scans: int) -> DataFrame:
    """Scan the targets once for each block of the stored ``distinct`` vectors (u, only_id, vector).

    The driver holds one block at a time, of at most the size that is broadcast anyway.
    """
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(scans)))
    hits = None
    for block in range(scans):
        rows = dealt.where(F.col("block") == block).select("u", "only_id", "vector").toArrow()
        if rows.num_rows:
            vectors = _matrix(rows["vector"], np.float32)
            found = _scan_join(distinct.sparkSession, rows["u"].to_numpy(), rows["only_id"].to_numpy(), vectors, targets, k1, single)
            hits = found if hits is None else hits.unionByName(found)
    return hits


def _pivot_gaps(pivots: np.ndarray):
    """Column function: distances of a vector to all pivots."""

    @F.pandas_udf("array<double>")
    def gaps(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype=object)
        v = np.stack(vector.to_numpy()).astype(np.float64)
        out = np.empty((len(v), len(pivots)))
        for j, pivot in enumerate(pivots):
            out[:, j] = np.sqrt(((v - pivot) ** 2).sum(axis=1))
        return pd.Series(list(out))

    # computed once, also for the cell that is derived from it
    return gaps.asNondeterministic()


def _own_cell(gaps: str = "gaps"):
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def _block_join(sources: DataFrame, targets: DataFrame, k1: int, block_rows: int, single: bool) -> DataFrame:
    """Join rows that share ``cell``; a cell is cut into pairs of blocks of bounded size.

    ``sources``: cell, u, only_id, radius, vector. ``targets``: cell, u, members, vector.
    """
    spark = sources.sparkSession

    def blocks(df):
        # one row per cell, and there are at most PIVOTS cells
        return {r["cell"]: -(-r["n"] // block_rows) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    source_blocks, target_blocks = blocks(sources), blocks(targets)
    shared = sorted(set(source_blocks) & set(target_blocks))
    if not shared:
        return spark.createDataFrame([], _HIT_SCHEMA)
    plan = F.broadcast(
        spark.createDataFrame([(c, source_blocks[c], target_blocks[c]) for c in shared], "cell int, ns int, nt int")
    )
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        sources.join(plan, "cell")
        .withColumn("sb", F.pmod(F.xxhash64("u"), F.col("ns")).cast("int"))
        .withColumn("tb", numbers("nt"))
        .select("cell", "sb", "tb", "u", "only_id", "radius", "vector")
    )
    right = (
        targets.join(plan, "cell")
        .withColumn("tb", F.pmod(F.xxhash64("u"), F.col("nt")).cast("int"))
        .withColumn("sb", numbers("ns"))
        .select("cell", "sb", "tb", "members", "vector")
    )

    def join_blocks(s: pa.Table, t: pa.Table) -> pa.Table:
        if not s.num_rows or not t.num_rows:
            return pa.Table.from_batches([], _hit_arrow_schema())
        best = _Best(
            s["u"].to_numpy(),
            _matrix(s["vector"]),
            k1,
            radius=s["radius"].to_numpy(),
            only_id=s["only_id"].to_numpy() if single else None,
        )
        vectors = _matrix(t["vector"])
        members = t["members"].combine_chunks()
        for start in range(0, len(members), 256):
            part = members.slice(start, 256)
            ids = part.flatten()
            copies = pc.list_value_length(part).to_numpy(zero_copy_only=False)
            best.add(
                ids.field("id").to_numpy(),
                _scores(ids.field("score")),
                np.repeat(vectors[start : start + 256], copies, axis=0),
            )
        return pa.Table.from_batches([best.hits()])

    keys = ("cell", "sb", "tb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join_blocks, _HIT_SCHEMA)


def _hit_arrow_schema() -> pa.Schema:
    return pa.schema(
        [("u", pa.int64()), ("neighbor_id", pa.int64()), ("neighbor_score", pa.int32()), ("distance", pa.float64())]
    )


def _hit_lists(hits: DataFrame, k1: int) -> DataFrame:
    """Per vector the ``k1`` nearest hits as a sorted array; the rank limit bounds each group."""
    ranked = Window.partitionBy("u").orderBy("distance", "neighbor_id")
    hit = F.struct("distance", "neighbor_id", "neighbor_score")
    return (
        hits.withColumn("rn", F.row_number().over(ranked))
        .where(F.col("rn") <= k1)
        .groupBy("u")
        .agg(F.sort_array(F.collect_list(hit)).alias("near"))
    )


def _others(near: str, k: int):
    """The first ``k`` hits of a list that are not the source itself, as rows."""
    return F.inline(F.slice(F.filter(near, lambda hit: hit["neighbor_id"] != F.col("source_id")), 1, k))


def _radius_of(hits: DataFrame, k1: int) -> DataFrame:
    """Distance of the ``k1``-th hit of each vector; vectors with fewer hits have no row."""
    ranked = Window.partitionBy("u").orderBy("distance", "neighbor_id")
    return (
        hits.withColumn("rn", F.row_number().over(ranked))
        .where(F.col("rn") <= k1)
        .where(F.col("rn") == k1)
        .select("u", F.col("distance").alias("radius"))
    )


def _pivots(measured: DataFrame, count: int) -> np.ndarray:
    """Up to ``count`` different vectors, spread at random by their hash."""
    hashed = measured.select(F.xxhash64("vector").alias("h"), "vector")
    # only hashes are shuffled; both results have at most ``count`` rows
    lowest = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]
    return _matrix(hashed.where(F.col("h").isin(lowest)).dropDuplicates(["h"]).orderBy("h").select("vector").toArrow()["vector"])


def _cell_join(s: DataFrame, t: DataFrame, pivot: np.ndarray, k1: int, single: bool, block_rows: int) -> DataFrame:
    """Both sides large: own cells first, then every other cell that may hold a nearer vector.

    ``s`` and ``t`` are stored, with the distances ``gaps`` to the pivots and their own ``cell``.
    """
    near = materialize(
        _block_join(
            s.withColumn("radius", F.lit(float("inf"))), t.select("cell", "u", "members", "vector"), k1, block_rows, single
        ),
        "own-cell-hits",
    )
    if single:
        real = near.join(s.select("u", "only_id"), "u").where("only_id <> neighbor_id")
        best = real.orderBy("distance").limit(k1 - 1).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
        bound = best["d"] if best["n"] == k1 - 1 else float("inf")
        s = s.withColumn("radius", F.lit(bound))
    else:
        s = s.join(_radius_of(near, k1), "u", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))

    # Per cell: range of distances to its pivot and the widest radius. At most PIVOTS rows.
    reach = s.withColumn("own", F.get("gaps", F.col("cell"))).groupBy("cell").agg(
        F.min("own").alias("lo"), F.max("own").alias("hi"), F.max("radius").alias("r")
    )
    lo, hi, wide = np.full(len(pivot), np.inf), np.full(len(pivot), -np.inf), np.full(len(pivot), -1.0)
    for row in reach.collect():
        lo[row["cell"]], hi[row["cell"]], wide[row["cell"]] = row["lo"], row["hi"], row["r"]
    between = np.sqrt(((pivot[:, None, :] - pivot[None, :, :]) ** 2).sum(axis=2))

    @F.pandas_udf("array<int>")
    def other_cells(own: pd.Series, gap: pd.Series) -> pd.Series:
        if not len(own):
            return pd.Series([], dtype=object)
        g, j = np.stack(gap.to_numpy()), own.to_numpy()
        mine = g[np.arange(len(j)), j][:, None]
        slack = 1e-9 * (1.0 + g)
        ok = (g >= lo - wide - slack) & (g <= hi + wide + slack) & (wide >= 0)
        apart = between[j]
        bisector = np.divide(g * g - mine * mine, 2 * apart, out=np.zeros_like(g), where=apart > 0)
        ok &= bisector <= wide + slack
        ok[np.arange(len(j)), j] = False
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in ok])

    routed = t.select(F.explode(other_cells("cell", "gaps")).alias("cell"), "u", "members", "vector")
    far = _block_join(s.select("cell", "u", "only_id", "radius", "vector"), routed, k1, block_rows, single)
    return near.unionByName(far)


def _pairs_without_distance(sources: DataFrame, slim: DataFrame, k: int, per_article: bool) -> DataFrame:
    """Pairs without a distance, by id; they rank after all others and matter where those are few.

    For a source without a vector every article is such a partner, for the others the articles
    without one. Only the ``k + 1`` smallest ids of either kind can be needed.
    """

    def partners(rows: DataFrame, without_vector: bool) -> DataFrame:
        first = rows.orderBy("id").limit(k + 1)
        hit = F.struct(
            F.lit(None).cast("double").alias("distance"),
            F.col("id").alias("neighbor_id"),
            F.col("score").alias("neighbor_score"),
        )
        return first.agg(F.sort_array(F.collect_list(hit)).alias("near")).select(
            F.lit(without_vector).alias("without_vector"), "near"
        )

    lists = partners(slim, True).unionByName(partners(slim.where("vector is null"), False))
    needy = sources.withColumn("without_vector", F.col("vector").isNull())
    if not per_article:
        needy = (
            needy.where("without_vector").orderBy("source_id").limit(k + 1)
            .unionByName(needy.where("not without_vector").orderBy("source_id").limit(k + 1))
        )
    return needy.join(F.broadcast(lists), "without_vector").select(*_SOURCE, _others("near", k))


_SOURCE = ("source_id", "source_score", "source_agent")


def _join_owners(
    with_vector: DataFrame, measured: DataFrame, k1: int, single: bool, pivots: int, block_rows: int, scans: int
) -> DataFrame:
    """Join of the distinct vectors, and from vectors back to all articles that hold them.

    With ``scans`` the targets are scanned that many times, without (0) the cells are joined.

    A vector held by very many recent articles is a hot key on the way back. There are at most
    ``rows / HOT_COPIES`` of those, so they are broadcast and their articles are not shuffled.
    """
    keyed = with_vector.withColumn("h", F.xxhash64("vector"))
    counted = keyed.groupBy("h", "vector").agg(F.min("source_id").alias("u"), F.count(F.lit(1)).alias("n"))
    only_id = F.when(F.col("n") == 1, F.col("u")).otherwise(F.lit(-1).cast("long"))
    if scans:
        distinct = materialize(counted.withColumn("only_id", only_id), "recent-vectors")
        hits = _block_scans(distinct, measured, k1, single, scans)
    else:
        pivot = _pivots(measured, pivots)
        gaps = _pivot_gaps(pivot)

        def placed(vectors: DataFrame, name: str) -> DataFrame:
            return materialize(vectors.withColumn("gaps", gaps("vector")).withColumn("cell", _own_cell()), name)

        distinct = placed(counted.withColumn("only_id", only_id), "recent-vectors")
        targets = placed(_distinct_vectors(measured, k1).select("u", "vector", "members"), "all-vectors")
        hits = _cell_join(distinct, targets, pivot, k1, single, block_rows)
    lists = materialize(_hit_lists(hits, k1), "nearest")

    key = ["h", "vector"]
    hot = distinct.where(F.col("n") > HOT_COPIES).select(*key, "u")
    if hot.limit(1).count() == 0:
        return keyed.join(distinct.select(*key, "u"), key).join(lists, "u")
    hot, small = broadcast_if_small(hot)
    if not small:
        return keyed.join(distinct.select(*key, "u"), key).join(lists, "u")
    hot_lists = F.broadcast(lists.join(hot.drop(*key), "u"))
    cool = distinct.where(F.col("n") <= HOT_COPIES).select(*key, "u")
    columns = [*_SOURCE, "near"]
    copied = keyed.join(hot, key).join(hot_lists, "u").select(*columns)
    others = keyed.join(hot.drop("u"), key, "left_anti").join(cool, key).join(lists, "u").select(*columns)
    return copied.unionByName(others)


def nearest_neighbors(
    articles: DataFrame,
    as_of: datetime,
    k: int = 10,
    per_article: bool = False,
    vector: str = "embedding2",
    recent_days: int = 2,
    keep_missing: bool = True,
    broadcast_bytes: int = BROADCAST_VECTOR_BYTES,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    most_scans: int = MOST_SCANS,
) -> DataFrame:
    """The ``k`` nearest pairs (recent article, other article), over all or per recent article.

    Returns source_id, source_score, source_agent, neighbor_id, neighbor_score, distance.
    Ties go to the smaller ids. With ``keep_missing`` pairs with a missing vector count too and
    come last; without it they are left out.
    """
    spark = articles.sparkSession
    slim = articles.select(
        "id", F.col("score").cast("int").alias("score"), "agent", "created_at", F.col(vector).cast("array<float>").alias("vector")
    )
    sources = slim.where(F.col("created_at") >= instant(as_of) - F.expr(f"interval {int(recent_days)} days")).select(
        F.col("id").alias("source_id"), F.col("score").alias("source_score"), F.col("agent").alias("source_agent"), "vector"
    )
    measured = slim.where("vector is not null").select("id", "score", "vector")
    with_vector = sources.where("vector is not null")

    k1 = k + 1
    shape = with_vector.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    n = shape["n"]
    if n == 0:
        found = None
    elif n <= BROADCAST_VECTOR_ROWS and n * shape["d"] * 8 <= broadcast_bytes:
        rows = with_vector.withColumnRenamed("source_id", "id").toArrow()
        owner, *distinct = _group_copies(rows)
        hits = _scan_join(spark, *distinct, measured, k1, single=not per_article)
        named = rows.drop_columns("vector").rename_columns(list(_SOURCE)).append_column("u", pa.array(owner))
        owners = F.broadcast(spark.createDataFrame(named))
        found = _hit_lists(hits, k1).join(owners, "u")
    else:
        # the bounds in vectors, half full, so that blocks dealt by hash stay below them
        held = min(BROADCAST_VECTOR_ROWS, broadcast_bytes // (shape["d"] * 8 or 1)) // 2
        scans = -(-n // held) if held else most_scans + 1
        found = _join_owners(with_vector, measured, k1, not per_article, pivots, block_rows, scans if scans <= most_scans else 0)
    if found is None:
        found = spark.createDataFrame([], _PAIR_SCHEMA)
    else:
        found = found.select(*_SOURCE, _others("near", k))

    if keep_missing:
        plenty = n > k or measured.limit(k1).count() > k
        if per_article or not plenty or n == 0:
            short = sources.where("vector is null") if plenty and n else sources
            found = found.unionByName(_pairs_without_distance(short, slim, k, per_article))
            if per_article and not plenty:
                ranked = Window.partitionBy("source_id").orderBy(F.col("distance").asc_nulls_last(), "neighbor_id")
                found = found.withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") <= k).drop("rn")
    if not per_article:
        found = found.orderBy(F.col("distance").asc_nulls_last(), "source_id", "neighbor_id").limit(k)
    return found.select(*_SOURCE, "neighbor_id", "neighbor_score", "distance")


def neighbor_scores(pairs: DataFrame, user_agent: str = "user") -> DataFrame:
    """Score per source: its own where the agent is ``user_agent``, else the neighbours' mean."""
    return (
        pairs.groupBy("source_id", "source_score", "source_agent")
        .agg(F.avg("neighbor_score").alias("mean_score"))
        .select(
            "source_id",
            "source_score",
            F.when(F.col("source_agent") == user_agent, F.col("source_score").cast("double"))
            .otherwise(F.col("mean_score"))
            .alias("calculated_score"),
        )
    )


def rank_by_neighbors(articles: DataFrame, scores: DataFrame, few: bool = False) -> DataFrame:
    """Full article rows with their neighbour score, best first and missing scores at the top.

    ``few`` says that ``scores`` comes from a global top ``k`` and so has at most ``k`` rows.
    """
    scored = scores.select(F.col("source_id").alias("id"), F.col("calculated_score").alias("neighbor_score"))
    if few:
        scored = F.broadcast(scored)
    return articles.join(scored, "id").orderBy(F.col("neighbor_score").desc_nulls_first(), "id")
