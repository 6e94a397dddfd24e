"""Vector tables: exact top-k by inner product, and near-duplicate groups by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, require, settle

#: Vectors and queries that one cell of the search grid holds.
CELL_VECTORS, CELL_QUERIES = 8192, 2048
#: Pairs whose vectors are side by side in memory at a time.
PAIRS = 1 << 15


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): one row per id, with vectors that have only finite components.  Of repeated ids the smallest vector stays."""
    require(vectors, id_col, vec_col)
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return plain.filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment the mean, scaled by the root of its width, and the norm of the deviations from it."""
    n, d = x.shape
    cut = x.reshape(n, parts, d // parts)
    mean = cut.mean(axis=2)
    spread = np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))
    return mean * math.sqrt(d // parts), spread


#: Share of a block's pairs from which a product of whole blocks costs less than gathering the pairs.
DENSE = 0.125


def search_block(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest inner products of each query with rows of other ids, ties to the smaller id: (query row, base row, score).

    The inner product of two segments is at most the product of the scaled means plus that of the deviations' norms, so the
    squared distance has a lower bound from the same figures.  Bounds over 1, then 4, then 16 segments leave ever fewer pairs,
    a finer one being computed only for those that the coarser left; after each the exact scores of its most promising rows
    raise the k-th best score known, which a pair's bound must reach.  Exact products are computed for the survivors.  Where a
    bound leaves most pairs of a block, the next step is one product of blocks.
    """
    d = queries.shape[1]
    levels = [p for p in (1, 4, 16) if p <= d]
    width = levels[-1] * math.ceil(d / levels[-1])
    grow = lambda x: np.pad(x, ((0, 0), (0, width - d)))
    q, b = grow(queries), grow(base)
    exact_floats = d * np.abs(q).max(initial=0) * np.abs(b).max(initial=0) < 2**53
    slack = 1e-9 * np.sqrt((q**2).sum(1)).max(initial=0) * np.sqrt((b**2).sum(1)).max(initial=0) + 1e-9

    def pairs(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", left[rows[i : i + PAIRS]], right[cols[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS)]
        return np.concatenate(parts or [np.zeros(0)])

    def products(left: np.ndarray, right: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Inner products of the pairs that are alive, minus infinity for the others."""
        if alive.mean() > DENSE:
            return np.where(alive, left @ right.T, -np.inf)
        out = np.full(alive.shape, -np.inf)
        rows, cols = np.nonzero(alive)
        out[rows, cols] = pairs(left, right, rows, cols)
        return out

    def whole(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.array([sum(int(x) * int(y) for x, y in zip(q[r], b[c], strict=True)) for r, c in zip(rows, cols, strict=True)], dtype=object)

    stats = [[np.hstack(_segments(x, p)) for x in (q, b)] for p in levels]
    out_q, out_b, out_s = [], [], []
    for start in range(0, len(q) if len(b) else 0, 128):
        own = np.arange(start, min(start + 128, len(q)))
        alive = query_ids[own][:, None] != base_ids[None, :]
        least = np.full(len(own), -np.inf)
        for left, right in stats:
            bound = products(left[own], right, alive)
            # floats that are near enough: the slack covers their rounding
            known = min(len(b), 4 * k)
            seed = np.argpartition(-bound, known - 1, axis=1)[:, :known]
            rows, cols = np.repeat(np.arange(len(own)), known), seed.ravel()
            scores = np.where(alive[rows, cols], pairs(q[own], b, rows, cols), -np.inf).reshape(len(own), known)
            if known >= k:
                least = np.maximum(least, np.sort(scores, axis=1)[:, -k])
            alive &= bound >= (least - slack)[:, None]
        if exact_floats:
            exact = products(q[own], b, alive)
            if len(b) > k:
                # all that reach the k-th score, ties included
                alive &= exact >= -np.partition(-exact, k - 1, axis=1)[:, k - 1 : k]
            rows, cols = np.nonzero(alive)
            scores = exact[rows, cols].astype(np.int64)
        else:
            rows, cols = np.nonzero(alive)
            scores = whole(own[rows], cols)
        order = np.lexsort((base_ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(own)))
        rank = np.arange(len(rows)) - first[rows]
        top = rank < k
        out_q.append(own[rows[top]])
        out_b.append(cols[top])
        out_s.append(scores[top])
    return np.concatenate(out_q or [np.zeros(0, int)]), np.concatenate(out_b or [np.zeros(0, int)]), np.concatenate(out_s or [np.zeros(0, np.int64)])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k rows of the largest integer inner product for every query row: query_id, rank (from 1), id_col, score.

    Components become floor(scale * x).  is_query is a condition on id_col.  Candidates are all rows but those of the query's own
    id; fewer than k give all of them.  Vectors that are null or empty or hold null or non-finite components, and rows with a
    null id, take no part; vectors of different length are not compared.  Of repeated ids the smallest vector counts.  Ties go
    to the smaller id; scores beyond a long are its largest or smallest value.  Rows and queries meet in a grid of bounded blocks, of which each keeps its k best a query.
    """
    base = _valid(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    base = base.select(F.col("id").alias(id_col), "v").withColumn("asks", F.coalesce(is_query, F.lit(False)))
    base = settle(base.select(F.col(id_col).alias("id"), "asks", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("d")), vectors.sparkSession)
    sizes = base.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("bigint")).alias("q")).first()
    over, across = max(1, math.ceil(sizes["n"] / CELL_VECTORS)), max(1, math.ceil((sizes["q"] or 0) / CELL_QUERIES))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = base.select("d", place(over).alias("x"), "id", "v").select("d", "x", every(across).alias("y"), "id", "v")
    asks = base.filter("asks").select("d", place(across).alias("y"), "id", "v").select("d", every(over).alias("x"), "y", "id", "v")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        ids, others = (t.column("id").to_numpy() for t in (left, right))
        a, b, s = search_block(_matrix(left.column("v")), ids, _matrix(right.column("v")), others, k)
        return pa.table({"query_id": ids[a], "id": others[b], "score": pa.array(np.clip(s, -(2**63), 2**63 - 1).astype(np.int64) if s.dtype == object else s, pa.int64())}, schema=kind)

    found = asks.groupBy("d", "x", "y").cogroup(rows.groupBy("d", "x", "y")).applyInArrow(cell, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


# ---------------------------------------------------------------------------
# Near duplicates

#: Vectors that the centres are fitted on, vectors a cell should hold, and the most cells.
SAMPLE, CELL, MOST_CELLS = 20_000, 2048, 4096
#: A vector visits the cells whose centre is at most this much less similar to it than that of its own cell.
MARGIN = 0.25
#: Rows of one product of blocks.
HOME_BLOCK, VISIT_BLOCK = 2048, 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of unit vectors; starts at evenly spaced rows, keeps the centre of a cell that gets empty."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 1e-12
        centres[full] = sums[full] / norm[full, None]
    return centres


def _block_links(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, least: float, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of rows of a with rows of b: the ids that have any, how many each is to count here, and the smallest id it hangs together with in this block.

    A row of a counts all its links; one of b only those with rows of a that it does not meet in its own home (seen is false).
    """
    near = (a @ b.T >= least) & (a_ids[:, None] != b_ids[None, :])
    count, back = near.sum(axis=1), (near & ~seen).sum(axis=0)
    rows, cols = np.flatnonzero(count), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, cols)]
    low_a, low_b = a_ids[rows].copy(), b_ids[cols].copy()
    top = np.iinfo(np.int64).max
    while len(rows):
        new_a = np.minimum(low_a, np.where(near, low_b[None, :], top).min(axis=1))
        new_b = np.minimum(low_b, np.where(near, new_a[:, None], top).min(axis=0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    return np.concatenate([a_ids[rows], b_ids[cols]]), np.concatenate([count[rows], back[cols]]), np.concatenate([low_a, low_b])


def _visits(cells: pa.ListArray, home: np.ndarray) -> np.ndarray:
    """Whether each row of cells, lists of cells, has each home."""
    kinds, at = np.unique(home, return_inverse=True)
    row = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
    hit = kinds[place] == flat
    has = np.zeros((len(cells), len(kinds)), dtype=bool)
    has[row[hit], place[hit]] = True
    return has[:, at]


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", margin: float = MARGIN) -> DataFrame:
    """Groups of vectors linked by cosines of at least `least`: id_col, n_links, component_id, kept; a row per row of the table.

    Centres are fitted by spherical k-means on at most SAMPLE vectors; every vector gets its nearest cell and visits those
    nearly as near (margin), and is compared with all that are at home there, in blocks.  Pairs below `least` are never linked;
    pairs that share no cell are missed, which the tests measure against brute force.  One row per component, that of the
    smallest id, is kept.  Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different length with one another; rows with a null id are left out.  Of repeated ids the smallest vector counts, and the id has one row.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    base = _valid(vectors, id_col, vec_col).filter(F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))
    base = settle(base.withColumn("d", F.size("v")), spark)
    dims = [r["d"] for r in base.groupBy("d").count().orderBy(F.desc("count"), "d").limit(64).collect()]
    n = base.count()
    k = max(1, min(MOST_CELLS, math.ceil(n / CELL)))
    centres = {}
    for d in dims:
        sample = base.filter(F.col("d") == d).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(1, SAMPLE // len(dims))).toArrow()
        x = _unit(_matrix(sample.column("v")))
        centres[d] = spherical_kmeans(x, min(k, len(x)))
    known = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS centres for each of 64 lengths, from SAMPLE vectors in all

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d_all = batch.column("d").to_numpy()
            for d in np.unique(d_all):
                part = batch.filter(pa.array(d_all == d))
                x = _unit(_matrix(part.column("v")))
                c = known.value.get(int(d), x[:1])
                for i in range(0, len(x), 4096):
                    near = x[i : i + 4096] @ c.T
                    home = near.argmax(axis=1)
                    rows, cells = np.nonzero(near >= near.max(axis=1)[:, None] - margin)
                    # the row at home carries all cells that its vector visits
                    own = home[rows] == cells
                    edge = np.searchsorted(rows, np.arange(len(near) + 1))
                    lists = [cells[edge[x] : edge[x + 1]].tolist() if o else None for x, o in zip(rows.tolist(), own.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(rows), d), pa.int32()), "cell": pa.array(cells, pa.int32()), "home": pa.array(home[rows], pa.int32()), "cells": pa.array(lists, pa.list_(pa.int32())), "id": part.column("id").take(pa.array(rows + i)), "v": pa.FixedSizeListArray.from_arrays(pa.array(x[rows + i].ravel()), int(d)).cast(pa.list_(pa.float64()))})

    placed = base.mapInArrow(assign, "d int, cell int, home int, cells array<int>, id bigint, v array<double>")
    placed = placed_table = settle(placed, spark)
    sizes = placed.groupBy("d", "cell").agg(F.sum((F.col("home") == F.col("cell")).cast("bigint")).alias("homes"), F.count("*").alias("visits"))
    # at most 64 * MOST_CELLS rows
    sizes = sizes.select("d", "cell", F.ceil(F.col("homes") / HOME_BLOCK).cast("int").alias("xs"), F.ceil(F.col("visits") / VISIT_BLOCK).cast("int").alias("ys")).filter("xs > 0")
    placed = placed.join(F.broadcast(sizes), ["d", "cell"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    homes = placed.filter("home = cell").select("d", "cell", at("xs").alias("x"), spread("ys").alias("y"), "id", "v", "cells")
    visits = placed.select("d", "cell", spread("xs").alias("x"), at("ys").alias("y"), "id", "v", "home").toDF("d", "cell", "x", "y", "id", "v", "home")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        a_ids, b_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        a, b = _matrix(left.column("v")), _matrix(right.column("v"))
        cells, home = left.column("cells").combine_chunks(), right.column("home").to_numpy()
        parts = []
        for i in range(0, len(a), HOME_BLOCK):
            for j in range(0, len(b), VISIT_BLOCK):
                seen = _visits(cells[i : i + HOME_BLOCK], home[j : j + VISIT_BLOCK])
                ids, n_of, low = _block_links(a[i : i + HOME_BLOCK], a_ids[i : i + HOME_BLOCK], b[j : j + VISIT_BLOCK], b_ids[j : j + VISIT_BLOCK], least, seen)
                parts.append(pa.table({"id": ids, "n": n_of, "low": low}, schema=kind))
        return pa.concat_tables(parts)

    found = settle(homes.groupBy("d", "cell", "x", "y").cogroup(visits.groupBy("d", "cell", "x", "y")).applyInArrow(compare, "id bigint, n bigint, low bigint"), spark)
    discard(base, placed_table)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    out = every.join(links, "id", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-320)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
