"""Exact top-k search by inner product: dual-tree search over cover trees.

Candidates go to the nearest of a bounded number of pivots; a pivot's candidates are a cell, or several pieces of one where they
are more than GROUP. A query is first searched for in one cell of its best pivot, which gives a lower bound of its kth score,
and then only in the cells whose ball (pivot, covering radius) may hold a score of that bound or more.

In a cell a task builds a cover tree over its candidates and one over its queries. The root covers all its points; the
children of a node with covering radius s have centres more than s / BASE apart, the first being the node's own, and
every point of the node lies within s / BASE of its child's centre. A node that would need more than FAN children for that, or
has LEAF points (QUERY_LEAF in the queries' tree) at most, stays a leaf; pairs of WORK scores at most are scored whole. For nodes Q and R no score exceeds q.r + radius_R |q| + radius_Q |r| + radius_Q radius_R; the
pair is dropped if that is below the worst kth score so far of the queries under Q. Where vectors point every way in many
dimensions, as random unit vectors do, no ball can be dropped, and every pair is scored, in blocks.

Components become floor(1024 x), scores are integers: computed in doubles where no sum can pass 2**53, else in Python's
integers, clipped to 64 bits.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without an identifier, take no
part; shorter vectors count as padded with zeros; every row with a query's identifier is a query of its own, whose candidates
are all rows but itself, so rows that repeat identifier and vector find each other and give their results once each; ties go to the
smaller identifier; fewer than k candidates give all; an empty table gives an empty result. Only identifier and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.llm.common import kept_on_disk, partitions, scaled, table

K = 10
SCALE = 1024
SEED = 42
#: Candidates in a cell and queries in a block, at most about; pivots, at most.
GROUP, QUERY_GROUP, MOST_PIVOTS = 16_384, 32_768, 1024
#: Cover trees: points of a leaf of candidates and of queries, children, and the ratio of the covering radii of two levels.
LEAF, QUERY_LEAF, FAN, BASE = 48, 2, 64, 1.3
#: Candidates that are scored against queries at once, scores held at once, and scores that cost about as much as looking further into a pair.
BLOCK, SCORES, WORK = 512, 1 << 21, 1 << 12
#: Queries are the identifiers divisible by this.
EVERY = 100
#: Rounding in bounds, relative to the norms: far above 64-bit floats' own.
SLACK = 1e-9


class CoverNode:
    __slots__ = ("centre", "radius", "kids", "points")

    def __init__(self, centre: int, radius: float, points: np.ndarray, kids: list[CoverNode]) -> None:
        self.centre, self.radius, self.points, self.kids = centre, radius, points, kids


def cover_tree(rows: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> CoverNode:
    """A cover tree over rows; every node lists its points as row numbers."""

    def far(points: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((rows[points] - rows[centre]) ** 2).sum(axis=1))

    root = CoverNode(0, 0.0, np.arange(len(rows)), [])
    work = [(root, far(root.points, 0))]
    while work:
        node, near = work.pop()
        node.radius = float(near.max())
        if len(node.points) <= leaf or node.radius == 0:
            continue
        scale, of, centres, apart = node.radius / BASE, np.zeros(len(near), np.int64), [node.centre], [near]
        while near.max() > scale and len(centres) < fan:
            centre = int(node.points[np.argmax(near)])
            d = far(node.points, centre)
            of[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(centre)
            apart.append(d)
        if near.max() > scale:
            continue
        for j, centre in enumerate(centres):
            own = of == j
            kid = CoverNode(centre, 0.0, node.points[own], [])
            node.kids.append(kid)
            work.append((kid, apart[j][own]))
    return root


def dual_tree_top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query its k best (score, id) in order, how many there are, and the number of pairs scored; scores as exact integers.

    `rows` come in ascending order of `ids`. A row that equals a query in identifier and vector is the query's own, once.
    `floor` is a score that k other candidates of the query reach; what lies below it is not looked for.
    """
    n = len(queries)
    exact = np.float64
    if float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) >= 2.0**53:
        exact = object
    low, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best = np.full((n, k), low, np.int64)
    best_id = np.full((n, k), none, np.int64)
    whole_q, whole_r = (queries, rows) if exact is np.float64 else (np.vectorize(int, otypes=[object])(queries), np.vectorize(int, otypes=[object])(rows))
    q_norm, r_norm = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    filled, pairs = np.zeros(n, np.int64), 0
    floor = np.full(n, -np.inf) if floor is None else floor
    # the query's own row: copies of a row lie next to each other, the first of them stands for it
    own_row = np.full(n, -1)
    first = np.searchsorted(ids, query_ids, side="left")
    for i in np.flatnonzero(first < len(ids)).tolist():
        same = np.arange(first[i], np.searchsorted(ids, query_ids[i], side="right"))
        same = same[(rows[same] == queries[i]).all(axis=1)]
        own_row[i] = same[0] if len(same) else -1

    def base(q: np.ndarray, r: np.ndarray) -> None:
        nonlocal pairs
        pairs += len(q) * len(r)
        r = np.sort(r)
        step = max(1, SCORES // BLOCK)
        for at in range(0, len(q), step):
            for to in range(0, len(r), BLOCK):
                block(q[at : at + step], r[to : to + BLOCK])

    def block(q: np.ndarray, r: np.ndarray) -> None:
        score = whole_q[q] @ whole_r[r].T
        if exact is object:
            score = np.vectorize(lambda v: min(max(v, low + 1), none), otypes=[np.int64])(score)
        score = score.astype(np.int64)
        own = own_row[q][:, None] == r[None, :]
        score[own] = low
        filled[q] += len(r) - own.sum(axis=1)
        hit = (score >= np.maximum(best[q, k - 1], low + 1)[:, None]).any(axis=1)
        if not hit.any():
            return
        q, score = q[hit], score[hit]
        seen = np.where(score == low, none, ids[r][None, :])
        both, both_id = np.concatenate((best[q], score), axis=1), np.concatenate((best_id[q], seen), axis=1)
        order = np.lexsort((both_id, ~both), axis=1)[:, :k]  # ~x falls as x rises, without overflow
        best[q], best_id[q] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)

    def bound(q: CoverNode, r: CoverNode) -> float:
        a, b = q_norm[q.centre], r_norm[r.centre]
        return float(queries[q.centre] @ rows[r.centre]) + r.radius * a + q.radius * b + q.radius * r.radius + SLACK * (a + q.radius) * (b + r.radius) + 1

    def worst(q: CoverNode) -> float:
        own = floor[q.points]
        full = filled[q.points] >= k
        return float(np.where(full, np.maximum(own, best[q.points, k - 1]), own).min())

    # a stack of node pairs, the most promising of a pair's children on top
    stack = [(cover_tree(queries, QUERY_LEAF), cover_tree(rows))] if n and len(rows) else []
    while stack:
        q, r = stack.pop()
        if bound(q, r) < worst(q):
            continue
        if not (q.kids or r.kids) or len(q.points) * len(r.points) <= WORK:
            base(q.points, r.points)
            continue
        both = [(bound(a, b), i, j, a, b) for i, a in enumerate(q.kids or [q]) for j, b in enumerate(r.kids or [r])]
        stack += [(a, b) for _, _, _, a, b in sorted(both, key=lambda p: p[:3])]
    return best, best_id, np.minimum(filled, k), pairs


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the quantised components, of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() of a double column gives a long, which large values would overflow
    floored = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    whole = rows.where(~bad).select("vec_id", floored.alias("v"))
    # rows that differ in zeros at their end are equal
    return whole.select("vec_id", F.expr("slice(v, 1, coalesce(array_max(transform(v, (x, i) -> if(x <> 0, i + 1, 0))), 0))").alias("v"))


def matrix(rows: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(rows), width))
    out[np.repeat(np.arange(len(rows)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy()
    return out


class Cells:
    """Pivots with the covering radii and pieces of their cells; MOST_PIVOTS rows at most."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, pieces: np.ndarray) -> None:
        self.pivots, self.radius, self.pieces = pivots, radius, pieces
        self.norm, self.first = np.linalg.norm(pivots, axis=1), np.cumsum(pieces) - pieces

    def home(self, v: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A piece of each query's best cell."""
        best = np.argmax(np.where(self.pieces > 0, v @ self.pivots.T, -np.inf), axis=1)
        return self.first[best] + codes % self.pieces[best]

    def reached(self, v: np.ndarray, floor: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, piece) for all pieces but `home` that may hold a score of `floor` or more."""
        norm = np.linalg.norm(v, axis=1)[:, None]
        top = v @ self.pivots.T + norm * self.radius + SLACK * norm * (self.norm + self.radius) + 1
        query, pivot = np.nonzero((top >= floor[:, None]) & (self.pieces > 0))
        piece = np.repeat(self.first[pivot], self.pieces[pivot]) + np.arange(int(self.pieces[pivot].sum())) - np.repeat(np.cumsum(self.pieces[pivot]) - self.pieces[pivot], self.pieces[pivot])
        query = np.repeat(query, self.pieces[pivot])
        other = piece != home[query]
        return query[other], piece[other]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; both inputs as whole_vectors gives them, queries among the vectors."""
    spark = vectors.sparkSession
    asked = queries.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("code", F.xxhash64("vec_id", "v"))
    n, nq, width = vectors.count(), asked.count(), vectors.agg(F.max(F.size("v"))).first()[0] or 1
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    many, blocks = min(MOST_PIVOTS, scaled(n, GROUP, min(partitions(spark), n // 2048 + 1))), scaled(nq, QUERY_GROUP, 1)
    first = vectors.orderBy(F.xxhash64("vec_id", "v", F.lit(SEED)), "vec_id").limit(many).select("v").toArrow()
    pivots = np.unique(matrix(first.column("v"), width), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            v = matrix(batch.column("v"), width)
            own = np.argmax(v @ pivots.T - half, axis=1)
            far = np.sqrt(((v - pivots[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far)], names=[*batch.schema.names, "pivot", "far"])

    placed = kept_on_disk(vectors.mapInArrow(assign, "vec_id long, v array<double>, pivot int, far double"))
    counts, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row per pivot
        counts[row["pivot"]], radius[row["pivot"]] = row["n"], row["far"]
    cells = Cells(pivots, radius, -(-counts // GROUP))
    plan = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cells.first, cells.pieces, strict=True))], "pivot int, first long, pieces long")
    # equal rows share a piece, so that a query meets its own row once
    piece = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.greatest("pieces", F.lit(1)))).cast("int")
    block = F.pmod(F.xxhash64("code", F.lit(2)), F.lit(blocks)).cast("int")
    candidates = placed.join(F.broadcast(plan), "pivot").select(piece.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("double").alias("floor"))

    def route(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    v = matrix(part.column("v"), width)
                    home = cells.home(v, part.column("code").to_numpy() & 0x7FFFFFFF)
                    query = np.arange(len(home))
                    if later:
                        query, home = cells.reached(v, part.column("floor").to_numpy(zero_copy_only=False), home)
                    for to in range(0, len(query), 1 << 14):
                        yield pa.RecordBatch.from_arrays([pa.array(home[to : to + (1 << 14)], pa.int32()), *part.take(pa.array(query[to : to + (1 << 14)])).columns], names=["cell", *part.schema.names])

        return run

    def search(part: pa.Table) -> pa.Table:
        asks = pc.greater(part.column("copies"), 0)
        q, r = part.filter(asks), part.filter(pc.invert(asks)).sort_by("vec_id")
        query_ids, ids, codes, copies = q.column("vec_id").to_numpy(), r.column("vec_id").to_numpy(), q.column("code").to_numpy(), q.column("copies").to_numpy()
        if not len(query_ids) or not len(ids):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "code", "copies", "vec_id", "score")})
        best, best_id, found, _ = dual_tree_top_k(matrix(q.column("v"), width), query_ids, matrix(r.column("v"), width), ids, k, q.column("floor").to_numpy())
        at = np.repeat(np.arange(len(found)), found)
        place = np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found)
        held = best[at, place] > np.iinfo(np.int64).min  # what the floor left out is no result
        at, place = at[held], place[held]
        return pa.table({"query_id": query_ids[at], "code": codes[at], "copies": copies[at], "vec_id": best_id[at, place], "score": best[at, place]})

    columns, result = ("cell int, vec_id long, v array<double>, code long, copies long, floor double"), "query_id long, code long, copies long, vec_id long, score long"

    def searched(rows: DataFrame, later: bool) -> DataFrame:
        rows = rows.select("vec_id", "v", "code", "copies", "floor").mapInArrow(route(later), columns).withColumn("block", block)
        return rows.unionByName(candidates).groupBy("cell", "block").applyInArrow(search, result)

    seed = kept_on_disk(searched(asked.withColumn("floor", F.lit(float("-inf"))), False))
    floors = seed.groupBy(F.col("query_id").alias("of"), F.col("code").alias("of_code")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    again = asked.join(floors, (F.col("vec_id") == F.col("of")) & (F.col("code") == F.col("of_code")), "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
    order = W.partitionBy("query_id", "code").orderBy(F.desc("score"), "vec_id")
    found = seed.unionByName(searched(again, True)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.place <> q.place
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
