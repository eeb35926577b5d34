"""Nearest neighbours by inner product, with one vantage-point tree per shard.

Inner products become distances by one more component: with M the greatest squared norm, a
vector x gets ``sqrt(M - |x|^2)`` and a query 0, and the squared distance to query q is
``|q|^2 + M - 2 <q, x>``. Trees, ball bounds and pruning work on these distances; results are
inner products of the vectors as given.

A node keeps a vantage point, the median distance to it, and thereby two halves; small parts
are leaves that are searched by one matrix product. A half is skipped if the triangle
inequality puts it ``1 / factor`` of the present bound away or more: with factor 1 only what
cannot hold a nearer one is skipped and the search is exact; greater factors skip more.

A matrix product rounds a pair's sum by the shape of the whole product, so it only picks the pairs that may be
among the best, with a margin above any rounding. Their scores are summed anew, component after component;
equal vectors thus have equal scores in every task, and ties go to the smaller id.

Trees are built once and written as one binary row a shard. Queries form blocks; the blocks
meet the shards by an equality join on the block's number, with which every tree is listed
once for each block, so a task holds one tree and one block. Partial results, ``k`` a query and shard, are
ranked again over all shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, inputs, stage

by_value(__name__)

RESULT = "query_id long, vec_id long, score double"


def build_tree(points: np.ndarray, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and nodes in preorder: (begin, middle, end) and (least distance of
    the outer half, greatest of the inner one).

    A node spans ``order[begin:end]``; ``middle`` is where its outer half begins, -1 in a leaf.
    The first of a span is its vantage point, which belongs to no half.
    """
    random = np.random.default_rng(seed)
    order = np.arange(len(points))
    spans, radii = [], []

    def grow(begin: int, end: int) -> None:
        if end - begin <= leaf:
            spans.append((begin, -1, end))
            radii.append((0.0, 0.0))
            return
        pick = begin + int(random.integers(end - begin))
        order[[begin, pick]] = order[[pick, begin]]
        rest = order[begin + 1 : end]
        distance = np.sqrt(((points[rest] - points[order[begin]]) ** 2).sum(axis=1))
        by_distance = np.argsort(distance, kind="stable")
        order[begin + 1 : end] = rest[by_distance]
        distance = distance[by_distance]
        half = len(distance) // 2
        spans.append((begin, begin + 1 + half, end))
        radii.append((float(distance[half]), float(distance[half - 1]) if half else 0.0))
        grow(begin + 1, begin + 1 + half)
        grow(begin + 1 + half, end)

    grow(0, len(points))
    return order, np.array(spans, np.int64), np.array(radii)


def pair_scores(queries: np.ndarray, points: np.ndarray, row: np.ndarray, column: np.ndarray, pairs: int = 1 << 16) -> np.ndarray:
    """Inner products of ``queries[row]`` and ``points[column]``, summed from the first component to the last."""
    out = np.zeros(len(row))
    for begin in range(0, len(row), pairs):
        part = slice(begin, begin + pairs)
        left, right = queries[row[part]], points[column[part]]
        for i in range(left.shape[1]):
            out[part] += left[:, i] * right[:, i]
    return out


class Search:
    """The ``k`` best of one tree for a block of queries, all descending together."""

    def __init__(self, tree, queries, query_ids, k, factor, most):
        self.ids, self.vectors, self.spans, self.radii = tree
        self.queries, self.query_ids, self.k, self.factor = queries, query_ids, k, factor
        self.base = (queries**2).sum(axis=1) + most
        # Twice what two orders of summation may differ by.
        self.margin = 8 * (queries.shape[1] + 1) * np.finfo(float).eps * np.sqrt((queries**2).sum(axis=1) * most)
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visited = 0

    def offer(self, active: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Products of the active queries with a span of points; keeps the best ``k``."""
        products = self.queries[active] @ self.vectors[begin:end].T
        self.visited += products.size
        ids = np.broadcast_to(self.ids[begin:end], products.shape)
        offered = np.where(ids == self.query_ids[active][:, None], -np.inf, products)
        least = self.scores[active, -1] - self.margin[active]
        hopeful = np.flatnonzero((offered >= least[:, None]).any(axis=1))
        if len(hopeful):
            rows, offered, least = active[hopeful], offered[hopeful], least[hopeful]
            if offered.shape[1] > self.k:
                own = np.partition(offered, -self.k, axis=1)[:, -self.k]
                least = np.maximum(least, own - self.margin[rows])
            row, column = np.nonzero((offered >= least[:, None]) & ~np.isneginf(offered))
            exact = np.full(offered.shape, -np.inf)
            exact[row, column] = pair_scores(self.queries, self.vectors, rows[row], begin + column)
            scores = np.concatenate([self.scores[rows], exact], axis=1)
            names = np.concatenate([self.found[rows], np.where(np.isneginf(exact), np.iinfo(np.int64).max, ids[hopeful])], axis=1)
            best = np.lexsort((names, -scores), axis=1)[:, : self.k]
            self.scores[rows] = np.take_along_axis(scores, best, axis=1)
            self.found[rows] = np.take_along_axis(names, best, axis=1)
        return products

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th best so far, infinite before there are ``k``."""
        return np.sqrt(np.maximum(self.base[rows] - 2 * self.scores[rows, -1], 0))

    def visit(self, node: int, active: np.ndarray) -> int:
        """Searches a node's subtree; returns the number of the node after it."""
        begin, middle, end = self.spans[node]
        if middle < 0:
            if len(active):
                self.offer(active, begin, end)
            return node + 1
        inner, outer = node + 1, self.after(node + 1)
        if not len(active):
            return self.after(outer)
        product = self.offer(active, begin, begin + 1)[:, 0]
        distance = np.sqrt(np.maximum(self.base[active] - 2 * product, 0))
        median, inner_end = self.radii[node]
        close = distance < median
        self.visit(inner, active[close])
        self.visit(outer, active[~close])
        # Rounded squares of distances may be off by so much near zero.
        slack = self.reach(active) / self.factor + 1e-7 * np.sqrt(self.base[active])
        self.visit(outer, active[close & (np.maximum(median - distance, 0) <= slack)])
        self.visit(inner, active[~close & (distance - inner_end <= slack)])
        return self.after(outer)

    def after(self, node: int) -> int:
        """The node after a subtree, in preorder."""
        return node + self.sizes[node]

    def run(self) -> None:
        sizes = np.ones(len(self.spans), np.int64)
        # In preorder a subtree ends where the next span outside it begins.
        stack = []
        for node in range(len(self.spans) - 1, -1, -1):
            if self.spans[node][1] >= 0:
                inner, outer = stack.pop(), stack.pop()
                sizes[node] += sizes[inner] + sizes[outer]
            stack.append(node)
        self.sizes = sizes
        if len(self.spans):
            self.visit(0, np.arange(len(self.queries)))


def usable(rows: DataFrame, dimension: int | None) -> tuple[DataFrame, int | None]:
    """Rows whose vector is finite, not zero and of the given (or most frequent) length."""
    clean = rows.filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    if dimension is None:
        first = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dimension = first[0] if first else None
    return clean.filter(F.size("vector") == F.lit(dimension or 0)), dimension


def nearest_by_product(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    factor: float = 2.0,
    shard_rows: int = 8192,
    leaf: int = 256,
    block_rows: int = 4096,
    dimension: int | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found of greatest inner product.

    ``is_query`` is a condition on ``vec_id``. Every other usable row is a candidate, a query never finds its own id;
    with fewer candidates than ``k`` all come. Vectors null, zero, with a null or
    non-finite component, without id, or of another length than most take no part.
    Of rows repeated under one id one counts. Ties go to the smaller id. All arithmetic is in double
    precision. An empty table gives no rows.
    """
    rows = inputs(vectors, "embeddings", vec_id=vec_id, vector=embedding)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows, dimension = usable(rows, dimension)
    one = stage(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    total, most, queries = one.agg(
        F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)),
        F.sum(is_query.cast("long")),
    ).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-(queries or 0) // block_rows))
    most = float(most or 0.0) * (1 + 1e-12)

    def build(table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        matrix = np.asarray(table.column("vector").combine_chunks().flatten()).reshape(len(ids), -1)[order]
        ids = ids[order]
        lift = np.sqrt(np.maximum(most - (matrix**2).sum(axis=1), 0))
        placed, spans, radii = build_tree(np.column_stack([matrix, lift]), leaf, seed=int(table.column("shard")[0].as_py()))
        parts = [ids[placed], matrix[placed], spans, radii]
        return pa.table({n: pa.array([p.tobytes()], pa.binary()) for n, p in zip(("ids", "points", "spans", "radii"), parts)})

    def pack(table):
        ids = table.column("vec_id").to_numpy()
        matrix = np.asarray(table.column("vector").combine_chunks().flatten())
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "query_ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([matrix.tobytes()], pa.binary()),
        })

    def numbered(column, count, salt):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int").alias(column)

    trees = stage(
        one.select("vec_id", "vector", numbered("shard", shards, "shard")).groupBy("shard")
        .applyInArrow(build, "ids binary, points binary, spans binary, radii binary")
    )
    asked = (
        one.filter(is_query).select("vec_id", "vector", numbered("block", blocks, "block")).groupBy("block")
        .applyInArrow(pack, "block int, query_ids binary, queries binary")
    )
    paired = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block").select(
        "ids", "points", "spans", "radii", "query_ids", "queries"
    )

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                cell = [np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.float64, np.int64, np.float64, np.int64, np.float64))]
                tree = cell[0], cell[1].reshape(len(cell[0]), -1), cell[2].reshape(-1, 3), cell[3].reshape(-1, 2)
                found = Search(tree, cell[5].reshape(len(cell[4]), -1), cell[4], k, factor, most)
                found.run()
                kept = ~np.isneginf(found.scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(cell[4], k)[kept.reshape(-1)]), pa.array(found.found[kept]), pa.array(found.scores[kept])],
                    ["query_id", "vec_id", "score"],
                )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        paired.repartition(max(1, min(shards * blocks, 100_000))).mapInArrow(search, RESULT)
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
