"""Operator 7: nearest neighbours by cosine through low-dimensional stable projections.

Unit vectors are projected on a few Gaussian directions. Projected squared
distance over true squared distance is chi-square distributed, so neighbours
are verified in the order of their projected distance, and the search stops
when a row nearer than the k-th best would, by that law, have been projected
farther away only with a small probability. A kd-tree over the projections
cuts the rows into shards and gives that order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from alertloom.llm.common import in_arrow
from alertloom.session import write_and_read

K = 5
AXES = 8  # even, for the closed form below
CERTAINTY = 0.99
SEED = 7
SAMPLE = 16_384  # rows whose projections fit the upper tree; every row is indexed
SHARD_ROWS = 4096
SHARD_QUERIES = 8192
BUCKET = 512


def chi_square_below(x: float, axes: int) -> float:
    """P(X <= x) for a chi-square variable with an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(axes // 2))


def stop_factor(certainty: float, axes: int) -> float:
    """The smallest ratio of squared distances at which the stopping test holds."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, axes) < certainty else (low, middle)
    return high


class KdTree:
    """Medians of the widest axis, down to leaves of at most ``size`` points."""

    def __init__(self, points: np.ndarray, size: int) -> None:
        self.order: list[np.ndarray] = []
        self.splits: list[tuple] = []  # inner nodes: (axis, value, left, right); a child below 0 is leaf -1 - child
        self.root = self._grow(points, np.arange(len(points)), size)

    def _grow(self, points: np.ndarray, own: np.ndarray, size: int) -> int:
        spread = np.ptp(points[own], axis=0) if len(own) > size else np.zeros(1)
        axis = int(spread.argmax())
        if not spread[axis]:
            self.order.append(own)
            return -len(self.order)
        column = points[own, axis]
        value = float(np.median(column))
        left = column < value if value > column.min() else column <= value
        at = len(self.splits)
        self.splits.append(())
        a, b = self._grow(points, own[left], size), self._grow(points, own[~left], size)
        bound = float(column[~left].min())
        self.splits[at] = (axis, bound, a, b)
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
                continue
            axis, value, a, b = self.splits[node]
            left = points[own, axis] < value
            todo += [(a, own[left]), (b, own[~left])]
        return out

    def regions(self, axes: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the leaves; together they fill the space."""
        low, high = np.full((len(self.order), axes), -np.inf), np.full((len(self.order), axes), np.inf)
        todo = [(self.root, np.full(axes, -np.inf), np.full(axes, np.inf))]
        while todo:
            node, a, b = todo.pop()
            if node < 0:
                low[-1 - node], high[-1 - node] = a, b
                continue
            axis, value, left, right = self.splits[node]
            cut_b, cut_a = b.copy(), a.copy()
            cut_b[axis], cut_a[axis] = value, value
            todo += [(left, a, cut_b), (right, cut_a, b)]
        return low, high


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(1)


class Shard:
    """Some rows under a kd-tree of their projections, stored leaf by leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> None:
        leaves = KdTree(points, BUCKET).order
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.units = self.vectors / np.sqrt((self.vectors * self.vectors).sum(1))[:, None]
        self.ends = np.cumsum([len(own) for own in leaves])
        self.low, self.high = np.array([points[own].min(0) for own in leaves]), np.array([points[own].max(0) for own in leaves])

    def nearest(self, query_id: int, vector: np.ndarray, point: np.ndarray, bound: float, k: int, factor: float) -> list[tuple[float, int]]:
        """The best (score, id) of the shard; ``bound`` is a squared distance within which k others are known.

        A fast product picks the rows of a leaf that can still matter; their
        scores are then worked out row by row, so that equal vectors get equal ones.
        """
        norm = math.sqrt(float((vector * vector).sum()))
        unit = vector / norm
        best: list[tuple[float, int]] = []
        away = box_distance(point, self.low, self.high)
        for leaf in np.argsort(away, kind="stable"):
            if away[leaf] > bound * factor:
                break
            begin, end = self.ends[leaf - 1] if leaf else 0, self.ends[leaf]
            near = self.units[begin:end] @ unit
            enough = 1 - bound / 2 - 1e-9
            if len(near) > 4 * (k + 1):
                enough = max(enough, float(np.partition(near, -(k + 1))[-(k + 1)]) - 1e-9)  # the query itself may be one of them
            own = begin + np.flatnonzero(near >= enough)
            own = own[self.ids[own] != query_id]
            if not len(own):
                continue
            rows = self.vectors[own]
            scores = (rows * vector).sum(1) / (np.sqrt((rows * rows).sum(1)) * norm)
            best = sorted([*best, *zip(scores.tolist(), self.ids[own].tolist())], key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                bound = min(bound, max(0.0, 2 - 2 * best[-1][0]) + 1e-12)
        return best


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): one row per id with a vector that can be compared.

    Left out: null ids; vectors that are null, empty, zero or hold a null or
    non-finite component; vectors of another length than most (ties: the
    longer). Of a repeated id the vector that sorts first counts.
    """
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return fine.filter(F.size("v") == (sizes["dim"] if sizes else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def projected(rows: DataFrame, axes: int, seed: int) -> DataFrame:
    """(vec_id, v, p): the vector and the projection of its unit vector, as bytes of doubles."""

    def run(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            directions = np.random.default_rng(seed).standard_normal((v.shape[1], axes))
            p = (v / np.sqrt((v * v).sum(1))[:, None]) @ directions
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in p], pa.binary())],
                ["vec_id", "v", "p"])

    return in_arrow(rows, run, "vec_id long, v binary, p binary")


def _doubles(column, width: int | None = None) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, width or 1))


def _found(query: list[int], ids: list[int], score: list[float]) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


FOUND = "query_id long, vec_id long, score double"


def search_shards(rows: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """Searches ``asked(query_id, v, p, bound, leaf, cut)`` in ``rows(vec_id, v, p, leaf, cut)``.

    A shard is a leaf's cut. Its queries come in blocks of bounded size, each
    with a copy of the shard.
    """
    blocks = asked.groupBy("leaf", "cut").agg(F.ceil(F.count(F.lit(1)) / SHARD_QUERIES).cast("int").alias("blocks"))
    left = rows.join(blocks, ["leaf", "cut"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = asked.join(blocks, ["leaf", "cut"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if shard.num_rows and queries.num_rows:
            own = Shard(shard.column("vec_id").to_numpy(), _doubles(shard.column("v")), _doubles(shard.column("p")))
            for query, vector, point, bound in zip(queries.column("query_id").to_pylist(), _doubles(queries.column("v")),
                                                   _doubles(queries.column("p")), queries.column("bound").to_pylist()):
                for score, row in own.nearest(query, vector, point, bound, k, factor):
                    for column, value in zip(out, (query, row, score)):
                        column.append(value)
        return _found(*out)

    keys = ["leaf", "cut", "block"]
    return left.select(*keys, "vec_id", "v", "p").groupBy(*keys).cogroup(
        right.select(*keys, "query_id", "v", "p", "bound").groupBy(*keys)).applyInArrow(run, FOUND)


def nearest_neighbours(rows: DataFrame, every: int = 50, k: int = K, axes: int = AXES, certainty: float = CERTAINTY, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of every query (vec_id divisible by ``every``).

    Rows that ``usable`` leaves out take no part on either side. Of equal
    vectors only the k + 1 smallest ids are kept as candidates, which is all a
    query can return. Fewer than k candidates: all of them. Equal scores go to
    the smaller vec_id. Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    factor = stop_factor(certainty, axes)
    known = write_and_read(projected(usable(rows), axes, seed), "projections")
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    sample = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("p").collect()
    points = np.frombuffer(b"".join(bytes(r["p"]) for r in sample), np.float64).reshape(-1, axes)
    n = known.count()
    upper = spark.sparkContext.broadcast(KdTree(points, max(16, math.ceil(len(points) * SHARD_ROWS / max(n, 1)))))

    def place(batches):
        for batch in batches:
            yield batch.append_column("leaf", pa.array(upper.value.leaf_of(_doubles(batch.column("p"), axes)).astype(np.int32)))

    placed = in_arrow(known, place, "vec_id long, v binary, p binary, leaf int")
    candidates = placed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    cuts = candidates.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("cuts"))
    candidates = write_and_read(candidates.join(cuts, "leaf").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int")), "shards")
    shards = sorted((r["leaf"], r["cuts"]) for r in candidates.select("leaf", "cuts").distinct().collect())  # at most SAMPLE / 16 leaves
    queries = placed.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")

    home = queries.withColumns({"bound": F.lit(1e9), "cut": F.lit(0)})
    first = write_and_read(search_shards(candidates, home, k, factor), "nearest")
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).select(
        "query_id", F.when(F.col("n") == k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")) + 1e-12).alias("bound"))
    open_ = queries.join(bounds, "query_id", "left").fillna({"bound": 1e9})

    def route(batches):
        low, high = upper.value.regions(axes)
        for batch in batches:
            at, leaf, cut = [], [], []
            for i, (point, bound, own) in enumerate(zip(
                    _doubles(batch.column("p"), axes), batch.column("bound").to_pylist(), batch.column("leaf").to_pylist())):
                away = box_distance(point, low, high)
                for shard, number in shards:
                    if away[shard] <= bound * factor:
                        for c in range(1 if shard == own else 0, number):
                            at.append(i)
                            leaf.append(shard)
                            cut.append(c)
            take = batch.select(["query_id", "v", "p", "bound"]).take(pa.array(at, pa.int64()))
            yield take.append_column("leaf", pa.array(leaf, pa.int32())).append_column("cut", pa.array(cut, pa.int32()))

    rest = in_arrow(open_.select("query_id", "v", "p", "bound", "leaf"), route, "query_id long, v binary, p binary, bound double, leaf int, cut int")
    found = first.unionByName(search_shards(candidates, rest, k, factor))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
