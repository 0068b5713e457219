"""Exact top-k inner-product search with ball trees, branch and bound.

Each component x of a vector becomes floor(``scale`` * x), x as double; a score
is an integer inner product.  Each query returns its ``k`` highest scores among
all rows but its own, ties to the smaller vec_id.

Method
------
Rows are dealt to shards by the nearest of some centres (a bounded sample, of
least hash of vec_id); a shard above ``SHARD_ROWS`` is split by hash, so equal
vectors don't pile up in one.  A task has one shard and one block of queries.
It builds a ball tree over the shard and, for each query, opens nodes in the
order of their upper bound <q, centre> + |q| * radius until the bound is below
the query's k-th score.  That score is shared: queries first search their own
shard, whose rows lie near them.  The k-th score found there then meets the
bounds of all shards' own balls, which are as many as the centres and travel
with the task: a query is shipped, with its score, to those shards alone whose
bound reaches it.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part; only vectors of equal length are compared; rows with the query's
vec_id are its own; repeated query rows are one query; fewer than k candidates
give fewer ranks; integers of any size are exact, and a score beyond 64 bits is
held at the limit of long; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

LEAF_ROWS = 64
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
CENTRES_MOST = 512

_FOUND = "query_id long, vec_id long, score long"


def whole(rows: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) as int64 where all fit in 31 bits, as Python integers otherwise."""
    x = np.floor(np.array(rows, np.float64) * scale)
    if np.abs(x).max(initial=0) < 1 << 31:
        return x.astype(np.int64)
    return np.array([[math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in row] for row in rows], object)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of one integer vector with rows of others."""
    if q.dtype == object or x.dtype == object:
        top = (1 << 63) - 1
        return np.array([max(-top - 1, min(top, int(sum(int(a) * int(b) for a, b in zip(q, row, strict=True))))) for row in x], np.int64)
    if float(np.abs(q).sum()) * float(np.abs(x).max(initial=0)) < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if float(np.abs(q).sum()) * float(np.abs(x).max(initial=0)) < 1 << 62:
        return x @ q
    return products(q.astype(object), x.astype(object))


class BallTree:
    """Nodes with a centre and a radius; leaves hold at most ``LEAF_ROWS`` rows."""

    def __init__(self, x: np.ndarray):
        self.points = x.astype(np.float64)
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        centre, radius = [], []
        waiting = [(np.arange(len(x)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            me = len(self.rows)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            p = self.points[rows]
            mean = p.mean(axis=0)
            centre.append(mean)
            radius.append(float(np.sqrt(((p - mean) ** 2).sum(axis=1).max())))
            self.children.append(None)
            self.rows.append(rows)
            if len(rows) > LEAF_ROWS and radius[-1] > 0:
                axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
                order = rows[np.argsort(p[:, axis], kind="stable")]
                half = len(order) // 2
                waiting += [(order[:half], me, 0), (order[half:], me, 1)]
                self.rows[me] = rows[:0]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries x nodes) no less than any score in the node."""
        q = q.astype(np.float64)
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        slack = 1e-9 * size * (np.sqrt((self.centre**2).sum(axis=1)) + self.radius)[None, :] + 1
        return q @ self.centre.T + size * self.radius[None, :] + slack


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, query_id: int, k: int, least: int | None) -> list[tuple[int, int]]:
    """The query's best k (score, vec_id) in the tree that reach ``least``."""
    best: list[tuple[int, int]] = []  # a heap, worst first: (score, -vec_id)
    heap = [(-bound[0], 0)]
    floor = -math.inf if least is None else least
    while heap:
        up, node = heapq.heappop(heap)
        if -up < floor:
            break
        if tree.children[node]:
            for child in tree.children[node]:
                if bound[child] >= floor:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        rows = tree.rows[node]
        score = products(q, x[rows])
        for i in np.flatnonzero(score >= floor):
            at, vec = int(score[i]), int(ids[rows[i]])
            if vec == query_id:
                continue
            item = (at, -vec)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            floor = max(floor, best[0][0])
    return [(s, -v) for s, v in best]


def _search_shard(k: int, scale: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if shard.num_rows and queries.num_rows:
            ids = shard.column("vec_id").to_numpy()
            x = whole(shard.column("embedding").to_pylist(), scale)
            q = whole(queries.column("embedding").to_pylist(), scale)
            tree = BallTree(x)
            least = queries.column("least").to_pylist()
            names = queries.column("vec_id").to_pylist()
            for a in range(0, len(names), 256):
                bound = tree.bounds(q[a : a + 256])
                for i, name in enumerate(names[a : a + 256]):
                    out += [(name, v, s) for s, v in search(tree, x, ids, q[a + i], bound[i], name, k, least[a + i])]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _nearest(centres: dict[int, np.ndarray], scale: int):
    """Each row's length, nearest centre and distance of its whole components to the centre's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                vectors = part.column("embedding").to_pylist()
                shard, away = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.inf)
                sizes = np.array([len(v) for v in vectors])
                for dim in np.unique(sizes):
                    if dim in centres:
                        at = np.flatnonzero(sizes == dim)
                        with np.errstate(over="ignore", invalid="ignore"):
                            x, c = np.floor(np.array([vectors[i] for i in at], np.float64) * scale), centres[int(dim)]
                            far = (c**2).sum(axis=1)[None, :] - 2 * (x @ c.T)
                            shard[at] = np.nan_to_num(far, nan=np.inf, posinf=np.inf).argmin(axis=1)
                            away[at] = np.sqrt(((x - c[shard[at]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int32()), pa.array(shard), pa.array(away)], names=[*part.schema.names, "dim", "shard", "away"])

    return run


def _promising(centres: dict[int, np.ndarray], radius: dict[tuple[int, int], float], scale: int):
    """Each query once for every shard whose ball may hold one of its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            dims = batch.column(names.index("dim")).to_numpy()
            rows, shards = [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                held = sorted(s for d, s in radius if d == dim) or [0]  # without a centre all rows are in one shard
                open_to = np.ones((len(at), len(held)), bool)
                if dim in centres:
                    c, r = centres[int(dim)][held], np.array([radius[dim, s] for s in held])
                    part = batch.take(pa.array(at))
                    least = np.array([-np.inf if v is None else v for v in part.column(names.index("least")).to_pylist()], np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        q = np.floor(np.array(part.column(names.index("embedding")).to_pylist(), np.float64) * scale)
                        size = np.sqrt((q**2).sum(axis=1))[:, None]
                        bound = q @ c.T + size * r + 1e-9 * size * (np.sqrt((c**2).sum(axis=1)) + r) + 1
                        open_to = ~(bound < least[:, None])  # a bound that overflows keeps its shard
                i, j = np.nonzero(open_to)
                rows.append(at[i])
                shards.append(np.array(held, np.int32)[j])
            pick = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            out = batch.take(pick)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(shards) if shards else [], pa.int32())], names=[*names, "shard"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row's ``k`` best rows."""
    space = Workspace(vectors.sparkSession, "search")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))

    n = rows.count()
    picked = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(CENTRES_MOST, max(1, math.ceil(n / SHARD_ROWS * 4))))
    centres: dict[int, list] = {}
    for r in rows.join(F.broadcast(picked), "vec_id").select("embedding").collect():  # CENTRES_MOST ids at most
        centres.setdefault(len(r[0]), []).append(r[0])
    with np.errstate(over="ignore"):
        near = {d: np.floor(np.array(c, np.float64)[:CENTRES_MOST] * scale) for d, c in centres.items()}

    dealt = space.keep(rows.mapInArrow(_nearest(near, scale), "vec_id long, embedding array<double>, is_query boolean, dim int, shard int, away double"), "dealt")
    sizes = space.keep(dealt.groupBy("dim", "shard").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("cells"), F.max("away").alias("radius")), "sizes")
    radius = {(r.dim, r.shard): r.radius for r in sizes.filter(F.col("dim").isin(*near)).collect()}  # CENTRES_MOST rows at most
    sizes = sizes.drop("radius")
    cell = F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int")
    stored = dealt.join(F.broadcast(sizes), ["dim", "shard"]).withColumn("cell", cell)  # a row for each centre at most

    queries = stored.filter("is_query").select("vec_id", "embedding", "dim", "shard", "cell").dropDuplicates(["vec_id"])
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, math.ceil(queries.count() / QUERY_ROWS)))).cast("int"))
    queries = space.keep(queries, "queries")
    key = ["dim", "shard", "cell", "block"]

    def meet(asked: DataFrame, name: str) -> DataFrame:
        wanted = asked.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct().toDF(*key)  # columns of their own: both sides meet again below
        held = stored.select("vec_id", "embedding", "dim", "shard", "cell").join(wanted, ["dim", "shard", "cell"])
        return space.keep(held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search_shard(k, scale), _FOUND), name)

    first = meet(queries.select(*key, "vec_id", "embedding", F.lit(None).cast("long").alias("least")), "home")
    floor = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("found")).select(F.col("query_id").alias("vec_id"), F.when(F.col("found") >= k, F.col("low")).alias("least"))
    known = queries.join(floor, "vec_id", "left").select("vec_id", "embedding", "dim", "block", "least", F.struct("shard", "cell").alias("home"))
    wanted = known.mapInArrow(_promising(near, radius, scale), "vec_id long, embedding array<double>, dim int, block int, least long, home struct<shard:int,cell:int>, shard int")
    cells = sizes.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    asked = wanted.join(cells, ["dim", "shard"]).filter(F.struct("shard", "cell") != F.col("home"))
    rest = meet(asked.select(*key, "vec_id", "embedding", "least"), "others")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vector_search(spark, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector of ``embeddings``."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
