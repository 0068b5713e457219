"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

Vectors of one label (and one length) are linked when their cosine, in double
precision, reaches the threshold.  Every link counts for both ends, and a
vector belongs to the component of all it can reach.

Method
------
Equal vectors of a label are one class with a number of copies.  A hash turns a
class's unit vector by three rounds of random signs and a Hadamard transform
and takes the signed axis that it lies closest to; ``hashes`` of them make a
table's bucket.  Each class is stored in one bucket of each table and looks
into all buckets of its two closest axes per hash.  ``plan_tables`` measures on
random pairs at the threshold how often one table finds them, and takes so many
tables that one pair in a million would be missed if tables were independent;
they aren't quite, and a test measures the recall.  ``hashes`` grows with the
number of vectors, so that a bucket holds about ``BUCKET_GOAL`` at most.

Buckets are counted on narrow rows first, and those of one class go.  A pair is
verified in each table that brings it together and counted in the first, which
its two hashes tell: the task computes them again for linked pairs alone, so
vectors travel without them.  A bucket sends back each class's number of links
and a star over what is connected, never a list of pairs.  Buckets above
``BLOCK`` rows are cut into blocks whose pairs are separate buckets, so none is
held whole.

Edge cases: a null label, a null or empty vector, one of zeros or with null or
non-finite components links with nothing (0 links, own component, kept); rows
that share a vec_id are one vector in components, and each of them is a vector
in the count of links; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .skew import join_unique
from .workspace import Workspace

PROBES = 2
MISS = 1e-6
BUCKET_GOAL = 512
BLOCK = 4096
BIN_ROWS = 16_384
PAIRS_AT_ONCE = 200_000
SEED = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def nearest_axes(x: np.ndarray, seed: int) -> np.ndarray:
    """The ``PROBES`` closest signed axes of each row after one pseudo-random rotation, closest first."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    for sign in np.random.default_rng([SEED, seed]).integers(0, 2, (3, size)) * 2 - 1:
        y = hadamard(y * sign)
    best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :PROBES]
    return best * 2 + (np.take_along_axis(y, best, 1) < 0)


def codes(x: np.ndarray, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x tables) buckets that hold a row and (rows x tables x probes) buckets that it looks into, its own first."""
    axes = 2 * max(2, 1 << (x.shape[1] - 1).bit_length())
    own, looks = [], []
    for t in range(tables):
        near = [nearest_axes(x, t * hashes + h).astype(np.int64) for h in range(hashes)]
        tries = [sum(near[h][:, pick[h]] * axes**h for h in range(hashes)) for pick in itertools.product(range(PROBES), repeat=hashes)]
        own.append(tries[0])
        looks.append(np.stack(tries, axis=1))
    return np.stack(own, axis=1), np.stack(looks, axis=1)


@lru_cache
def plan_tables(dim: int, cosine: float, rows: int) -> tuple[int, int]:
    """(hashes, tables) for so many vectors of ``dim`` components."""
    axes = 2 * max(2, 1 << (dim - 1).bit_length())
    hashes = next(k for k in itertools.count(1) if axes**k * BUCKET_GOAL >= rows or axes ** (k + 1) > 1 << 62)
    rng = np.random.default_rng(SEED)
    a = rng.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.normal(size=a.shape)
    away -= (away * a).sum(axis=1, keepdims=True) * a
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * away
    own, _ = codes(a, hashes, 4)
    _, looks = codes(b, hashes, 4)
    found = min(0.999, float((own[:, :, None] == looks).any(axis=2).mean()))
    return hashes, max(2, math.ceil(math.log(MISS) / math.log(1 - found)))


def unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(cosine: float, rows: int):
    """The buckets that each class looks into, table by table, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                vectors = part.column(0).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    _, looks = codes(unit([vectors[i] for i in at]), *plan_tables(int(dim), cosine, rows))
                    rest = part.take(pa.array(at)).columns[1:]
                    dims = pa.array(np.full(len(at), dim), pa.int32())
                    each = pa.array(np.full(len(at), looks.shape[2]), pa.int32())
                    yield pa.RecordBatch.from_arrays([*rest, dims, each, pa.array(looks.reshape(len(at), -1).tolist(), pa.list_(pa.int64()))], names=[*part.schema.names[1:], "dim", "each", "looks"])

    return run


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pairs(stored: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stored row, other row of its bucket) pairs, ``PAIRS_AT_ONCE`` or so at a time."""
    upto = np.cumsum(size)
    at = 0
    while at < len(stored):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = size[at:stop]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(stored[at:stop], n), np.repeat(begin[at:stop], n) + within
        at = stop


def _verify(cosine: float, rows: int):
    """Links and stars of all buckets of a bin: every stored row with every row that looks into its bucket."""

    def run(group: pa.Table) -> pa.Table:
        n = group.num_rows
        label = group.column("label").combine_chunks().dictionary_encode()
        label = label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label
        i, j, table, code = (group.column(c).to_numpy() for c in ("i", "j", "t", "code"))
        bucket = [label.indices.to_numpy(zero_copy_only=False), table, code, i, j]
        order = np.lexsort(bucket)
        new = np.zeros(n, bool)
        new[0] = True
        for key in bucket:
            new[1:] |= key[order][1:] != key[order][:-1]
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        size = np.diff(np.append(first, n))
        i, j, table = i[order], j[order], table[order]
        node = group.column("node").to_numpy()[order]
        copies = group.column("copies").to_numpy()[order]
        block = group.column("block").to_numpy()[order]
        x = _matrix(group.column("embedding"), n)[order].astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        stored = np.flatnonzero(group.column("stored").to_numpy(zero_copy_only=False)[order] & (block == i))

        found_p, found_q = [], []
        for p, q in _pairs(stored, first[which[stored]], size[which[stored]]):
            fits = (node[p] < node[q]) & (block[q] == j[q])
            p, q = p[fits], q[fits]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            found_p.append(p[near])
            found_q.append(q[near])
        p, q = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_p, found_q))
        fresh = np.ones(len(p), bool)
        linked = np.unique(np.concatenate([p, q]))
        if len(linked):
            own, looks = codes(x[linked], *plan_tables(x.shape[1], cosine, rows))
            a, b = np.searchsorted(linked, p), np.searchsorted(linked, q)
            for t in range(own.shape[1]):
                fresh &= ~((own[a, t][:, None] == looks[b, t]).any(axis=1) & (t < table[p]))
        nodes, at = np.unique(node, return_inverse=True)
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        np.add.at(links, at[p[fresh]], copies[q[fresh]])
        np.add.at(links, at[q[fresh]], copies[p[fresh]])
        a, b = at[p], at[q]
        before = None
        while before is None or not np.array_equal(before, root):
            before = root.copy()
            low = np.minimum(root[a], root[b])
            for ends in (a, b, before[a], before[b]):
                np.minimum.at(root, ends, low)
            root = root[root]
        out = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))))
        return pa.table({"node": nodes[out], "other": nodes[root[out]], "links": links[out]})

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.98, vector: str = "embedding", label: str = "label", planned_for: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``; buckets are planned for ``planned_for`` vectors at least."""
    space = Workspace(vectors.sparkSession, "vectors")
    kept = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"  # as given: half the bytes
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(kept).alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0.0), F.lit(False))
    # two 64-bit hashes name a class: equal label and equal components; its vector is picked before the shuffle, so copies stay behind
    named = rows.withColumn("k1", F.when(usable, F.xxhash64("label", "embedding"))).withColumn("k2", F.when(usable, F.xxhash64(F.lit(1), "embedding", "label")))
    picked = F.min_by(F.struct("embedding", "label"), "vec_id").alias("v")
    chosen = named.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), picked)
    chosen = space.keep(chosen.select("k1", "k2", "node", "copies", "v.label", "v.embedding"), "chosen")
    classes = chosen.select("k1", "k2", "node", "copies")
    n, total = chosen.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()

    n = max(n, planned_for)

    fields = f"node long, label {rows.schema['label'].dataType.simpleString()}, dim int, each int, looks array<long>"
    hashed = space.keep(chosen.select("embedding", "node", "label").mapInArrow(_hash(cosine, n), fields), "hashed")
    looking = hashed.select("node", "label", "dim", "each", F.posexplode("looks").alias("place", "code"))
    member = looking.select("node", "label", "dim", F.expr("place div each").cast("int").alias("t"), "code", (F.col("place") % F.col("each") == 0).alias("stored"))
    bucket = ["label", "dim", "t", "code"]
    full = member.groupBy(bucket).agg(F.count("*").alias("n"), F.max("stored").alias("any")).filter("n > 1 AND any").select(*bucket, "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    full = space.keep(full, "buckets")
    looks, load = hashed.agg(F.coalesce(F.sum(F.size("looks")), F.lit(0))).first()[0], full.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]
    placed = join_unique(member, full, bucket, "n", looks, F.col("node")).filter("blocks IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # block i holds what is stored, block j what looks; a row is in all pairs that its block is in
    span = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_looking = F.transform(span, lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    as_stored = F.transform(span, lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    pairs = F.when(F.col("stored"), F.array_distinct(F.concat(as_looking, as_stored))).otherwise(as_looking)
    parts = placed.select("node", *bucket, "stored", "block", F.explode(pairs).alias("pair")).select("node", *bucket, "stored", "block", "pair.i", "pair.j")
    # a bin is many whole buckets, so that a call to Python is worth its while
    bins = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(load / BIN_ROWS))
    parts = parts.withColumn("bin", F.pmod(F.xxhash64(*bucket, "i", "j"), F.lit(bins)).cast("int"))
    fat = parts.join(chosen.select("node", "copies", "embedding"), "node")
    seen = space.keep(fat.groupBy("dim", "bin").applyInArrow(_verify(cosine, n), "node long, other long, links long"), "seen")

    found = connected_components(seen.select(F.col("node").alias("a"), F.col("other").alias("b")).filter("a != b"), space)
    links = seen.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "node", "left").join(found, "node", "left").select("k1", "k2", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component"))
    component = F.coalesce("component", "vec_id")
    return join_unique(named.select("vec_id", "k1", "k2"), by_class, ["k1", "k2"], "copies", total, F.col("vec_id")).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` at cosine 0.98 within a label."""
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""
