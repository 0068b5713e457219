"""Candidate pairs of a min-max signature: band buckets whose members are held against each other by sketch.

Members of one band bucket have little more in common than the bucket.  Were
they joined as they are, chains of weakly similar documents would grow with the
corpus until most of it is one group.  So each bucket compares its own members
first: a sketch keeps one byte of every signature value, and two members are
linked when at least ``least_equal`` bytes agree, a count that a pair at the
threshold misses with a probability of ``SKETCH_MISS`` at most.  What is left is
joined into components elsewhere, and confirmed there on full sets.

A bucket of more than ``BUCKET_MEMBERS`` is cut into blocks and each pair of
blocks is a group of its own: no pair is left out, and no group is unbounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_unique

BUCKET_MEMBERS = 8192
MISS = 1e-6
SKETCH_MISS = 1e-9
VALUES = 128

CELL = 1 << 15
CELLS_MOST = 1 << 14

_EDGES = "a long, b long"


def banding(similarity: float) -> tuple[int, int]:
    """(rows, bands): the most rows whose bands, within ``VALUES`` values, miss a pair at ``similarity`` with at most ``MISS``."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - similarity**rows))
        if rows * bands <= VALUES:
            return rows, bands
    return 1, VALUES


def least_equal(values: int, similarity: float) -> int:
    """The greatest count that a pair at ``similarity`` stays below, of ``values`` values, with at most ``SKETCH_MISS``."""
    below = 0.0
    for count in range(values + 1):
        below += math.comb(values, count) * similarity**count * (1 - similarity) ** (values - count)
        if below > SKETCH_MISS:
            return count
    return values


def reached(sketch: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Groups of rows that reach one another by pairs with ``least`` equal bytes or more."""
    left = np.arange(len(sketch))
    while len(left):
        group, queue, left = [left[:1]], [left[0]], left[1:]
        while queue and len(left):
            near = (sketch[left] == sketch[queue.pop()]).sum(axis=1) >= least
            if near.any():
                group.append(left[near])
                queue.extend(left[near])
                left = left[~near]
        yield np.concatenate(group)


def _links(table: pa.Table, least: int) -> pa.RecordBatch:
    """Stars of the groups inside each bucket of ``table``, which holds whole buckets, one after the other."""
    bucket, i, j, node = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "node"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    begins = np.ones(len(node), bool)
    begins[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(node)))
    first = np.repeat(starts, sizes)
    near = (sketch == sketch[first]).sum(axis=1) >= least
    at_once = np.logical_and.reduceat(near, starts)
    rest = np.repeat(at_once, sizes) & ~begins
    a, b = [node[rest]], [node[first[rest]]]
    for at, size in zip(starts[~at_once], sizes[~at_once], strict=True):
        for group in reached(sketch[at : at + size], least) if size > 2 else ():
            a.append(node[at + group[1:]])
            b.append(np.full(len(group) - 1, node[at + group[0]]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def _compare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            same = np.logical_and.reduce([x == x[-1] for x in (table.column(c).to_numpy() for c in ("bucket", "i", "j"))])
            begin = table.num_rows - (int(np.argmin(same[::-1])) if not same.all() else table.num_rows)
            if begin:
                yield _links(table.slice(0, begin), least)
            kept = table.slice(begin)
        if kept is not None:
            yield _links(kept, least)

    return run


def in_blocks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows``, once for each pair (i, j) of its group's ``n_blocks`` blocks that the row, dealt by ``key``, belongs to."""
    here = F.pmod(F.xxhash64(key), "n_blocks").cast("int")
    dealt = rows.withColumn("here", here)
    others = F.when(F.col("n_blocks") == 1, F.array("here")).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("n_blocks") - 1), F.col("here")))
    each = dealt.select(*columns, "here", F.explode(others).alias("there"))
    return each.select(*columns, F.least("here", "there").alias("i"), F.greatest("here", "there").alias("j"))


def candidate_links(classes: DataFrame, n_classes: int, values: int, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes of ``classes`` (set_key, node, bands, sketch; one row a set) that share a band and pass by sketch."""
    classes = classes.filter("node IS NOT NULL")
    member = classes.select("set_key", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    narrow = join_unique(member, shared, ["bucket"], "n", n_classes, F.col("set_key")).filter("n IS NOT NULL")
    narrow = narrow.withColumn("n_blocks", F.ceil(F.col("n") / BUCKET_MEMBERS).cast("int"))
    met = in_blocks(narrow, "set_key", ["bucket", "set_key"]).join(classes.select("set_key", "node", "sketch"), "set_key")
    met = met.select("bucket", "i", "j", "node", "sketch").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return met.mapInArrow(_compare(least_equal(values, similarity)), _EDGES).distinct()


def only_with(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is among ``ids`` (one column of that name), and a few others, before they are exchanged.

    A bit for each hash of an id, 16 bits an id and 64 MB in all at most; a
    broadcast table of cells of 4 KB.  The bound costs rows that pass for
    nothing, never one that is wanted: an exact join follows.
    """
    cells = min(CELLS_MOST, max(1, 1 << math.ceil(math.log2(ids.count() * 16 / CELL + 1))))
    place = F.pmod(F.xxhash64(key), F.lit(cells * CELL))
    cell, bit = F.floor(place / CELL).cast("int"), place % CELL
    marks = ids.select(cell.alias("_cell"), bit.alias("_bit")).repartition("_cell").groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    placed = rows.withColumn("_cell", cell).join(F.broadcast(marks), "_cell")
    return placed.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)
