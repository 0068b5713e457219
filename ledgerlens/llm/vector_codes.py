"""Compression of vectors to one byte a part, with a codebook search by a VA-file's bounds.

Each component x becomes floor(``scale`` * x) (x as double); a vector is cut
into ``parts`` equal consecutive parts.  Each part position has a codebook of
``entries`` integer entries, which starts as that part of the vectors of the
smallest vec_ids.  A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by the
floor of its parts' mean; an entry without parts stays.  After ``rounds`` of
them parts are assigned once more.

Method
------
An entry's coordinates are quantised to ``bits`` bits: cells of equal width
between the least and the greatest coordinate of a codebook.  For a part, one
table a coordinate gives the least and the greatest squared distance to every
cell, so that an entry's bounds are sums of looked-up numbers.  Entries whose
lower bound is above the least upper bound can't be nearest; the integer
distances of the others decide.

A round is one map over the table, which adds up its partition's parts by entry
(``parts * entries`` rows of narrow sums a task), and one sum over those; the
codebooks, whose size the parameters and the vectors' length fix, are all that
reaches the driver or travels with tasks.  No vector is shuffled.

Edge cases: vectors that are null or hold null or non-finite components are
dropped; vectors of each length have codebooks (and a digest) of their own; of
a length that ``parts`` doesn't divide, the first parts are one longer; an empty
vector has empty parts, all equal; repeated rows are coded each, and equal
vec_ids are ordered by their vectors; a null vec_id comes after all others;
fewer vectors than ``entries`` give fewer entries; null labels are one label;
numbers of any size are exact, and errors beyond 64 bits are held at the limit
of long; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .workspace import Workspace

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 256, 16, 64, 2, 4
ROWS_AT_ONCE = 2048
_LONG = (1 << 63) - 1
_NARROW = 1 << 24
_LIMB = 10**18


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), a vector a row: int64 where squared distances surely fit it, Python integers otherwise."""
    if np.abs(x).max(initial=0) * scale < _NARROW and x.shape[1] < 8192:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in row] for row in x.tolist()], object).reshape(x.shape)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each length in a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    for length in np.unique(sizes).tolist():
        where = np.flatnonzero(sizes == length)
        yield where, values[start[where, None] + np.arange(length)]


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends; the first ones are one longer if it must be."""
    size, more = divmod(length, parts)
    ends = [i * size + min(i, more) for i in range(parts + 1)]
    return list(zip(ends, ends[1:], strict=False))


class Cells:
    """A codebook (entries x coordinates, whole numbers) with its coordinates' cells."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book = book
        low, high = (book.min(axis=0), book.max(axis=0)) if len(book) else (book[:0], book[:0])
        self.width = (high - low) // (1 << bits) + 1
        self.cell = ((book - low) // self.width).astype(np.int64)
        steps = np.arange(1 << bits).reshape(-1, 1).astype(book.dtype)
        self.low = low + steps * self.width  # cells x coordinates
        self.high = self.low + self.width - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries x rows of ``x``) lower and upper bounds of the squared distance, from one table a coordinate."""
        lower = np.zeros((len(self.book), len(x)), x.dtype)
        upper = lower.copy()
        for j in range(x.shape[1]):
            below, above = self.low[:, j, None] - x[None, :, j], x[None, :, j] - self.high[:, j, None]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[self.cell[:, j]]
            upper += (far * far)[self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero((lower <= upper.min(axis=0)).T)  # by row, then by entry
        gap = x[row] - self.book[entry]
        distance = (gap * gap).sum(axis=1) if gap.shape[1] else np.zeros(len(row), np.int64)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(distance, first)
        wins = np.flatnonzero(distance == least[row])
        wins = wins[np.searchsorted(row[wins], np.arange(len(x)))]
        return entry[wins], least


Books = dict[int, list[np.ndarray]]


def _matched(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python integers if either is."""
    return (x.astype(object), book.astype(object)) if object in (x.dtype, book.dtype) else (x, book)


def _assign(column: pa.Array, books: Books, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """By length: (places, whole vectors, codes by part, squared distances by part)."""
    for where, x in by_length(column):
        x = floors(x, scale)
        codes, far = [], []
        for (a, b), book in zip(cuts(x.shape[1], len(books[x.shape[1]])), books[x.shape[1]], strict=True):
            part, book = _matched(x[:, a:b], book)
            code, distance = Cells(book).nearest(part)
            codes.append(code)
            far.append(distance)
        yield where, x, codes, far


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as (place, digits) whose sum of digits * 10**(18 * place) it is."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value or not place:
        value, digits = divmod(value, _LIMB)
        yield place, sign * digits
        place += 1


def _sums(books: Books, scale: int):
    """Rows (length, part, entry, position, limb, total, n) of a partition's parts by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(n, i): np.zeros(book.shape, object) for n, of in books.items() for i, book in enumerate(of)}
        counts = {key: np.zeros(len(total), np.int64) for key, total in sums.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                for _, x, codes, _ in _assign(batch.column(0).slice(start, ROWS_AT_ONCE), books, scale):
                    for i, ((a, b), code) in enumerate(zip(cuts(x.shape[1], len(codes)), codes, strict=True)):
                        key = (x.shape[1], i)
                        here = np.zeros(sums[key].shape, x.dtype)
                        np.add.at(here, code, x[:, a:b])
                        sums[key] += here.astype(object)
                        counts[key] += np.bincount(code, minlength=len(here))
        for (length, part), total in sums.items():
            n = counts[length, part].tolist()
            rows = [(length, part, e, at, place, digits, n[e]) for e, entry in enumerate(total.tolist()) if n[e] for at, v in enumerate(entry) for place, digits in limbs(v)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 5 + [pa.int64()] * 2, strict=True)], names=["length", "part", "entry", "position", "limb", "total", "n"])

    return run


def _code(books: Books, digests: dict[int, str], scale: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                for where, x, codes, far in _assign(part.column(0), books, scale):
                    error = np.minimum(sum(far), _LONG).astype(np.int64)
                    code = np.stack(codes, axis=1).astype(np.uint8 if max(map(len, books[x.shape[1]])) <= 256 else ">u2")
                    rest = [c.take(pa.array(where)) for c in part.columns[1:]]
                    made = [pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(error), pa.array([digests[x.shape[1]]] * len(where), pa.string())]
                    yield pa.RecordBatch.from_arrays([*rest, *made], names=names)

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()


def train(rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebooks of ``rows`` (vec_id, embedding; finite components only), by length of the vectors."""
    books: Books = {}
    for (length,) in rows.select(F.size("embedding")).distinct().collect():
        seeds = rows.filter(F.size("embedding") == length).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
        first = [r["embedding"] for r in seeds.select("embedding").collect()]  # ``entries`` at most
        x = floors(np.array(first, np.float64).reshape(len(first), length), scale)
        books[length] = [x[:, a:b] for a, b in cuts(length, parts)]
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_sums(books, scale), "length int, part int, entry int, position int, limb int, total long, n long")
        total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        found: dict[tuple[int, int, int, int], list[int]] = {}
        for row in sums.groupBy("length", "part", "entry", "position", "limb").agg(total, F.sum("n").alias("n")).collect():  # a row or so for each component of the codebooks
            value = found.setdefault((row["length"], row["part"], row["entry"], row["position"]), [0, 0])
            value[0] += int(row["total"]) * _LIMB ** row["limb"]
            value[1] = max(value[1], row["n"])
        moved = {n: [book.astype(object) for book in of] for n, of in books.items()}
        for (length, part, entry, position), (total, n) in found.items():
            moved[length][part][entry, position] = total // n
        books = {n: [_narrow(book) for book in of] for n, of in moved.items()}
    return books


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) <= _NARROW for v in book.ravel().tolist()) else book


def vector_codes(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector of finite components.

    ``code`` has two hex digits for each part, four with more than 256 entries.
    """
    space = Workspace(vectors.sparkSession, "codes")
    rows = vectors.select(F.col(vector).cast("array<double>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"))
    rows = rows.filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    books = train(rows.select("vec_id", "embedding"), scale, parts, entries, rounds)
    names = ["vec_id", "label", "code", "error", "codebooks_sha256"]
    kind = vectors.schema[label].dataType.simpleString()
    coding = _code(books, {n: digest(of) for n, of in books.items()}, scale, names)
    coded = space.keep(rows.select("embedding", "vec_id", "label").mapInArrow(coding, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"), "coded")

    named = coded.withColumn("group", F.struct("label"))  # null labels are equal inside a struct
    sums = named.groupBy("group").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    sums = sums.select("group", "n", F.least("sum", F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return join_unique(named, sums, ["group"], "n", coded.count(), F.col("vec_id")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``: 16 parts, 64 entries, 2 rounds."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds written out, one after the other."""
    nearest = """near{i} AS (
  SELECT vec_id, label, part, v, min({{'d': d, 'entry': entry}}) AS best FROM (
    SELECT p.vec_id, p.label, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts p JOIN book{i} b ON b.part = p.part) GROUP BY vec_id, label, part, v
)"""
    moved = """sum{i} AS (
  SELECT part, entry, list(m ORDER BY j) AS e FROM (
    SELECT part, best.entry AS entry, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS j FROM near{i}) GROUP BY part, best.entry, j) GROUP BY part, entry
), book{n} AS (
  SELECT b.part, b.entry, coalesce(s.e, CAST(b.e AS HUGEINT[])) AS e FROM book{i} b LEFT JOIN sum{i} s ON s.part = b.part AND s.entry = b.entry
)"""
    steps = ",\n".join(x for i in range(rounds) for x in (nearest.format(i=i), moved.format(i=i, n=i + 1)))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS HUGEINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS part)
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}
), book0 AS (
  SELECT part, entry, v AS e FROM parts JOIN seeds USING (vec_id)
), {steps}, {nearest.format(i=rounds)}, digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(e) AS x, unnest(range(len(e))) AS j FROM book{rounds})
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


OP12_SQL = _sql()
