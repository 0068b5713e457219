"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

A document's set holds its distinct runs of ``shingle`` words (A-Z lower-cased);
a shorter document has its whole word sequence as the one member.  Two
documents are linked when their sets' Jaccard similarity reaches the threshold;
a document belongs to the component of all it can reach by links.

Method
------
Every hash permutation gives two signature values, the set's least and greatest
value, so that n permutations cost n hash evaluations and give 2n values, each
equal for two sets with the probability of their similarity.  ``banding``
chooses rows and bands so that a pair at the threshold itself shares no band
with a probability of one in a million at most.

1. Equal sets collapse into one class before anything is compared.
2. Inside each band bucket the members are held against each other by sketch
   (``band_pairs``): only pairs whose whole signatures agree about as often as
   the threshold asks become edges, so weakly similar documents that share a
   bucket by chance don't grow into one group with the corpus.
3. Components of those edges are the candidate groups, and only their texts are
   exchanged.  A group's full sets meet once, in one task, which finds *every*
   link that connects it: a breadth-first search over an inverted index of the
   documents not yet reached.  A group above ``GROUP_SHINGLES`` is cut into
   blocks and each pair of blocks is a task, so no task holds an unbounded
   group and no pair is left out; the blocks' stars are joined by a second
   components pass.

Edge cases: null, empty or blank texts have no set, link with nothing and are
kept; a null doc_id can't be reached by links: its row has a null component and
a null ``kept``; rows that share a doc_id are one document; repeated rows are exact
copies; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .band_pairs import banding, candidate_links, in_blocks, only_with
from .components import connected_components
from .skew import join_unique
from .substring_dedup import slices
from .words import U, Words, mix, text_bytes
from .workspace import Workspace

CHUNK_BYTES = 4 << 20
GROUP_SHINGLES = 2_000_000

_SIGNATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"
_EDGES = "a long, b long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = Words(data, offsets, lower=True)
    salts = np.random.default_rng(shingle).integers(1, 1 << 63, shingle, dtype=np.uint64)
    n = len(words.hash)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, n - shingle + 1), U)
        for i in range(shingle if len(runs) else 0):
            runs += mix(words.hash[i : n - shingle + 1 + i], int(salts[i]))
        runs = mix(runs)
        out = []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= shingle:
                out.append(np.unique(runs[a : b - shingle + 1]))
            elif b > a:
                short = U(b - a)
                for i in range(a, b):
                    short = mix(np.array([short * U(0xD1342543DE82EF95) + words.hash[i]], U))[0]
                out.append(np.array([short], U))
            else:
                out.append(np.zeros(0, U))
    return out


def _sign(shingle: int, rows: int, bands: int):
    perms = -(-rows * bands // 2)
    factors = np.random.default_rng(20).integers(0, 1 << 63, perms, dtype=np.uint64) * U(2) + U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(batch, np.diff(offsets), CHUNK_BYTES):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, U)
                at = np.cumsum(sizes[full]) - sizes[full]
                keys: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                sketch = np.zeros((len(full), 2 * perms), np.uint8)
                code = np.zeros((len(full), bands), U)
                if len(full):
                    with np.errstate(over="ignore"):
                        low, high = np.add.reduceat(mix(flat, 1), at), np.add.reduceat(mix(flat, 2), at)
                        for i, x, y in zip(full, low, high, strict=True):
                            keys[i] = x.tobytes() + y.tobytes()
                        for p in range(perms):
                            values = flat * factors[p]
                            for q, value in ((2 * p, np.minimum.reduceat(values, at)), (2 * p + 1, np.maximum.reduceat(values, at))):
                                sketch[:, q] = mix(value, q) & U(255)
                                if (band := q // rows) < bands:
                                    code[:, band] = mix(code[:, band] + value, band + 1)
                for i, x in zip(full, sketch, strict=True):
                    sketches[i] = x.tobytes()
                band_at = np.zeros(len(sets) + 1, np.int32)
                band_at[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
                codes = pa.ListArray.from_arrays(pa.array(band_at), pa.array(code.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(keys, pa.binary()), codes, pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
                )

    return run


def linked(sets: list[np.ndarray], numerator: int, denominator: int) -> Iterator[list[int]]:
    """Components of the sets whose intersection over union is numerator/denominator or more.

    A search from each set over an index of those not yet reached.  The index is
    built again whenever half of what it holds has been reached, so the many
    members of a dense group are soon compared with the few stragglers only.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    left = np.ones(len(sets), bool)

    def index():
        ids = np.flatnonzero(left)
        flat = np.concatenate([sets[i] for i in ids]) if len(ids) else np.zeros(0, U)
        owner = np.repeat(np.arange(len(ids)), sizes[ids])
        rank = np.argsort(flat, kind="stable")
        return ids, flat[rank], owner[rank]

    ids, flat, owner = index()
    live = len(ids)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], live = False, live - 1
        group, queue = [seed], deque([seed])
        while queue and live:
            if live * 2 < len(ids):
                ids, flat, owner = index()
            x = queue.popleft()
            a, b = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            count = b - a
            total = int(count.sum())
            if not total:
                continue
            spots = np.repeat(a - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
            both = np.bincount(owner[spots], minlength=len(ids))
            near = ids[denominator * both >= numerator * (sizes[x] + sizes[ids] - both)]
            near = near[left[near]]
            left[near] = False
            live -= len(near)
            group.extend(near.tolist())
            queue.extend(near.tolist())
        yield group


def _confirm(shingle: int, numerator: int, denominator: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        sets = shingle_sets(*text_bytes(group.column("text").combine_chunks()), shingle)
        full = [i for i, x in enumerate(sets) if len(x)]
        a, b = [], []
        for members in linked([sets[i] for i in full], numerator, denominator):
            found = sorted({int(ids[full[i]]) for i in members})
            a += found[1:]
            b += [found[0]] * (len(found) - 1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    space = Workspace(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, bands = banding(percent / 100)
    signed = space.keep(docs.mapInArrow(_sign(shingle, rows, bands), _SIGNATURES), "signed")

    once = [F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sketch")]  # equal for equal sets
    classes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows"), *once)
    classes = space.keep(classes, "classes")
    total, n_classes = classes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count("*")).first()
    pairs = candidate_links(classes, n_classes, 2 * -(-rows * bands // 2), percent / 100)
    groups = connected_components(pairs, space, "candidates")

    sized = groups.join(classes.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles")), "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n_shingles") / GROUP_SHINGLES).cast("int").alias("n_blocks"))
    parts = in_blocks(groups.join(blocks, "root"), "node", ["node", "root"])
    wanted = only_with(docs, groups.select(F.col("node").alias("doc_id")), "doc_id")
    texts = parts.join(wanted, parts.node == wanted.doc_id).select("root", "i", "j", "node", "text")
    links = texts.groupBy("root", "i", "j").applyInArrow(_confirm(shingle, percent, 100), _EDGES)
    found = connected_components(links, space, "links")

    by_class = classes.select("set_key", "node", "n_rows").join(found, "node", "left")
    named = join_unique(signed.select("doc_id", "n_shingles", "set_key"), by_class, ["set_key"], "n_rows", total, F.col("doc_id"))
    component = F.coalesce("root", "node", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: three words, 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, y AS other FROM edges
  UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.other = edges.x
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""
