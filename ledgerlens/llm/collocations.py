"""Phrase collocations by level-wise passes: frequent k-grams from frequent (k-1)-grams, then scored cuts.

A text (A-Z lower-cased) is split into pieces at . , ; : ! ? and at \\n \\v \\f
\\r, a piece into words at space and tab.  Everything is per language; a null
one is ``und``.  f(phrase) counts all contiguous occurrences within pieces, n all
words.

Method
------
1. Level 1 counts every word; level k counts those k-grams alone whose two
   overlapping (k-1)-grams are frequent (f >= ``least``).  Counts are combined
   in the task, a chunk of text at a time, and again before the shuffle, so that
   a phrase is a row a task however common it is.
2. A level's frequent phrases travel to the next pass as a bit table of their
   hashes: ``BITS_EACH`` bits a phrase, ``BITS_MOST`` (64 MB) at most, built in
   slices by tasks.  A phrase that is not frequent may slip through and is
   counted, then falls below ``least`` like any other; one that is frequent
   always passes.  So the table's bound costs time at most, never a phrase.
3. Counts are keyed by the phrase itself.  Every part of a frequent phrase is
   frequent, so the cuts' parts are looked up in the level tables by joins whose
   hot keys (a word that begins many phrases) are dealt by the phrase.

A candidate inside a longer one that is as frequent is also inside one that is
one word longer and as frequent, so each level is compared with the next alone.

Edge cases: null and empty texts have no words; phrases keep any other
characters as they are; texts of any length are cut into words as a whole;
repeated rows are counted each; ties in score and count go to the phrase of
least bytes; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_unique
from .substring_dedup import slices
from .words import LOWER, SPACE, U, Words, grams, mix, text_bytes
from .workspace import Workspace

LEAST, LONGEST, TOP = 100, 5, 2000
CHUNK_BYTES = 4 << 20
BITS_EACH = 16
BITS_MOST = 1 << 29
SLICE_BITS = 1 << 19

BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True

_COUNTS = "lang string, phrase string, f long"


@lru_cache(maxsize=4096)
def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each language."""
    coded = langs.dictionary_encode()
    each = np.array([_lang_hash(x) for x in coded.dictionary.to_pylist()], U)
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.zeros(0, U)


def keys(gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A hash of a phrase in a language."""
    with np.errstate(over="ignore"):
        return mix(gram + mix(lang))


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that stand for a key, both in one slice of the table."""
    inner = min(bits, SLICE_BITS)
    slice_at = (key >> U(32)) % U(bits // inner) * U(inner)
    return slice_at + key % U(inner), slice_at + (key * U(0x9E3779B97F4A7C15) >> U(40)) % U(inner)


def holds(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key may be in the table."""
    with np.errstate(over="ignore"):
        a, b = places(key, len(table) * 8)
    return (table[(a >> U(3)).astype(np.int64)] >> (a & U(7)).astype(np.uint8) & table[(b >> U(3)).astype(np.int64)] >> (b & U(7)).astype(np.uint8) & 1).astype(bool)


def bits_for(phrases: int) -> int:
    """The size of the table for so many phrases: a power of two, ``BITS_MOST`` at most."""
    return min(BITS_MOST, 1 << max(10, (phrases * BITS_EACH - 1).bit_length()))


def _keyed(size: int, bits: int):
    """The bits of phrases of ``size`` words, by slice of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*text_bytes(batch.column(1)))
            key = keys(grams(words.hash, size)[::size], lang_hashes(batch.column(0)))
            with np.errstate(over="ignore"):
                place = np.concatenate(places(key, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place // SLICE_BITS), pa.array(place % SLICE_BITS)], names=["slice", "place"])

    return run


def _slice_bits(bits: int):
    def run(group: pa.Table) -> pa.Table:
        on = np.zeros(min(bits, SLICE_BITS), bool)
        on[group.column("place").to_numpy()] = True
        return pa.table({"slice": group.column("slice").slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    return run


def bit_table(level: DataFrame, size: int, phrases: int) -> np.ndarray:
    """The bits of a level's phrases: at most ``BITS_MOST`` reach the driver, in slices that tasks fill."""
    bits = bits_for(phrases)
    placed = level.select("lang", "phrase").mapInArrow(_keyed(size, bits), "slice long, place long").distinct()
    table = np.zeros(bits // 8, np.uint8)
    for row in placed.groupBy("slice").applyInArrow(_slice_bits(bits), "slice long, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        table[row["slice"] * SLICE_BITS // 8 :][: len(part)] = part
    return table


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The ``size`` words from each place ``at``, joined by one space."""
    where = np.int32 if len(data) < 1 << 28 else np.int64  # half the memory for all but huge texts
    each = (at[:, None] + np.arange(size)).ravel()
    begin, sizes = start[each], end[each] - start[each]
    word_at = np.cumsum(sizes + 1) - sizes - 1  # each word and one space after it
    total = int((sizes + 1).sum())
    within = np.arange(int(sizes.sum()), dtype=where)
    within -= np.repeat((np.cumsum(sizes) - sizes).astype(where), sizes)
    out = np.full(total, 32, np.uint8)
    out[np.repeat(word_at.astype(where), sizes) + within] = data[np.repeat(begin.astype(where), sizes) + within]
    ends = (word_at + sizes + 1)[size - 1 :: size]
    keep = np.ones(total, bool)
    keep[ends - 1] = False  # the space after the last word
    offsets = np.concatenate([[0], ends - np.arange(1, len(at) + 1)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out[keep]))


def count_chunk(data: np.ndarray, offsets: np.ndarray, langs: pa.Array, size: int, known: np.ndarray | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(lang, phrase, count) of a chunk's phrases of ``size`` words whose two shorter ones are known."""
    data = LOWER[data]
    words = Words(data, offsets, space=SPACE | BREAK)
    n = len(words.hash) - size + 1
    if n <= 0:
        return pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())
    doc = np.searchsorted(words.first, np.arange(len(words.hash)), side="right") - 1
    lang = lang_hashes(langs)
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), words.start)
    fits = (doc[:n] == doc[size - 1 :]) & (piece[:n] == piece[size - 1 :])
    if known is not None:
        shorter = holds(known, keys(grams(words.hash, size - 1), lang[doc[: n + 1]]))
        fits &= shorter[:-1] & shorter[1:]
    at = np.flatnonzero(fits)
    _, first, count = np.unique(keys(grams(words.hash, size)[at], lang[doc[at]]), return_index=True, return_counts=True)
    order = np.argsort(words.hash[at[first]], kind="stable")  # those that begin alike lie together, which compresses better
    at, count = at[first][order], count[order]
    return langs.take(pa.array(doc[at])), spelled(data, words.start, words.end, at, size).cast(pa.string()), pa.array(count.astype(np.int64))


def _count(size: int, known: Broadcast | None) -> Callable:
    """The counts of each chunk of about ``CHUNK_BYTES`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(batch, np.diff(offsets), CHUNK_BYTES):
                langs = batch.column(0).slice(a, b - a)
                found = count_chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs, size, known.value if known else None)
                yield pa.RecordBatch.from_arrays(list(found), names=["lang", "phrase", "f"])

    return run


def levels(docs: DataFrame, space: Workspace, least: int, longest: int, text: str, lang: str) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases (lang, phrase, f) of each length, from 1 on; and (lang, n)."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")
    words = rows.mapInArrow(_count(1, None), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = space.keep(words, "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = [space.keep(words.filter(F.col("f") >= least), "level-1")]
    for size in range(2, longest + 1):
        phrases = out[-1].count()
        if not phrases:
            break
        known = context.broadcast(bit_table(out[-1], size - 1, phrases))
        counted = rows.mapInArrow(_count(size, known), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        out.append(space.keep(counted.filter(F.col("f") >= least), f"level-{size}"))
        known.destroy()
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by their lowest-scoring cut."""
    space = Workspace(docs.sparkSession, "collocations")
    found, totals = levels(docs, space, least, longest, text, lang)
    spark = docs.sparkSession
    none = spark.createDataFrame([], "lang string, phrase string, a long, words array<string>")

    def split(level: DataFrame) -> DataFrame:
        return level.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def joined(words, start, size):
        return F.array_join(F.slice(words, start, size), " ")

    kept = none
    for size, level in enumerate(found[1:], 2):
        rows = split(level)
        if size < len(found):
            inner = split(found[size]).select("lang", "a", F.explode(F.array(joined("words", 1, size), joined("words", 2, size))).alias("phrase"))
            inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
            rows = rows.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
        kept = kept.unionByName(rows)
    kept = space.keep(kept, "kept")

    cut = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    rest = joined("words", F.col("k") + 1, F.size("words") - F.col("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), joined("words", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), rest.alias("part")))
    parts = cut.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    known = reduce(DataFrame.unionByName, found).select("lang", F.col("phrase").alias("part"), "f").join(uses, ["lang", "part"])
    total = parts.count()
    sized = join_unique(parts, known, ["lang", "part"], "uses", total, F.col("phrase"))
    both = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    wide = sized.groupBy("lang", "phrase", "a").agg(*both)

    by_lang = totals.join(kept.groupBy("lang").agg(F.count("*").alias("phrases")), "lang")
    wide = join_unique(wide, by_lang, ["lang"], "phrases", kept.count(), F.col("phrase"))
    exact = F.lit(1000).cast("decimal(38,0)") * F.col("a").cast("decimal(38,0)") * F.col("n").cast("decimal(38,0)")
    wide = wide.withColumn("top", exact)
    each = []
    for k in range(1, longest):
        score = F.expr(f"top div (CAST(l{k} AS DECIMAL(38,0)) * CAST(r{k} AS DECIMAL(38,0)))")
        each.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    best = wide.select("lang", "phrase", "a", "n", F.array_min(F.array_compact(F.array(*each))).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), found AS (
  SELECT lang, size, w[place + 1 : place + size] AS p
  FROM (SELECT lang, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS place FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size))
), f AS (
  SELECT lang, size, p, array_to_string(p, ' ') AS phrase, count(*) AS f FROM found GROUP BY lang, size, p HAVING count(*) >= 100
), inner_parts AS (
  SELECT lang, p[s : s + size - 1] AS p, max(f) AS longer
  FROM (SELECT f.lang, f.p, f.f, part.size, unnest(range(1, len(f.p) - part.size + 2)) AS s FROM f, (SELECT unnest([2, 3, 4]) AS size) part WHERE len(f.p) > part.size)
  GROUP BY ALL
), kept AS (
  SELECT f.lang, f.p, f.phrase, f.f AS a FROM f LEFT JOIN inner_parts i ON f.lang = i.lang AND f.p = i.p
  WHERE len(f.p) > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * f.f)
), cuts AS (
  SELECT lang, p, phrase, a, k, p[1 : k] AS first, p[k + 1 : len(p)] AS rest FROM (SELECT *, unnest(range(1, len(p))) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.first JOIN f y ON y.lang = c.lang AND y.p = c.rest JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
