"""Quality rules: lines that many documents of a host share, and what is left of a document without them.

A word is a longest run of other characters than space and \\t \\n \\v \\f \\r, a
line what lies between two \\n.  A line's normal form has its words joined by
one space, A-Z lower-cased and each digit 0-9 as 0; lines without a word are
none.

Method
------
One map over the texts counts what a document tells by itself and hashes its
normal lines (128 bits).  Its narrow rows are written once.  Lines are then
counted by host and hash, each document once, combined before the shuffle; a
line in more than ``most_documents`` documents of its host is above the limit.
Those lines meet the documents' lines by host and hash (frequent ones are dealt
by document), and a document that keeps less than ``least_kept`` percent of its
words without them is depleted.  Lines never leave their documents as text, no
table of lines is broadcast or collected, and a host or line of any size is
spread over all tasks.

Edge cases: a null text has no words and fails the base rules; a null host is a
host of its own; rows that share a doc_id, repeated ones too, are documents of
their own; a null doc_id stays null; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .substring_dedup import slices
from .words import U, Words, grams, inside, mix, text_bytes
from .workspace import Workspace

CHUNK_BYTES = 4 << 20
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_NORMAL = bytes(range(48)) + b"0" * 10 + bytes(range(58, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_LINE = pa.struct([("no", pa.int32()), ("line", pa.binary()), ("words", pa.int64()), ("first", pa.bool_())])
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = f"doc_id long, host string, {_COUNTS}, lines array<struct<no: int, line: binary, words: long, first: boolean>>"


def repeated_words(data: np.ndarray, offsets: np.ndarray, window: int = 3) -> np.ndarray:
    """For each document, its words that lie in a window found twice or more in it."""
    words = Words(data, offsets)
    n = len(words.hash)
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside(words.first, window, n)) if n >= window else np.zeros(0, np.int64)
    if len(at):
        doc = np.searchsorted(words.first, at, side="right").astype(U)
        with np.errstate(over="ignore"):
            key = mix(grams(words.hash, window)[at] + mix(doc))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + window, -1)
    upto = np.concatenate([[0], np.cumsum(np.cumsum(covered[:n]) > 0)])
    return upto[words.first[1:]] - upto[words.first[:-1]]


def normal_lines(text: str) -> tuple[list[dict], int]:
    """A text's lines that hold a word (number from 0, hash, words, first of its hash in the text), and how many equal an earlier one as they stand."""
    out, seen, hashes, repeats = [], set(), set(), 0
    for no, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.translate(_NORMAL).split()
        if not words:
            continue
        repeats += line in seen
        seen.add(line)
        name = xxhash.xxh3_128_digest(b" ".join(words))
        out.append({"no": no, "line": name, "words": len(words), "first": name not in hashes})
        hashes.add(name)
    return out, repeats


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for a, b in slices(batch, np.diff(offsets), CHUNK_BYTES):
            repeats = repeated_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows = []
            for text in batch.column(2).slice(a, b - a):
                text = text.as_py() or ""
                lines, same = normal_lines(text)
                chars = len(text) - sum(map(text.count, _SPACES))
                rows.append((sum(x["words"] for x in lines), chars, sum(map(text.count, SYMBOLS)), same, lines))
            words, chars, symbols, same, lines = zip(*rows, strict=True)
            numbers = [pa.array(x, pa.int64()) for x in (words, chars, symbols, same, repeats)]
            names = ["doc_id", "host", *(x.split()[0] for x in _COUNTS.split(", ")), "lines"]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *numbers, pa.array(lines, pa.list_(_LINE))], names=names)


def without_lines(text: str | Column, removed: str | Column) -> Column:
    """The text without the lines of these numbers."""
    text, removed = (F.col(c) if isinstance(c, str) else c for c in (text, removed))
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")


def quality_rules(docs: DataFrame, most_documents: int = 10, least_kept: int = 50, host: str = "source", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row for each document: its counts, ``base_failed``, ``removed_lines`` (numbers from 0), ``n_removed_words``, ``depleted`` and ``kept``.

    ``least_words`` and ``most_repeated`` (percent of words in repeated windows)
    are the base rules; what fails them still counts among its host's documents.
    """
    space = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").alias("text"))
    measured = space.keep(rows.mapInArrow(_measure, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "measured")

    home = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))  # a null host is one too
    lines = measured.select("row", home.alias("home"), F.explode("lines").alias("x")).select("row", "home", "x.*")
    counted = lines.groupBy("home", "line").agg(F.sum(F.col("first").cast("long")).alias("n_documents"), F.count("*").alias("n_rows"))
    above = space.keep(counted.filter(F.col("n_documents") > most_documents), "above")
    total = measured.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).cast("long")).first()[0]
    gone = join_unique(lines, above, ["home", "line"], "n_rows", total, F.col("row")).filter("n_documents IS NOT NULL")
    gone = gone.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("no")).alias("removed_lines"))

    short = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < least_kept * F.col("n_words")
    out = measured.drop("lines", "host").join(gone, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
    return out.drop("row").withColumn("base_failed", short).withColumn("depleted", depleted).withColumn("kept", ~short & ~depleted)


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for all ``documents``."""
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(x.split()[0] for x in _COUNTS.split(", ")), "base_failed", "n_removed_words", F.size("removed_lines").cast("long").alias("n_removed_lines"), "depleted", "kept")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d
), normal AS (
  SELECT doc_id, source, no, line, len(words) AS words, array_to_string(words, ' ') AS form
  FROM (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^\x20\x09-\x0D]+') AS words FROM lines)
  WHERE len(words) > 0
), above AS (
  SELECT source, form FROM normal GROUP BY source, form HAVING count(DISTINCT doc_id) > 10
), removed AS (
  SELECT doc_id, sum(words) AS n_removed_words, count(*) AS n_removed_lines
  FROM normal n JOIN above a ON n.form = a.form AND n.source IS NOT DISTINCT FROM a.source GROUP BY doc_id
), repeats AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM normal GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d)
), windows AS (
  SELECT doc_id, place, word, lead(word) OVER p AS second, lead(word, 2) OVER p AS third FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY place)
), twice AS (
  SELECT doc_id, place FROM windows WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, second, third) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id
), every AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines
  FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * (n_words - n_removed_words) < 50 * n_words AS depleted,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * (n_words - n_removed_words) < 50 * n_words AS kept
FROM every
"""
