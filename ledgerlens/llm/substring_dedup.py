"""Substring dedup by level-wise doubling of repeated windows.

A window is ``window`` consecutive words of one document.  Every word under a
window whose word sequence also starts anywhere else (another document, or
another place of the same one) is removed; all windows are judged on the input.

Method
------
Levels double: for 35 words they are 9, 18 and 35.  A window stays a candidate
at the next level only if its run of words at this one repeats, so long windows
are formed only where short ones repeated, and the loop ends early when no
candidate survives.  Below the last level a window is tested by one run of the
level's length, the one of least hash inside it: equal windows choose the same
run, so no repeat is lost, and a 35-word window sends about one 9-word hash in
14 positions instead of 35.  The last level sends a 96-bit hash of the window.

Data flow
---------
Documents are packed once into chunks of about ``CHUNK_BYTES`` with an id, and
written.  Per level each chunk asks hash buckets for its *distinct* hashes (a
passage that a third of all rows share arrives once per chunk, not once per
row), and each bucket answers a bitmap.  Texts never move by content; only the
compressed chunks meet their bitmaps, by chunk id, which has no hot value.
Answers are small: they are written by a task for each core, or for every
``BUCKET_KEYS`` keys if those are more, not by one for each shuffle partition
(Hadoop's local file system starts three commands for every file).

Edge cases: a null or blank text has no words (0, 0, empty kept text); texts
shorter than the window keep every word; repeated rows and equal texts remove
each other wholly; an empty table gives an empty table; other columns pass
through, except that ``kept_text``, ``n_words`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, Words, grams, inside, sliding_min, text_bytes
from .workspace import Workspace

CHUNK_BYTES = 2 << 20
BUCKET_KEYS = 1_500_000
OUTPUT = ("kept_text", "n_words", "n_removed")

_CHUNKS = "chunk_id long, n_words long, payload binary"
_ASKS = "bucket int, chunk_id long, keys binary, more binary, twice binary"
_ANSWERS = "chunk_id long, bucket int, n_keys long, n_hits long, hits binary"


def levels(window: int, least: int = 9) -> list[int]:
    """Window lengths from short to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] > least:
        out.insert(0, -(-out[0] // 2))
    return out


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose sizes add up to about ``most``, at least one row each."""
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right"))
        stop = max(stop, at + 1)
        yield at, stop
        at = stop


def _pack(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(batch, np.diff(offsets), CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=how) as out:
                    out.write_batch(batch.slice(a, b - a))
                n = len(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).start)
                yield pa.RecordBatch.from_pydict({"chunk_id": pa.array([serial], pa.int64()), "n_words": pa.array([n], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                serial += 1

    return run


class _Chunk:
    """One chunk's words and, level by level, the windows that are still candidates."""

    def __init__(self, payload: bytes, text: str, window: int):
        self.rows = pa.ipc.open_stream(payload).read_all().combine_chunks()
        column = self.rows.column(text)
        self.text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.words = Words(*text_bytes(self.text))
        self.window = window
        n = len(self.words.hash)
        self.at = np.flatnonzero(inside(self.words.first, window, n)[: max(0, n - window + 1)])

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, their further bits, whether each occurs twice here, key of each candidate window)."""
        empty = np.zeros(0, U)
        if not len(self.at):
            return empty, np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(0, np.int64)
        run = grams(self.words.hash, length)
        if length < self.window:
            order = (run & U(0xFFFFFFFF00000000)) | np.arange(len(run), dtype=U)
            place = (sliding_min(order, self.window - length + 1)[self.at] & U(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            key, which, times = np.unique(run[place[new]], return_inverse=True, return_counts=True)
            return key, np.zeros(len(key), np.uint32), times > 1, which[np.cumsum(new) - 1]
        low = run[self.at]
        high = (grams(self.words.hash, length, 0x5DEECE66D)[self.at] >> U(32)).astype(np.uint32)
        rank = np.lexsort((high, low))
        a, b = low[rank], high[rank]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(a), np.int64)
        which[rank] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return a[first], b[first], np.diff(np.append(first, len(a))) > 1, which

    def narrow(self, length: int, buckets: int, answers: dict[int, bytes]) -> None:
        """Keep the candidates whose keys the buckets found repeated."""
        key, _, _, which = self.keys(length)
        repeated = np.zeros(len(key), bool)
        for bucket, at in _by_bucket(key, buckets):
            if bucket in answers:
                repeated[at] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=len(at)).astype(bool)
        self.at = self.at[repeated[which]]

    def covered(self) -> np.ndarray:
        n = len(self.words.hash)
        edge = np.zeros(n + 1, np.int64)
        edge[self.at] += 1
        np.add.at(edge, self.at + self.window, -1)
        return np.cumsum(edge[:n]) > 0


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has keys, with their places in key order."""
    to = (key >> U(20)) % U(buckets)
    rank = np.argsort(to, kind="stable")
    bounds = np.flatnonzero(np.diff(to[rank])) + 1
    for part in np.split(rank, bounds) if len(rank) else []:
        yield int(to[part[0]]), part


def _replay(chunk: _Chunk, done: list[tuple[int, int]], answers: list[dict] | None) -> None:
    known: dict[int, dict[int, bytes]] = {}
    for x in answers or []:
        known.setdefault(x["level"], {})[x["bucket"]] = x["hits"]
    for level, (length, buckets) in enumerate(done):
        chunk.narrow(length, buckets, known.get(level, {}))


def _ask(text: str, window: int, done: list[tuple[int, int]], length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers") if "answers" in batch.schema.names else None
            for i in range(batch.num_rows):
                chunk = _Chunk(batch.column("payload")[i].as_py(), text, window)
                _replay(chunk, done, answers[i].as_py() if answers is not None else None)
                key, more, twice, _ = chunk.keys(length)
                rows: list[tuple] = []
                for bucket, at in _by_bucket(key, buckets):
                    rows.append((bucket, key[at].tobytes(), more[at].tobytes() if length == window else b"", np.packbits(twice[at]).tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([batch.column("chunk_id")[i].as_py()] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "chunk_id", "keys", "more", "twice"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Which keys of a bucket occur at two places at least, as a bitmap for each asking chunk."""
    keys = [np.frombuffer(x, U) for x in group.column("keys").to_pylist()]
    sizes = np.array([len(x) for x in keys], np.int64)
    key = np.concatenate(keys)
    more = np.concatenate([np.frombuffer(x, np.uint32) if x else np.zeros(n, np.uint32) for x, n in zip(group.column("more").to_pylist(), sizes, strict=True)])
    times = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group.column("twice").to_pylist(), sizes, strict=True)]).astype(np.int64) + 1
    rank = np.lexsort((more, key))
    a, b = key[rank], more[rank]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    hit = np.empty(len(a), bool)
    hit[rank] = (np.add.reduceat(times[rank], first) > 1)[np.cumsum(new) - 1]
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    return pa.table({"chunk_id": group.column("chunk_id").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "n_keys": pa.array(sizes), "n_hits": pa.array([int(x.sum()) for x in parts], pa.int64()), "hits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})


def _finish(text: str, window: int, done: list[tuple[int, int]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers") if "answers" in batch.schema.names else None
            for i in range(batch.num_rows):
                chunk = _Chunk(batch.column("payload")[i].as_py(), text, window)
                if answers is None:
                    chunk.at = chunk.at[:0]
                else:
                    _replay(chunk, done, answers[i].as_py())
                gone, first = chunk.covered(), chunk.words.first
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first)[:-1] if len(gone) else np.zeros(len(first) - 1, np.int64)
                size = np.diff(first)
                removed[size == 0] = 0
                kept = []
                for j, value in enumerate(chunk.text):
                    words = (value.as_py() or "").encode().split()
                    kept.append(b" ".join(compress(words, ~gone[first[j] : first[j + 1]]) if removed[j] else words).decode())
                out = {n: chunk.rows.column(n) for n in names if n not in OUTPUT}
                out |= {"kept_text": pa.array(kept, pa.string()), "n_words": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                yield from pa.table(out).combine_chunks().to_batches()

    return run


def substring_dedup(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words`` and ``n_removed``; see the module for the rules."""
    spark = docs.sparkSession
    space = Workspace(spark, "substring")
    chunks = space.keep(docs.mapInArrow(_pack(text), _CHUNKS), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    tasks, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism

    done: list[tuple[int, int]] = []
    answers: DataFrame | None = None
    share, found = 1.0, 0

    def joined() -> DataFrame:
        if answers is None:
            return chunks.select("chunk_id", "payload")
        got = answers.groupBy("chunk_id").agg(F.collect_list(F.struct("level", "bucket", "hits")).alias("answers"))
        # one plan at every size: a broadcast of small answers would hide what the chunks' own shuffle costs
        return chunks.select("chunk_id", "payload").join(got.hint("merge"), "chunk_id", "left")

    for level, length in enumerate(levels(window)):
        density = 1.0 if length == window else 2 / (window - length + 2)
        full = math.ceil(total * density * share / BUCKET_KEYS)
        buckets = max(tasks, full)
        asks = joined().mapInArrow(_ask(text, window, done[:], length, buckets), _ASKS)
        here = space.keep(asks.groupBy("bucket").applyInArrow(_answer, _ANSWERS).coalesce(max(cores, full)), f"answers{level}")
        n_keys, found = here.agg(F.sum("n_keys"), F.sum("n_hits")).first()
        done.append((length, buckets))
        if not found:
            break
        share *= found / n_keys
        marked = here.filter("n_hits > 0").select("chunk_id", F.lit(level).alias("level"), "bucket", "hits")
        answers = marked if answers is None else answers.unionByName(marked)

    fields = [f for f in docs.schema.fields if f.name not in OUTPUT]
    fields += [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    last = joined() if found else chunks.select("chunk_id", "payload")
    return last.mapInArrow(_finish(text, window, done, docs.columns), T.StructType(fields))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows removed from every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM words WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 35)))) AS g
  FROM windows JOIN repeated USING (h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
         CASE WHEN g IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i))) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
