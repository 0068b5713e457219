"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a Parquet table (content_digest, n_bytes, n_tokens) with a folder
for each tokenizer version.  Contents are normalised only as far as no tokenizer
can tell the difference: null becomes empty.

1. Digests alone are grouped and anti-joined with the cache: no text moves yet,
   and none ever does when the cache knows all of them.
2. Misses up to ``MISSES_MOST`` are broadcast, so that only their texts leave
   the scan; more are joined by digest.  Either way a task sends each missing
   text once, compressed, so a text that a third of all rows share crosses the
   shuffle once per task.  Each is encoded once by the tokenizer's own library
   and appended to the cache.
3. Documents are joined with the counts of their digests; digests of many rows
   are broadcast (``skew``).

Two calls on one cache at a time may both append what neither had found; equal
rows of the cache count once.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); texts of any
length are encoded whole; repeated rows share one encoding; strings of special
tokens are what the library makes of them by default; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizers
from .skew import join_unique
from .workspace import Workspace

LIMIT = 4096
MISSES_MOST = 100_000
CACHE = "content_digest binary, n_bytes long, n_tokens long"


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of the task once: its digest and its compressed bytes."""
    seen: set[bytes] = set()
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            keys, packed = [], []
            for key, text in zip(batch.column(0).slice(a, 500).to_pylist(), batch.column(1).slice(a, 500).cast(pa.large_binary()), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(squeeze.compress(text.as_py() or b""))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["content_digest", "packed"])


def _encode(name: str):
    def lengths(texts: list[str]) -> list[int]:
        if name.endswith(".model"):
            return [len(x) for x in tokenizers.sentence_pieces(name).encode(texts, num_threads=1)]
        return [len(tokenizers.byte_bpe(name).encode(x, add_special_tokens=False).ids) for x in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        restore = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                keys, raw = [], []
                for key, packed in zip(batch.column(0).slice(a, 100).to_pylist(), batch.column(1).slice(a, 100), strict=True):
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        raw.append(restore.decompress(packed.as_py()))
                if keys:
                    tokens = lengths([x.decode() for x in raw])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array(tokens, pa.int64())],
                        names=["content_digest", "n_bytes", "n_tokens"],
                    )

    return run


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = LIMIT, cache_path: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; new counts are appended to the cache at ``cache_path``.

    Without a path the cache is a fresh one, of this call.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "tokens")
    path = f"{cache_path or space.path + '/cache'}/{tokenizers.digest(tokenizer)}"
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)  # the first call makes the folder
    digest = F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("content_digest")

    known = space.keep(docs.select(digest).groupBy("content_digest").agg(F.count("*").alias("n_rows")), "digests")
    stored = spark.read.schema(CACHE).parquet(path)
    misses = space.keep(known.join(stored, "content_digest", "left_anti").select("content_digest"), "misses")
    total, n_misses = known.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0], misses.count()
    if n_misses:
        texts = docs.select(digest, F.col(text).alias("text"))
        fields = "content_digest binary, packed binary"
        if n_misses <= MISSES_MOST:
            dealt = texts.join(F.broadcast(misses), "content_digest", "left_semi").mapInArrow(_distinct_texts, fields).repartition("content_digest")
        else:
            dealt = texts.mapInArrow(_distinct_texts, fields).join(misses.hint("shuffle_hash"), "content_digest", "left_semi")
        dealt.mapInArrow(_encode(tokenizer), CACHE).write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)

    counts = spark.read.schema(CACHE).parquet(path).dropDuplicates(["content_digest"]).join(known, "content_digest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest)
    counted = join_unique(rows, counts, ["content_digest"], "n_rows", total, F.col("doc_id"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """SentencePiece token counts of every text of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
