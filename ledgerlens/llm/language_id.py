"""Language identification with averaged hashed subword embeddings.

A text's subwords are the runs of 2 to 4 bytes of its lower-cased words, with a
blank at each end of which a run takes one at most; everything ASCII that is not a letter is a blank.  Each is
hashed to one of ``BUCKETS`` embeddings; a linear softmax reads their mean.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy on random stretches of words, so that short texts are as well placed as
long ones.  A temperature, fitted on documents that the descent has not seen,
turns the softmax into calibrated scores, and the rejection threshold is the
score under which no more than ``REJECT_RIGHT`` of those documents' right
answers fall, and never above ``REJECT_MOST``.

The fit uses at most ``sample_docs`` labelled documents of at most
``sample_chars`` characters (parameters of ``identify``; longer texts are not
learnt from but predicted like all), those of least hash of doc_id; the driver
holds no more than that.  Of rows that share a doc_id the one of least hash is
learnt from, so the same table gives the same model.  Prediction is one map over whole texts: since the model is
linear, a subword adds one row of (embeddings x softmax) to its text's sum.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
is rejected; without any labelled row every text is; ties go to the first
language by name; empty tables give empty tables; other columns pass through,
except that the output columns replace those of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .substring_dedup import slices
from .words import U

BUCKETS = 1 << 15
WIDTH = 12
LENGTHS = (2, 3, 4)
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 20_000
REJECT_RIGHT = 0.001
REJECT_MOST = 0.5
CHUNK_BYTES = 1 << 20
UNDETERMINED = "und"

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[i for i in range(128) if not chr(i).isalpha()]] = 32
_BASE = 0x9E3779B97F4A7C15


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, the text it is from), for lower-cased texts."""
    data = _BLANK[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in texts])
    blank = data == 32
    with np.errstate(over="ignore"):
        value = (data.astype(U) + U(1)) * U(_BASE)
        value ^= value >> U(29)
        at, bucket = [], []
        run = value.copy()
        solid = np.ones(len(data), bool)
        for n in range(2, LENGTHS[-1] + 1):
            run = (run[:-1] * U(_BASE) + value[n - 1 :]) if n <= len(data) else run[:0]
            solid = solid[:-1] if n == 2 else solid[:-1] & ~blank[n - 2 : len(data) - 1]
            if n in LENGTHS:
                use = np.flatnonzero(solid & ~(blank[: len(run)] & blank[n - 1 :]))
                at.append(use)
                bucket.append(((run[use] * U(0xD6E8FEB86659FD93)) >> U(49)).astype(np.int64))
    where = np.concatenate(at)
    return np.concatenate(bucket), np.searchsorted(ends, where, side="right")


@dataclass
class Model:
    """A fitted model: what each bucket adds to each language's sum, and how scores are read."""

    languages: list[str]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bucket, owner = subwords(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        sums = np.stack([np.bincount(owner, self.rows[bucket, c], minlength=len(texts)) for c in range(len(self.languages))], axis=1)
        return softmax((sums / n[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _stretches(texts: list[str], rng: np.random.Generator, each: int) -> tuple[list[bytes], list[int]]:
    """Random runs of 1 to 30 words of each text, and the texts they are from."""
    out, owner = [], []
    for i, text in enumerate(texts):
        words = text.split()
        for _ in range(each if words else 0):
            n = int(rng.integers(1, 31))
            a = int(rng.integers(0, max(1, len(words) - n + 1)))
            out.append(" ".join(words[a : a + n]).encode())
            owner.append(i)
    return out, owner


def gradients(embed: np.ndarray, weight: np.ndarray, bias: np.ndarray, bucket: np.ndarray, of: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean cross-entropy: what each subword adds to its embedding's gradient, and the gradients of weights and bias."""
    n = np.maximum(np.bincount(of, minlength=len(truth)), 1).astype(embed.dtype)
    mean = np.zeros((len(truth), embed.shape[1]), embed.dtype)
    np.add.at(mean, of, embed[bucket])
    mean /= n[:, None]
    error = softmax(mean @ weight + bias)
    error[np.arange(len(truth)), truth] -= 1
    error /= len(truth)
    return ((error @ weight.T) / n[:, None])[of], mean.T @ error, error.sum(axis=0)


def fit(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 4.0, seed: int = 7) -> Model | None:
    """Fit on four fifths of the texts and calibrate on the rest."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    lower = [t.lower() for t in texts]
    target = np.searchsorted(languages, labels)
    held = np.arange(len(texts)) % 5 == 4
    learn = np.flatnonzero(~held)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = np.zeros((WIDTH, len(languages)), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    for epoch in range(epochs):
        parts, owner = _stretches([lower[i] for i in learn], rng, 4)
        truth = target[learn][owner]
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(parts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            bucket, of = subwords([parts[i] for i in pick])
            if not len(bucket):
                continue
            back, by_weight, by_bias = gradients(embed, weight, bias, bucket, of, truth[pick])
            weight -= step * by_weight
            bias -= step * 0.1 * by_bias
            np.add.at(embed, bucket, -step * len(pick) * back)

    model = Model(languages, (embed @ weight).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    unseen = np.flatnonzero(held)
    parts, owner = _stretches([lower[i] for i in unseen], rng, 2)
    if parts:
        truth = target[unseen][owner]
        logit = np.log(np.maximum(model.scores(parts), 1e-300))
        loss = [(-np.log(np.maximum(softmax(logit / t)[np.arange(len(truth)), truth], 1e-12)).mean(), t) for t in np.geomspace(0.05, 10, 60)]
        model.temperature = float(min(loss)[1])
        whole = model.scores([lower[i].encode() for i in unseen])
        right = whole.argmax(axis=1) == target[unseen]
        if right.any():
            model.threshold = float(min(REJECT_MOST, np.quantile(whole.max(axis=1)[right], REJECT_RIGHT)))
    return model


def sample(docs: DataFrame, usable: Column, text: str = "text", label: str = "lang", most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """The labelled documents to learn from: those of least hash among the usable ones."""
    rows = docs.filter(usable & F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) <= chars))
    ids = [r[0] for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not ids:
        return [], []
    picked = F.min(F.struct(F.xxhash64(text, label), F.col(text).alias("text"), F.col(label).alias("label"))).alias("p")
    got = sorted(rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(picked).collect(), key=lambda r: r[0])
    return [r.p.text for r in got], [r.p.label for r in got]


def _predict(model: Model | None, text: str, names: list[str], outputs: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
            for a, b in slices(batch, pc.binary_length(column).to_numpy(zero_copy_only=False), CHUNK_BYTES):
                part = column.slice(a, b - a)
                letters = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                language, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
                if model is not None:
                    p = model.scores([x.as_py().encode() for x in pc.utf8_lower(part)])
                    best = p.argmax(axis=1)
                    score = np.where(letters, p[np.arange(b - a), best], 0.0)
                    language = [model.languages[k] if yes else UNDETERMINED for k, yes in zip(best, letters, strict=True)]
                rejected = ~letters | (score < (model.threshold if model is not None else 1.0))
                rows = {n: batch.column(batch.schema.get_field_index(n)).slice(a, b - a) for n in names}
                rows |= dict(zip(outputs, (pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)), strict=True))
                yield pa.RecordBatch.from_pydict(rows)

    return run


def held_out() -> Column:
    """Documents that nothing is learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, learn_from: DataFrame | None = None, usable: Column | None = None, text: str = "text", outputs: tuple[str, str, str] = ("lang_pred", "score", "rejected"), sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` with the predicted language, its score and whether it is rejected.

    The model is fitted on the ``usable`` rows of ``learn_from`` (``docs`` itself by default).
    """
    source = docs if learn_from is None else learn_from
    model = fit(*sample(source, ~held_out() if usable is None else usable, text, most=sample_docs, chars=sample_chars))
    kept = [f for f in docs.schema.fields if f.name not in outputs]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(outputs, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.mapInArrow(_predict(model, text, [f.name for f in kept], outputs), schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learnt from two thirds of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), learn_from=docs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
