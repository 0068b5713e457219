"""Candidate pairs: recall at the threshold, weakly similar documents, buckets in blocks, the filter before texts move."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import band_pairs, near_dedup
from ledgerlens.llm.band_pairs import _compare, banding, candidate_links, least_equal, only_with, reached


def signed(texts, shingle, percent):
    rows, bands = banding(percent / 100)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    out = pa.Table.from_batches(near_dedup._sign(shingle, rows, bands)(iter([batch])))
    codes = np.array(out.column("bands").to_pylist())
    sketch = np.frombuffer(b"".join(out.column("sketch").to_pylist()), np.uint8).reshape(len(texts), -1)
    return codes, sketch


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_pairs_at_the_threshold_share_a_band_and_pass_by_sketch(shingle, percent):
    rng, pairs, texts = random.Random(3), 1500, []
    for _ in range(pairs):
        # cutting words off the end leaves a subset of a known share
        size = rng.choice([20, 40, 100])
        words = [f"w{rng.random()}" for _ in range(size + shingle - 1)]
        texts += [" ".join(words), " ".join(words[: size * percent // 100 + shingle - 1])]
    codes, sketch = signed(texts, shingle, percent)
    assert (codes[::2] == codes[1::2]).any(axis=1).all()
    equal = (sketch[::2] == sketch[1::2]).sum(axis=1)
    assert equal.min() >= least_equal(sketch.shape[1], percent / 100)
    assert abs(equal.mean() / sketch.shape[1] - percent / 100) < 0.01


def test_least_equal_is_a_lower_tail():
    draws = np.random.default_rng(1).binomial(120, 0.85, 200_000)
    least = least_equal(120, 0.85)
    assert (draws < least).mean() < 1e-4
    assert 0.5 * 120 < least < 0.85 * 120


def test_reached_are_the_components_of_equal_bytes():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 256, (6, 40), dtype=np.uint8)
    sketch = seeds[rng.integers(0, 6, 60)]
    noise = rng.random(sketch.shape) < 0.12
    sketch = np.where(noise, rng.integers(0, 256, sketch.shape, dtype=np.uint8), sketch)
    group = list(range(60))
    for a in range(60):
        for b in range(a):
            if (sketch[a] == sketch[b]).sum() >= 30:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = {frozenset(i for i in range(60) if group[i] == g) for g in set(group)}
    assert {frozenset(x.tolist()) for x in reached(sketch, 30)} == want


@pytest.mark.parametrize("cut", [1, 3, 7, 50])
def test_buckets_are_whole_whatever_the_batches(cut):
    rng = np.random.default_rng(7)
    bucket = np.sort(rng.integers(0, 12, 50))
    kind = rng.integers(0, 3, 50)
    table = pa.table(
        {"bucket": bucket, "i": pa.array([0] * 50, pa.int32()), "j": pa.array([0] * 50, pa.int32()), "node": np.arange(50), "sketch": [bytes([k] * 8) for k in kind]}
    )
    out = pa.Table.from_batches(_compare(8)(iter(table.to_batches(max_chunksize=cut))))
    want = set()
    for x in range(50):
        least = min(y for y in range(50) if bucket[y] == bucket[x] and kind[y] == kind[x])
        if least != x:
            want.add((x, least))
    assert set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)) == want


def weak(n):
    """Documents that share a third of their shingles with all others, and one near copy of each tenth."""
    rng = random.Random(11)
    common = [f"common{i}" for i in range(62)]
    out = []
    for i in range(n):
        own = [f"x{rng.random()}" for _ in range(60)]
        out.append((i, " ".join(common + own)))
        if i % 10 == 0:
            out.append((n + i, " ".join(common + own + ["tail"])))
    return out


@pytest.mark.parametrize("members", [8192, 50])
def test_weakly_similar_documents_stay_apart(spark, monkeypatch, members):
    monkeypatch.setattr(band_pairs, "BUCKET_MEMBERS", members)
    rows = weak(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    r, b = banding(0.8)
    classes = docs.mapInArrow(near_dedup._sign(5, r, b), near_dedup._SIGNATURES).withColumnRenamed("doc_id", "node").persist()
    in_a_bucket = classes.selectExpr("node", "explode(bands) AS bucket").groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert in_a_bucket > 20  # by bands alone they would be one group
    found = {(min(x), max(x)) for x in candidate_links(classes, len(rows), 2 * -(-r * b // 2), 0.8).collect()}
    classes.unpersist()
    assert found == {(i, 600 + i) for i in range(0, 600, 10)}


def test_only_with_keeps_what_is_wanted(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS doc_id, 'n' AS text"))
    ids = spark.range(0, 20_000, 40).withColumnRenamed("id", "doc_id")
    left = [x[0] for x in only_with(rows, ids, "doc_id").select("doc_id").collect()]
    assert set(range(0, 20_000, 40)) <= set(left)
    assert len(left) < 3000
    assert only_with(rows, ids.limit(0), "doc_id").count() == 0
