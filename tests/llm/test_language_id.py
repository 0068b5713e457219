"""Language identification against plain Python, numeric gradients and held-out documents."""

import math

import numpy as np

SF = "/root/testdata/sf0.01"


def _plain_subwords(text: str) -> list[bytes]:
    data = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in text.encode())
    out = []
    for word in data.split():
        marked = b" " + word + b" "
        for n in (2, 3, 4):
            out += [g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]).strip() == g or len(g.strip()) == n - 1]
    return out


def test_subwords_are_the_runs_of_each_word():
    from ledgerlens.llm.language_id import subwords

    texts = ["der hund", "", "a", "x1y don't", "straße é", "   ", "ab"]
    bucket, owner = subwords([t.encode() for t in texts])
    for i, text in enumerate(texts):
        want = sorted(b for g in _plain_subwords(text) for b in _bucket(g))
        assert sorted(bucket[owner == i].tolist()) == want, text


def _bucket(gram: bytes) -> list[int]:
    """The bucket of one run, with Python's integers."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    run = 0
    for k, c in enumerate(gram):
        value = (c + 1) * base & mask
        value ^= value >> 29
        run = (run * base + value) & mask if k else value
    return [(run * 0xD6E8FEB86659FD93 & mask) >> 49]


def test_scores_are_the_softmax_of_mean_embeddings():
    from ledgerlens.llm.language_id import BUCKETS, Model

    r = np.random.default_rng(1)
    rows, bias = r.normal(size=(BUCKETS, 3)), r.normal(size=3)
    model = Model(["a", "b", "c"], rows, bias, 0.7, 0.0)
    texts = ["the house", "über", "", "x"]
    for text, got in zip(texts, model.scores([t.encode() for t in texts]), strict=True):
        grams = _plain_subwords(text)
        z = [(sum(rows[_bucket(g)[0], c] for g in grams) / max(1, len(grams)) + bias[c]) / 0.7 for c in range(3)]
        e = [math.exp(v) for v in z]
        assert np.allclose(got, np.array(e) / sum(e))


def test_gradients_are_those_of_the_loss():
    from ledgerlens.llm.language_id import gradients, softmax

    r = np.random.default_rng(2)
    embed, weight, bias = r.normal(size=(20, 4)), r.normal(size=(4, 3)), r.normal(size=3)
    bucket, of, truth = r.integers(0, 20, 30), np.sort(r.integers(0, 5, 30)), r.integers(0, 3, 5)

    def loss():
        mean = np.stack([embed[bucket[of == i]].sum(axis=0) / max(1, (of == i).sum()) for i in range(5)])
        return -np.log(softmax(mean @ weight + bias)[np.arange(5), truth]).mean()

    back, by_weight, by_bias = gradients(embed, weight, bias, bucket, of, truth)
    by_embed = np.zeros_like(embed)
    np.add.at(by_embed, bucket, back)
    for array, gradient in ((embed, by_embed), (weight, by_weight), (bias, by_bias)):
        for at in np.ndindex(array.shape):
            kept = array[at]
            array[at] = kept + 1e-5
            up = loss()
            array[at] = kept - 1e-5
            down = loss()
            array[at] = kept
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6


def test_held_out_documents_and_calibration(spark):
    from ledgerlens.llm.language_id import op2_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "lang").collect()}
    got = [r for r in op2_language_id(spark, SF).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    right = np.array([r.lang_pred == truth[r.doc_id] for r in got])
    score = np.array([r.score for r in got])
    assert len(got) > 200 and right.mean() > 0.9
    assert abs(score.mean() - right.mean()) < 0.08  # scores are probabilities
    rejected = np.array([r.rejected for r in got])
    assert rejected[right].mean() < 0.02


def test_one_table_gives_one_model_and_clashing_columns_are_replaced(spark):
    from ledgerlens.llm.language_id import identify, sample
    from pyspark.sql import functions as F

    rows = [(i % 40, f"{'the house and river' if i % 2 else 'der fluss und haus'} {i}", "en" if i % 2 else "de", 7, "old") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    assert sample(docs.repartition(1), F.lit(True)) == sample(docs.repartition(6), F.lit(True))
    assert len(sample(docs, F.lit(True), most=9)[0]) == 9 and sample(docs, F.lit(True), chars=3) == ([], [])
    out = identify(docs, usable=F.lit(True))
    assert dict(out.dtypes) == {"doc_id": "bigint", "text": "string", "lang": "string", "lang_pred": "string", "score": "double", "rejected": "boolean"}
    assert {r.lang_pred for r in out.collect()} <= {"de", "en", "und"} and out.count() == 120
