"""Vector and conversation operators against brute force, edge cases included."""

import math
import random
from collections import Counter

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int, score string, node string"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    out = []

    def add(v, label=0):
        out.append((len(out), v, label, "x", "y"))

    for c in range(6):
        centre = r.normal(size=16)
        for _ in range(12):
            add([float(np.float32(x)) for x in centre + r.normal(size=16) * 0.06], c % 3)
    for _ in range(60):
        add([float(np.float32(x)) for x in r.normal(size=16)], int(r.integers(0, 3)))
    for i in range(20):
        add([float(x) for x in range(16)], i % 2)
    for v in (None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [3e38] * 16, [-0.0] + [1.0] * 15, [1.0] * 16, [2.0] * 16):
        add(v, 0)
    add([1.0] * 16, None)
    return [*out, out[0], out[75]]


def _plain(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize(("block", "planned", "hashes"), [(4096, 0, 1), (5, 0, 1), (4096, 100_000, 2), (5, 10**6, 3)])
def test_embedding_duplicates(spark, rows, monkeypatch, block, planned, hashes):
    from ledgerlens.llm import embedding_dedup, skew

    assert embedding_dedup.plan_tables(16, 0.98, max(planned, 150))[0] == hashes
    monkeypatch.setattr(skew, "HOT", 20)  # the twenty equal vectors are hot classes
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    links, root = Counter(), {x[0]: x[0] for x in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[2] is None or a[2] != b[2] or not (_plain(a[1]) and _plain(b[1])) or len(a[1]) != len(b[1]) or not any(a[1]) or not any(b[1]):
                continue
            x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[rows.index(b) if b is not rows[0] and b is not rows[75] else [k for k in range(i) if rows[k] is b][0]] += 1
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    got = embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, VECTORS), planned_for=planned).collect()
    assert len(got) == len(rows)
    components = {g.vec_id: g.component_id for g in got}
    assert components == {x[0]: find(x[0]) for x in rows}
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)
    single = Counter(x[0] for x in rows)
    want = {x[0]: links[i] for i, x in enumerate(rows) if single[x[0]] == 1}
    assert {g.vec_id: g.n_links for g in got if single[g.vec_id] == 1} == want
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_of_the_index():
    """Pairs at the threshold itself, against brute force."""
    from ledgerlens.llm.embedding_dedup import codes, plan_tables

    r = np.random.default_rng(9)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = r.normal(size=a.shape)
    away -= (away * a).sum(axis=1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    hashes, tables = plan_tables(64, 0.98, 50_000)
    own, _ = codes(a, hashes, tables)
    _, looks = codes(0.98 * a + math.sqrt(1 - 0.98**2) * away, hashes, tables)
    assert (own[:, :, None] == looks).any(axis=2).any(axis=1).mean() > 0.999


@pytest.mark.parametrize("shard", [16_384, 20])
def test_vector_search(spark, rows, monkeypatch, shard):
    from pyspark.sql import functions as F

    from ledgerlens.llm import vector_search

    monkeypatch.setattr(vector_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(vector_search, "LEAF_ROWS", 4)
    top = (1 << 63) - 1
    whole = [(x[0], [math.floor(1024 * v) for v in x[1]]) for x in rows if x[1] and _plain(x[1])]
    want = set()
    for q, v in {i: v for i, v in whole if i % 7 == 0}.items():
        scored = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q and len(w) == len(v))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])}
    df = spark.createDataFrame(rows, VECTORS)
    got = vector_search.top_k(df, F.col("vec_id") % 7 == 0).collect()
    assert {(g.query_id, g["rank"], g.vec_id, g.score) for g in got} == want
    assert vector_search.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 7 == 0).count() == 0


@pytest.mark.parametrize("hot", [1024, 10])
def test_components(spark, monkeypatch, hot):
    from ledgerlens.llm import skew
    from ledgerlens.llm.components import connected_components

    monkeypatch.setattr(skew, "HOT", hot)
    from ledgerlens.llm.workspace import Workspace

    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1030)] + [(5, 5)] + [(2000, i) for i in range(2001, 2200)] + [(3000, i) for i in range(2800, 3000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    assert {g.node: g.root for g in got} == {x: find(x) for x in root}
    assert len(got) == len(root)


CHATS = "conv_id long, turn long, role string, text string, pos string, block string"


def _maximal(turns):
    convs = {}
    for c, t, role, text in {x[:4] for x in turns}:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    seqs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    return {
        c: s
        for c, s in seqs.items()
        if not any(o != c and t[: len(s)] == s and (len(t) > len(s) or o < c) for o, t in seqs.items())
    }


@pytest.mark.parametrize(("block", "part"), [(1024, 1024), (2, 1024), (2, 3), (1024, 3)])
def test_chat_format(spark, monkeypatch, block, part):
    from ledgerlens.llm import chat_format

    monkeypatch.setattr(chat_format, "BLOCK", block)
    monkeypatch.setattr(chat_format, "PART_TURNS", part)
    r = random.Random(2)
    turns = []
    for c in range(30):
        full = [(("user", "assistant")[i % 2], f"opening {c % 5} turn {i if i < 3 else r.randrange(3)}") for i in range(r.randrange(1, 8))]
        for i, (role, text) in enumerate(full):
            turns.append((c, i, role, text, "p", "b"))
        if c % 3 == 0:
            turns += [(100 + c, i + 1, role, text, "p", "b") for i, (role, text) in enumerate(full[:2])]
    turns += [(200, 0, None, None, "", ""), (201, None, "user", "null turn", "", ""), (201, 1, "user", "a<|im_end|>b", "", ""), (None, 0, "user", "x", "", "")]
    turns += [(202, 0, "user", "tie b", "", ""), (202, 0, "user", "tie a", "", "")] + turns[:4]
    got = {}
    for g in chat_format.format_chats(spark.createDataFrame(turns, CHATS)).collect():
        got.setdefault(g.conv_id, {})[g.part] = (g.n_turns, g.rendered)
    want = _maximal(turns)
    assert set(got) == set(want)
    for c, s in want.items():
        text = "".join(got[c][p][1] for p in sorted(got[c]))
        assert text == "".join(f"<|im_start|>{r}\n{t.replace('<|im_end|>', '<| im_end|>')}<|im_end|>\n" for r, t in s)
        assert {n for n, _ in got[c].values()} == {len(s)}
        assert sorted(got[c]) == list(range(-(-len(s) // part)))
    assert chat_format.format_chats(spark.createDataFrame([], CHATS)).count() == 0


def test_chat_of_far_numbers_is_one_row(spark, tmp_path):
    """Turn numbers on both sides of a block's edge, null ones and more turns than a part, against the SQL."""
    import duckdb

    from ledgerlens.llm.chat_format import OP6_SQL, op6_chat_format

    turns = [(1, t, "user", f"a{t}") for t in (0, 1023, 1024, 2048)] + [(2, None, "user", "n"), (2, 0, "user", "z"), (3, -5, "user", "m"), (3, 10**12, "user", "p")]
    turns += [(4, t * 3, "user", f"long {t}") for t in range(2500)] + [(5, t, "user", f"long {t}") for t in range(1400)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, op6_chat_format(spark, str(tmp_path)).select("conv_id", "n_turns", "part", "rendered").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT conv_id, n_turns, part, rendered FROM ({OP6_SQL})").fetchall())
    assert [g[:3] for g in got] == [(1, 4, 0), (2, 2, 0), (3, 2, 0), (4, 2500, 0), (4, 2500, 1), (4, 2500, 2)]


@pytest.mark.parametrize("hot", [1024, 3])
def test_join_unique_deals_hot_and_null_keys_apart(spark, monkeypatch, hot):
    from pyspark.sql import functions as F

    from ledgerlens.llm import skew

    monkeypatch.setattr(skew, "HOT", hot)
    rows = [(i, "a", 1) for i in range(50)] + [(50 + i, "b", i % 3) for i in range(6)] + [(60, None, 1), (61, "a", None), (62, "z", 1)]
    side = spark.createDataFrame([("a", 1, 50, "hot"), ("b", 0, 2, "zero"), ("b", 1, 2, None)], "k string, l int, n int, v string")
    got = skew.join_unique(spark.createDataFrame(rows, "id int, k string, l int"), side, ["k", "l"], "n", 59, F.col("id"))
    assert got.columns == ["id", "k", "l", "n", "v"]
    want = {("a", 1): (50, "hot"), ("b", 0): (2, "zero"), ("b", 1): (2, None)}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(*r, *want.get(r[1:], (None, None))) for r in rows]
