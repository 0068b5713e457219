"""Collocations, vector codes and quality rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Extra columns whose names the operators use inside.
CLASHES = "f long, phrase string, n long, home string, line string, row long, words int, kept string"
EXTRA = (1, "x", 2, "y", "z", 3, 4, "no")


def table(spark, rows, schema):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {CLASHES}")


# --- collocations -----------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, words[i : i + size]] += 1
    often = {k: v for k, v in f.items() if v >= least}
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        longer = (q for (lg, q), b in often.items() if lg == lang and len(q) > len(p) and 100 * b >= 100 * a)
        if any(p == q[i : i + len(p)] for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        k = cut[1]
        found[lang].append((-cut[0], -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, lf, rt, m, -score) for lang, of in found.items() for i, (score, a, p, lf, rt, m) in enumerate(sorted(of)[:top], 1))


@pytest.fixture(scope="module")
def phrase_rows():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["New", "york", "ist", "Größe", "日本", "\x85", "a-b", "x_y%"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(r.randrange(0, 60)):
            words += r.choice([["New", "York", "City"], ["new", "york"], [r.choice(vocab)], [r.choice(vocab)], ["tick"] * 3, ["of", "the", "one", "and", "only", "one"]])
        text = "".join(w + r.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "; ", "!\x0b", "\r\n"]) for w in words)
        rows.append((r.choice(["en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), ("en", ""), (None, " \t.,\n"), ("en", "only once"), ("de", "tick " * 5000), rows[0], rows[1]]


@pytest.mark.parametrize(("least", "longest", "top"), [(8, 5, 2000), (3, 4, 7), (2, 2, 3), (10**6, 5, 10)])
def test_collocations(spark, phrase_rows, least, longest, top):
    from ledgerlens.llm.collocations import collocations

    got = collocations(table(spark, phrase_rows, "lang string, text string").repartition(3), least=least, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(phrase_rows, least, longest, top)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert bool(want) == (least < 10**6)


def test_collocations_of_nothing(spark):
    from ledgerlens.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_collocations_with_a_full_bit_table(spark, phrase_rows, monkeypatch):
    """A table that lets nearly everything through costs counts, not results; several slices are put together."""
    from ledgerlens.llm import collocations as c

    monkeypatch.setattr(c, "bits_for", lambda phrases: 64)
    docs = table(spark, phrase_rows, "lang string, text string")
    assert sorted(tuple(x) for x in c.collocations(docs, least=8).collect()) == brute_collocations(phrase_rows, 8)
    monkeypatch.undo()
    assert c.bits_for(10**9) == c.BITS_MOST and c.bits_for(1) == 1024
    key = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    bits = 1 << 21
    on = np.zeros(bits, bool)
    for place in c.places(key, bits):
        on[place.astype(np.int64)] = True
        assert (place // c.SLICE_BITS == c.places(key, bits)[0] // c.SLICE_BITS).all()
    packed = np.packbits(on, bitorder="little")
    assert c.holds(packed, key).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert c.holds(packed, other).mean() < 0.01


def test_collocation_scores_pass_64_bits(spark, tmp_path, monkeypatch):
    """Counts as of a very large corpus: products beyond 64 bits, ties after flooring to the shorter first part."""
    from ledgerlens.llm import collocations as c

    big = 10**12
    found = [
        spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "c", big + 7)], "lang string, phrase string, f long"),
        spark.createDataFrame([("en", "a b", big - 2), ("en", "b c", big - 3)], "lang string, phrase string, f long"),
        spark.createDataFrame([("en", "a b c", big - 5)], "lang string, phrase string, f long"),
    ]
    totals = spark.createDataFrame([("en", 10**13 + 3)], "lang string, n long")
    monkeypatch.setattr(c, "levels", lambda *a: (found, totals))
    got = {r.phrase: r for r in c.collocations(spark.createDataFrame([], "lang string, text string")).collect()}
    n = 10**13 + 3
    assert got["a b"].score == 1000 * (big - 2) * n // (big * (big - 1))
    three = got["a b c"]
    cuts = [(1000 * (big - 5) * n // (big * (big - 3)), 1), (1000 * (big - 5) * n // ((big - 2) * (big + 7)), 2)]
    assert (three.score, three.l) == (min(cuts)[0], [big, big - 2][min(cuts)[1] - 1])


# --- vector codes -----------------------------------------------------------------------------------------------------


def brute_codes(rows, scale, parts, entries, rounds):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def near(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(book))

    kept = [(i, [math.floor(float(x) * scale) for x in v], lb) for i, v, lb in rows if usable(v)]
    out = []
    for length in {len(v) for _, v, _ in kept}:
        own = sorted(((i is None, i or 0, v), i, v, lb) for i, v, lb in kept if len(v) == length)
        size, more = divmod(length, parts)
        ends = [k * size + min(k, more) for k in range(parts + 1)]
        cut = [[tuple(v[a:b]) for a, b in zip(ends, ends[1:], strict=False)] for _, _, v, _ in own]
        books = [[list(row[p]) for row in cut[:entries]] for p in range(parts)]
        for _ in range(rounds):
            for p in range(parts):
                took = defaultdict(list)
                for row in cut:
                    took[near(row[p], books[p])[1]].append(row[p])
                for e, of in took.items():
                    books[p][e] = [sum(c) // len(of) for c in zip(*of, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (_, i, _, lb), row in zip(own, cut, strict=True):
            best = [near(row[p], books[p]) for p in range(parts)]
            out.append([i, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), 2**63 - 1), lb, digest])
    sums = Counter()
    for row in out:
        sums[row[3]] += row[2]
    return sorted(repr((i, code, err, min(sums[lb], 2**63 - 1), dg)) for i, code, err, lb, dg in out)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def vector_rows():
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v], int(i) % 4) for i, v in enumerate(r.normal(size=(150, 12)))]
    rows += [(200 + i, rows[i][1], None) for i in range(20)]  # copies without a label
    rows += [(300, None, 1), (301, [1.0, None] * 6, 1), (302, [float("nan")] * 12, 2), (303, [float("inf")] * 12, 2), (304, [0.0] * 12, 9)]
    rows += [(None, [0.5] * 12, 1), (5, [9.0] * 12, 1), (5, [-9.0] * 12, 1), rows[7]]
    return r.permutation(np.array(rows, object)).tolist()


def found_codes(got):
    return sorted(repr(tuple(x)) for x in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 2), (3, 5, 3), (1, 400, 1), (12, 8, 0), (5, 7, 2)])
def test_vector_codes(spark, vector_rows, parts, entries, rounds):
    from ledgerlens.llm.vector_codes import vector_codes

    if entries > 256:  # more entries than rows: every row is its own entry; codes have four digits
        got = vector_codes(table(spark, vector_rows, VECTORS), parts=parts, entries=entries, rounds=rounds)
        assert {len(r.code) for r in got.collect()} == {2} and {r.error for r in got.collect()} == {0}
        return
    got = vector_codes(table(spark, vector_rows, VECTORS).repartition(3), parts=parts, entries=entries, rounds=rounds)
    assert found_codes(got) == brute_codes(vector_rows, 256, parts, entries, rounds)


def test_vector_codes_of_odd_tables(spark):
    from ledgerlens.llm.vector_codes import vector_codes

    assert vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    huge = [(1, [1e300, -1e300], 1), (2, [1e300, 5.0], 1), (3, [3.0, 4.0], 1), (4, [7.0, 2.0**40], None), (5, [], 1), (6, [], 2), (7, [1.0, 2.0, 3.0], 2), (8, [-1e300, 1e299], 1)]
    got = vector_codes(spark.createDataFrame(huge, VECTORS), parts=2, entries=2, rounds=2)
    assert found_codes(got) == brute_codes(huge, 256, 2, 2, 2)


def test_bounds_hold_and_prune():
    """Every entry's distance lies within its bounds, and few entries are left to compare."""
    from ledgerlens.llm.vector_codes import Cells

    r = np.random.default_rng(6)
    book, x = r.integers(-500, 500, (64, 4)), r.integers(-700, 700, (300, 4))
    cells = Cells(book)
    lower, upper = cells.bounds(x)
    exact = ((x[None] - book[:, None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=0)).mean() < 0.2
    code, far = cells.nearest(x)
    assert (code == exact.argmin(axis=0)).all() and (far == exact.min(axis=0)).all()


# --- quality rules ----------------------------------------------------------------------------------------------------


def brute_rules(rows, most, least_kept):
    normal = {}
    hosts = Counter()
    for i, (_, host, text) in enumerate(rows):
        lines = [(no, line, " ".join(WORD.findall(line.translate(LOWER)))) for no, line in enumerate((text or "").split("\n")) if WORD.search(line)]
        normal[i] = [(no, line, re.sub("[0-9]", "0", form)) for no, line, form in lines]
        hosts.update({(host, form) for _, _, form in normal[i]})
    out = []
    for i, (doc, host, text) in enumerate(rows):
        text = text or ""
        words = WORD.findall(text)
        at = defaultdict(list)
        for k in range(len(words) - 2):
            at[tuple(words[k : k + 3])].append(k)
        covered = {k + j for of in at.values() if len(of) > 1 for k in of for j in range(3)}
        gone = [(no, len(form.split(" "))) for no, _, form in normal[i] if hosts[host, form] > most]
        n, lost = len(words), sum(x for _, x in gone)
        base = n < 50 or 100 * len(covered) > 50 * n
        depleted = 100 * (n - lost) < least_kept * n
        repeats = len(normal[i]) - len({line for _, line, _ in normal[i]})
        out.append((doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), base, lost, [no for no, _ in gone], depleted, not base and not depleted))
    return out


@pytest.fixture(scope="module")
def rule_rows():
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(400)] + ["Größe", "日本語", "\x85", "a|b", "<p>", "#1"]
    footers = ["Copyright 2019 by US", "copyright  2020 by us", "COPYRIGHT 1999\tby us\r", "Share this page | Tweet | Like"]
    rows = []
    for i in range(60):
        lines = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 15))) for _ in range(r.randrange(1, 14))]
        if i % 2:
            lines.append(r.choice(footers))
        if i % 5 == 0:
            lines = lines[:1] + [f"menu {i % 3} of the site with many words that all its pages have in common"] * 9
        rows.append((i, r.choice(["a", "a", "b", None]), "\n".join(lines)))
    rows += [(100, "a", None), (101, "a", ""), (102, None, " \n\t\x0b\n"), (103, "b", "tick " * 400), (104, "b", "one two three\none two three\none two  three"), (105, "c", "x" * 9000), (None, "a", "no id " * 30), (106, "c", "\x00 nul")]
    return [*rows, rows[1], rows[1]]


@pytest.mark.parametrize(("most", "least_kept"), [(10, 50), (3, 80), (0, 1)])
def test_quality_rules(spark, rule_rows, most, least_kept):
    from ledgerlens.llm.quality_rules import quality_rules

    docs = table(spark, rule_rows, "doc_id long, source string, text string").repartition(3)
    got = quality_rules(docs, most_documents=most, least_kept=least_kept)
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "removed_lines", "depleted", "kept"]
    assert set(got.columns) == set(fields)
    assert sorted(map(repr, (tuple(x) for x in got.select(fields).collect()))) == sorted(map(repr, brute_rules(rule_rows, most, least_kept)))


def test_quality_rules_remove_lines(spark, rule_rows):
    from ledgerlens.llm.quality_rules import quality_rules, without_lines

    docs = spark.createDataFrame([r for r in rule_rows[:60]], "doc_id long, source string, text string")
    rules = quality_rules(docs, most_documents=3)
    texts = {r.doc_id: r.left for r in docs.join(rules, "doc_id").select("doc_id", without_lines("text", "removed_lines").alias("left")).collect()}
    gone = {row[0]: set(row[8]) for row in brute_rules(rule_rows[:60], 3, 50)}
    for doc, _, text in rule_rows[:60]:
        assert texts[doc] == "\n".join(line for no, line in enumerate(text.split("\n")) if no not in gone[doc])
    assert any(gone.values())


def test_quality_rules_of_nothing(spark):
    from ledgerlens.llm.quality_rules import quality_rules

    assert quality_rules(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
