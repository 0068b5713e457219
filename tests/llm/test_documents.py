"""Document operators against brute force on a small table with every edge case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept_text int, node string, bucket string, level string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocab = {"en": ["the", "and", "house", "river", "walking", "under", "light"], "de": ["der", "und", "häuser", "über", "straße", "licht", "gehen"]}
    out = []

    def add(text, lang="en"):
        out.append((len(out), text, lang, "s0", None if text is None else len(text), 1, 2, "a", "b", "c"))

    base = [f"{r.choice(vocab['en'])}{r.randrange(40)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(60)]
    for i in range(12):  # near copies
        words = list(base)
        for _ in range(i % 5):
            words[r.randrange(len(words))] = f"edit{r.randrange(99)}"
        add(" ".join(words))
    for i in range(25):
        lang = ("en", "de")[i % 2]
        words = [f"{r.choice(vocab[lang])}" for _ in range(r.randrange(1, 90))]
        add(("\n" if i % 3 else " ").join(words), lang)
    for i in range(6):  # a passage that several share
        add(f"Lead{i} " + " ".join(passage) + f" tail{i} end")
    for _ in range(5):  # exact copies
        add("same words every time " * 12)
    add(" ".join(["tick"] * 80))  # repeats itself
    add(" ".join(f"w{i % 7}" for i in range(100)))
    for text in ("", None, " \n\t ", "one", "ONE", "one two", "ONE  two", "a\x0bb\x0cc", "x\x00y é 日本語 \x85 z", "123 456 !!!", "word " * 3000 + "end", "y" * 20000):
        add(text, None)
    return [*out, out[3], out[30]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(docs, rows, empty):
    from ledgerlens.llm.substring_dedup import levels, substring_dedup

    assert levels(35) == [9, 18, 35]
    assert all(b <= 2 * a for a, b in zip(levels(35), levels(35)[1:], strict=False))
    words = [WORD.findall(x[1] or "") for x in rows]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for x, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((x[0], len(w), len(gone), " ".join(v for i, v in enumerate(w) if i not in gone)))
    got = substring_dedup(docs).collect()
    assert sorted((g.doc_id, g.n_words, g.n_removed, g.kept_text) for g in got) == sorted(want)
    assert sum(x[2] > 0 for x in want) > 15
    assert {"text", "lang", "node", "bucket"} <= set(got[0].asDict())
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_ends_early(spark):
    from ledgerlens.llm.substring_dedup import substring_dedup

    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(5)], "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in substring_dedup(df).collect()} == {(50, 0)}


def test_substring_dedup_writes_few_files(spark):
    """However many shuffle partitions there are, small answers are a file a core, and the rows are the same."""
    from pathlib import Path

    from ledgerlens.llm import workspace
    from ledgerlens.llm.substring_dedup import substring_dedup

    shared = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{shared} " + " ".join(f"w{i}x{j}" for j in range(300))) for i in range(20)], "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = substring_dedup(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.n_words, r.n_removed) for r in got} == {(360, 60)}
    space = Path(workspace._LIVE[-1].path.removeprefix("file:"))
    files = [len(list((space / f"answers{level}").glob("part-*"))) for level in range(3)]
    assert min(files) > 0
    assert max(files) <= spark.sparkContext.defaultParallelism


def _components(rows, shingle, percent):
    sets = {}
    for x in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x[1] or ""))
        sets[x[0]] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, shingle, percent):
    from ledgerlens.llm.near_dedup import near_duplicates

    want = _components(rows, shingle, percent)
    got = near_duplicates(docs, shingle, percent).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    assert len({c for _, c in want.values()}) < len(want) - 8
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_split_group(docs, rows, monkeypatch):
    from ledgerlens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", 150)
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == _components(rows, 3, 85)


def test_banding_misses_one_in_a_million_at_most():
    from ledgerlens.llm.band_pairs import VALUES, banding

    for similarity in (0.5, 0.8, 0.85, 0.95):
        rows, bands = banding(similarity)
        assert rows * bands <= VALUES
        assert (1 - similarity**rows) ** bands <= 1e-6


def test_linked_finds_all_components():
    import numpy as np

    from ledgerlens.llm.near_dedup import linked

    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(30), r.randrange(15, 28))), np.uint64) for _ in range(80)]
    root = list(range(80))
    for a in range(80):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = root[a], root[b]
                root = [min(p, q) if v in (p, q) else v for v in root]
    want = {frozenset(i for i in range(80) if root[i] == c) for c in set(root)}
    assert {frozenset(g) for g in linked(sets, 75, 100)} == want


def test_packing_holds_every_id_once(docs, rows, empty):
    from ledgerlens.llm.packing import pack
    from ledgerlens.llm.tokenizers import byte_bpe

    library = byte_bpe("byte_bpe_50k.json")
    import numpy as np

    ids = {x[0]: np.array([*library.encode(x[1] or "", add_special_tokens=False).ids, 0], "<u4") for x in rows}
    copies = Counter(x[0] for x in rows)
    got = pack(docs).collect()
    by_sequence, by_doc = {}, {}
    for g in got:
        assert g.doc_tokens == len(ids[g.doc_id])
        assert g.ids_crc32 == zlib.crc32(ids[g.doc_id][g.start : g.start + g.length].tobytes())
        by_sequence.setdefault(g.sequence_id, []).append((g.offset, g.length))
        by_doc.setdefault(g.doc_id, []).append((g.start, g.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for doc, pieces in by_doc.items():
        covered = Counter(i for start, length in pieces for i in range(start, start + length))
        assert covered == dict.fromkeys(range(len(ids[doc])), copies[doc])
    fills = [sum(n for _, n in p) for p in by_sequence.values()]
    assert sum(f < 1024 for f in fills) <= docs.rdd.getNumPartitions()
    assert pack(empty).count() == 0


def test_sum_of_squares_takes_the_least_change():
    import numpy as np

    from ledgerlens.llm.packing import SumOfSquares

    r = random.Random(3)
    packer, size = SumOfSquares(40), 40
    for i in range(400):
        length = r.randrange(1, size)
        change = {}
        for level in range(size - length + 1):
            if level and not packer.count[level]:
                continue
            after = packer.count.copy()
            after[level] -= level > 0
            if level + length < size:
                after[level + length] += 1
            change[level] = int((after[1:] ** 2).sum() - (packer.count[1:] ** 2).sum())
        best = min(change.values())
        assert packer.level_for(length) == max(k for k, v in change.items() if v == best)
        list(packer.place((i, 0, length, np.zeros(length, "<u4"))))


def test_sum_of_squares_keeps_few_windows_open():
    import numpy as np

    from ledgerlens.llm.packing import SumOfSquares

    r = random.Random(5)
    packer, size, items, out = SumOfSquares(40, most=6), 40, {}, []
    for i in range(500):
        items[i] = np.arange(r.randrange(1, size), dtype="<u4")
        filled = list(packer.place((i, 0, len(items[i]), items[i])))
        assert all(sum(len(p[3]) for p in w) == size for w in filled)
        out += filled
        assert packer.n_open == packer.count.sum() == sum(map(len, packer.open))
        assert packer.n_open <= 6
    by_rule = len(out)
    out += packer.dissolve()
    assert len(out) - by_rule <= 6 and [sum(len(p[3]) for p in w) for w in out[:-1]] == [size] * (len(out) - 1)
    pieces = {}
    for doc, start, _, ids in (p for w in out for p in w):
        pieces.setdefault(doc, []).append((start, ids))
    for i, ids in items.items():
        assert np.concatenate([x for _, x in sorted(pieces[i], key=lambda p: p[0])]).tolist() == ids.tolist()


def test_byte_bpe_ids_are_the_librarys():
    from ledgerlens.llm.tokenizers import byte_bpe, byte_bpe_ids

    library = byte_bpe("byte_bpe_50k.json")
    r = random.Random(8)
    texts = ["", "a<|endoftext|>b", " \n \n  x   y\t\tz  ", "I'm we'll 'S '", "\x1c\x1d a\x00b", "\xa0\xa0x \x85", "½ ² ª", "日本語 text", "a" * 9000]
    texts += ["".join(r.choice(" \n'ab1é.ÿ") for _ in range(50)) for _ in range(300)]
    for text in texts:
        assert byte_bpe_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, empty, tmp_path):
    from ledgerlens.llm.token_counts import token_counts
    from ledgerlens.llm.tokenizers import sentence_pieces

    library = sentence_pieces("piece_bpe_32k.model")
    want = sorted((x[0], len((x[1] or "").encode()), len(library.encode(x[1] or ""))) for x in rows)
    cache = str(tmp_path / "cache")
    stored = lambda: docs.sparkSession.read.option("recursiveFileLookup", "true").parquet(cache).count()
    for _ in range(2):  # the second time from the cache
        got = token_counts(docs, limit=100, cache_path=cache).collect()
        assert sorted((g.doc_id, g.n_bytes, g.n_tokens) for g in got) == want
        assert all(g.over_limit == (g.n_tokens > 100) for g in got)
        assert stored() == len({x[1] or "" for x in rows})
    other = token_counts(docs, "byte_bpe_50k.json", cache_path=cache)
    assert other.count() == len(rows)
    assert stored() == 2 * len({x[1] or "" for x in rows})
    assert token_counts(empty).count() == 0


def test_token_counts_of_more_misses_than_are_broadcast(docs, rows, tmp_path, monkeypatch):
    from ledgerlens.llm import skew, token_counts
    from ledgerlens.llm.tokenizers import sentence_pieces

    monkeypatch.setattr(token_counts, "MISSES_MOST", 3)
    monkeypatch.setattr(skew, "HOT", 20)  # the exact copies are a hot text
    library = sentence_pieces("piece_bpe_32k.model")
    cache = str(tmp_path / "cache")
    token_counts.token_counts(docs.filter("doc_id < 20"), cache_path=cache)
    got = token_counts.token_counts(docs, cache_path=cache).collect()
    assert sorted((g.doc_id, g.n_tokens) for g in got) == sorted((x[0], len(library.encode(x[1] or ""))) for x in rows)


def test_language_id(docs, rows, empty):
    from ledgerlens.llm.language_id import held_out, identify

    got = {g.doc_id: g for g in identify(docs).withColumn("held_out", held_out()).collect()}
    for x in rows:
        g = got[x[0]]
        assert g.held_out == (zlib.crc32(str(x[0]).encode()) % 3 == 1)
        assert 0 <= g.score <= 1
        if not re.search(r"[^\W\d_]", x[1] or ""):
            assert (g.lang_pred, g.score, g.rejected) == ("und", 0.0, True)
        else:
            assert g.lang_pred in ("de", "en")
    judged = [x for x in rows if x[2] and got[x[0]].held_out and len(x[1]) > 40 and x[0] < 37]
    assert sum(got[x[0]].lang_pred == x[2] for x in judged) / len(judged) > 0.85
    assert identify(empty).count() == 0
    unlabelled = identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang = 'x' OR doc_id < 4").drop("lang").selectExpr("*", "CAST(null AS string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_license_scan(spark, docs, rows, empty):
    from ledgerlens.llm.license_scan import LICENSES, NOTICES, known_digests, scan

    texts = [
        LICENSES["MIT"],
        LICENSES["MIT"].replace("<year> <holders>", "2021 Someone Else").replace('"', "'").upper(),
        LICENSES["ISC"].replace(" ", "  "),
        LICENSES["Zlib"] + " more",
        "some code\n  RELEASED under the M.I.T. licence\nReleased under the MIT Licence!\nreleased under the mit license.",
        None,
        "...",
    ]
    given = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, license_id string, notices string")
    known = known_digests(spark, {k: [v] for k, v in LICENSES.items()}), known_digests(spark, NOTICES)
    got = {g.doc_id: g for g in scan(given, *known).collect()}
    assert [got[i].license_id for i in range(7)] == ["MIT", "MIT", "ISC", None, None, None, None]
    assert (got[4].n_notice_lines, got[4].notices) == (2, "MIT")
    assert got[5].text_digest is None and got[5].n_notice_lines == 0
    assert got[6].text_digest == hashlib.sha256(b"").hexdigest()
    assert scan(docs, *known).count() == len(rows)
    assert scan(empty, *known).count() == 0


def test_licenses_however_wrapped_and_titled(spark):
    import textwrap

    from ledgerlens.llm.license_scan import LICENSES, NOTICES, known_digests, known_forms, scan

    known = known_digests(spark, known_forms()), known_digests(spark, NOTICES)
    holder = lambda text: text.replace("<year> <holders>", "2021 Someone Else")
    wrap = lambda text, width: "\n\n".join(p if p.strip().startswith("Copyright") else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
    cases = [("ISC", "Permission" + holder(LICENSES["ISC"]).partition("Permission")[2].replace("above copyright", "above\ncopyright"))]
    for name, forms in known_forms().items():
        cases += [(name, form) for form in forms]
        # an attribution is a line of its own, as is the GPL's; the appendices have them within paragraphs
        whole = [forms[-1].replace("<https://fsf.org/>\n", "<https://fsf.org/>\n\n")] if "END OF TERMS" in forms[0] else forms[:2]
        cases += [(name, wrap(holder(form), width)) for form in whole for width in (44, 60, 72, 79, 100_000)]
    cases += [("MIT", holder(LICENSES["MIT"]).replace("MIT License", "The MIT License (MIT)").replace("Copyright (c)", line)) for line in ("Copyright", "(C)", "© ", "Copyright: Jane Doe,", "Copyright The Authors")]
    cases += [(None, LICENSES["MIT"] + "\ncopyright notice of another kind"), (None, known_forms()["GPL-3.0"][0].replace("version", "edition"))]
    docs = spark.createDataFrame(list(enumerate(text for _, text in cases)), "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in scan(docs, *known).collect()}
    assert [(i, got[i], text[:80]) for i, (name, text) in enumerate(cases) if got[i] != name] == []


def test_license_blocks_inside_texts(spark, tmp_path):
    import duckdb

    from ledgerlens.llm.license_scan import LICENSES, OP4_SQL, known_forms, op4_license_scan

    forms = known_forms()
    mit = LICENSES["MIT"].replace("<year> <holders>", "2020 A. Person")
    texts = [
        "A readme of some words.\n\n" + mit + "\n\ncode follows here",
        "/*\n * " + mit.replace("\n", "\n * ") + "\n */\n\nint main;",
        mit + "\n\n" + forms["Apache-2.0"][0] + "\n\nLicensed under the MIT Licence.",
        forms["LGPL-3.0"][0] + "\n----\n" + forms["CC0-1.0"][0],
        forms["GPL-2.0"][-1], forms["LGPL-2.1"][0],
        mit.replace("without restriction", "with restrictions"), mit.rpartition("\n\n")[0],
        "", None, "...", LICENSES["Zlib"] + " more",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in op4_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i].block_licenses for i in range(12)] == ["MIT", "MIT", "Apache-2.0,MIT", "CC0-1.0,LGPL-3.0", "GPL-2.0", "LGPL-2.1", None, None, None, None, None, None]
    assert [got[i].license_id for i in range(12)] == [None, None, None, None, "GPL-2.0", "LGPL-2.1"] + [None] * 6
    assert got[2].notices == "MIT"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = "doc_id, text_digest, license_id, block_licenses, n_notice_lines, notices"
    assert sorted(map(tuple, op4_license_scan(spark, str(tmp_path)).select(*columns.split(", ")).collect())) == sorted(con.execute(f"SELECT {columns} FROM ({OP4_SQL})").fetchall())


def test_piece_codec(docs, rows, empty):
    from ledgerlens.llm.piece_codec import decode, encode, encode_digests
    from ledgerlens.llm.tokenizers import sentence_pieces

    library = sentence_pieces("piece_bpe_32k.model")
    encoded = encode(docs)
    got = sorted((g.doc_id, g.ids) for g in encoded.collect())
    assert got == sorted((x[0], library.encode(x[1] or "")) for x in rows)
    assert sorted((g.doc_id, g.text) for g in decode(encoded).collect()) == sorted((x[0], library.decode(library.encode(x[1] or ""))) for x in rows)
    digests = encode_digests(docs).collect()
    assert all(g.round_trip for g in digests) and len(digests) == len(rows)
    assert encode(empty).count() == 0


def test_piece_codec_on_random_texts():
    from ledgerlens.llm.piece_codec import Encoder, load
    from ledgerlens.llm.tokenizers import sentence_pieces

    library, r = sentence_pieces("piece_bpe_32k.model"), random.Random(5)
    texts = ["▁x ▁▁ y", "  a   b ", "<s> <0x0A>", "🎉 ok", "a" * 3000]
    texts += ["".join(r.choice("abcdeinrst  aeiou\néñ1.,") for _ in range(60)) for _ in range(800)]
    encoder = Encoder(load("piece_bpe_32k.model"))
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert encoder.model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_unigram_words_have_the_best_score():
    """Every segmentation of short words, over the file's pieces with other scores."""
    from sentencepiece import sentencepiece_model_pb2

    from ledgerlens.llm.piece_codec import PieceModel
    from ledgerlens.llm.tokenizers import path

    model, r = sentencepiece_model_pb2.ModelProto(), random.Random(6)
    with open(path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = -r.random() * 12
    unigram = PieceModel(model.SerializeToString())
    words = ["▁" + "".join(r.choice("theandirs") for _ in range(r.randrange(1, 8))) for _ in range(100)]

    def best(word):
        return max((unigram.score[word[:i]] + (best(word[i:]) if i < len(word) else 0) for i in range(1, len(word) + 1) if word[:i] in unigram.score), default=-1e18)

    import numpy as np

    for word, ids in unigram.encode_words(list(set(words))).items():
        pieces = [unigram.names[i] for i in np.frombuffer(ids, "<u4")]
        assert "".join(pieces) == word
        assert abs(sum(unigram.score[p] for p in pieces) - best(word)) < 1e-6


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline
    from ledgerlens.llm.tokenizers import byte_bpe

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append(now)
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_id = {x[0]: x for x in rows}
    letters = {x[0] for x in rows if re.search(r"[^\W\d_]", x[1] or "")}
    first = {r.doc_id for r in kept[0].collect()}
    assert first <= letters
    assert all(r.text == by_id[r.doc_id][1] for r in kept[0].collect())
    want = _components([x for x in rows if x[0] in first], 5, 80)
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted({c for _, c in want.values()})
    assert all(r.text == by_id[r.doc_id][1] for r in kept[1].collect())
    # texts after the third stage, by brute force over what the second kept
    words = {r.doc_id: WORD.findall(r.text) for r in kept[1].collect()}
    starts = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    texts = {}
    for doc, w in words.items():
        gone = {j for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        texts[doc] = " ".join(v for i, v in enumerate(w) if i not in gone) if gone else by_id[doc][1]
    assert {r.doc_id: (r.text, r.n_chars) for r in kept[2].collect()} == {d: (t, len(t)) for d, t in texts.items()}
    assert any(t != by_id[d][1] for d, t in texts.items())
    import numpy as np

    library, lengths = byte_bpe("byte_bpe_50k.json"), Counter()
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    for r in kept[3].collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(x) for d, x in ids.items()}


def test_pipeline_rows_without_or_with_one_doc_id(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(40))
    given = [(1, long, "a"), (2, long, "b"), (None, long, "c"), (None, long, "c"), (None, long, "d"), (3, "first text of three", "e"), (3, "second text of three", "f"), (4, None, "g")]
    docs = spark.createDataFrame([(i, t, "en", s, 5) for i, t, s in given], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = sorted((r.doc_id or 0, r.source) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(parts), "").collect())
        assert got[:3] == [(0, "c"), (0, "d"), (1, "a")] and got[4:] == [(4, "g")] and got[3][0] == 3
        assert got == (first := got if parts == 1 else first)
