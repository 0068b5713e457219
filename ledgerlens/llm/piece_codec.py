"""SentencePiece encoding and decoding with a lattice shared by common prefixes.

A text's marked words (a run of word marks and what follows it) are encoded
apart, since no piece has a mark after another character.  The distinct words
of a batch are sorted, which walks their trie depth-first: the forward states
of a word's prefix stay as they are for the next word that shares it, and only
the letters beyond the common prefix are computed.

A prefix's forward state is a few numbers: where its last piece begins, which
piece that is, its best score, and its node in the trie of pieces, whose suffix
links name the pieces that end there, so that no start is tried in vain.  Ids
are read back along the last pieces once a word ends: memory and time grow with
a word's letters, not with their square.

For a unigram model the forward state of a prefix is the best score of its
segmentations (Viterbi).  A BPE model's pieces have ranks instead, whose best
sum isn't what its library returns.  There the state is the last piece of the
prefix's one valid segmentation: a piece that ends a longer prefix is right
when, put behind the last piece of what is before it, merging by rank gives
back those two pieces.  Exactly one piece passes, so the same recursion over the
same lattice is exact.  ``encode`` picks the rule by the model's type.

A model's character map is applied first, by the library's own normaliser.
Characters without a piece become their UTF-8 bytes, or, a run of them, the
unknown id.  Decoding joins pieces, reads runs of bytes as UTF-8 and turns
marks to blanks.

Edge cases: a null or empty text has no ids; texts and words of any length are
encoded whole; repeated rows are encoded each, their words once a task; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizers
from .substring_dedup import slices

MARK = "▁"
CHUNK_BYTES = 8 << 20
WORDS_MOST = 400_000
PAIRS_MOST = 1_000_000
UNKNOWN_PENALTY = 10.0
USER_PENALTY = 0.1
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


class PieceTrie:
    """The trie of all pieces, with a link from each node to its longest proper suffix among the nodes."""

    def __init__(self, pieces: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        parents: list[tuple[int, str]] = [(0, "")]
        at: list[int | None] = [None]
        for piece, i in pieces.items():
            node = 0
            for letter in piece:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    parents.append((node, letter))
                    at.append(None)
                node = self.next[node][letter]
            at[node] = i
        self.suffix = [0] * len(self.next)
        #: the pieces of two letters or more that end at a node, longest first: (letters, id)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        level, depth = [0], 0
        while level:
            for node in level:
                parent, letter = parents[node]
                if depth > 1:
                    self.suffix[node] = self.step(self.suffix[parent], letter)
                own = ((depth, at[node]),) if depth > 1 and at[node] is not None else ()
                self.ends[node] = own + self.ends[self.suffix[node]]
            level, depth = [child for node in level for child in self.next[node].values()], depth + 1

    def step(self, node: int, letter: str) -> int:
        """The node of the longest suffix of (node, letter) that begins a piece."""
        while (to := self.next[node].get(letter)) is None:
            if not node:
                return 0
            node = self.suffix[node]
        return to


class PieceModel:
    """Pieces of a SentencePiece file and the encoding of marked words by them."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("a unigram or BPE model is needed")
        spec = model.normalizer_spec
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.normalise = None
        if spec.precompiled_charsmap:
            from sentencepiece import SentencePieceNormalizer

            self.normalise = SentencePieceNormalizer(model_proto=proto).normalize
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with unescaped blanks or marks as suffixes are not supported")
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        plain = [p.score for p in model.pieces if p.type == NORMAL]
        top, bottom = max(plain, default=0.0), min(plain, default=0.0)
        self.score = {p.piece: len(p.piece.encode()) * top - USER_PENALTY if p.type == USER and self.kind == UNIGRAM else p.score for p in model.pieces if p.type in (NORMAL, USER)}
        self.score_of = [self.score.get(name, 0.0) for name in self.names]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_score = bottom - UNKNOWN_PENALTY
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece has a mark after another character: words can't be encoded apart")
        # a letter without a piece is named by what lies behind all ids
        self.letters = len(self.names)
        self.start = self.letters + 0x110000
        self.width = self.start + 1
        self.memo: dict[int, bool] = {}

    @cached_property
    def trie(self) -> PieceTrie:
        return PieceTrie(self.id)

    def words(self, text: str) -> list[str]:
        """The marked words of a text."""
        if self.normalise:
            marked = self.normalise(text)
        else:
            if self.squeeze:
                text = re.sub(" +", " ", text.strip(" "))
            marked = (MARK if self.dummy and text else "") + text.replace(" ", MARK)
        if marked[:1] == MARK and MARK + MARK not in marked:
            return [MARK + w for w in marked[1:].split(MARK)]
        return _UNITS.findall(marked)

    def merge(self, text: str) -> list[str]:
        """Pieces by merging the neighbours of best rank, the leftmost first, until none merge."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def name(self, piece: int) -> str:
        return self.names[piece] if piece < self.letters else "" if piece == self.start else chr(piece - self.letters)

    def fits(self, before: int, piece: int) -> bool:
        """Whether ``piece`` behind ``before`` (or at the start) stays as it is when merged by rank."""
        if len(self.memo) >= PAIRS_MOST:
            self.memo.clear()
        a, b = self.name(before), self.name(piece)
        fit = self.memo[before * self.width + piece] = self.merge(a + b) == ([a, b] if a else [b])
        return fit

    def ids(self, pieces: list[int]) -> bytes:
        """The ids of pieces and of letters without one, as little-endian 32-bit numbers."""
        if pieces and max(pieces) >= self.letters:
            if self.bytes:
                pieces = [i for p in pieces for i in ([p] if p < self.letters else [self.bytes[b] for b in chr(p - self.letters).encode()])]
            else:
                runs = groupby(pieces, lambda p: p if p < self.letters else -1)
                pieces = [i for p, run in runs for i in ([self.unknown] if p < 0 else run)]
        return np.array(pieces, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct marked words, walking their trie depth-first."""
        step = self._rank_steps if self.kind == BPE else self._score_steps
        out: dict[str, bytes] = {}
        # the state of each prefix of the current word: where its last piece begins, that piece, its trie node, its score
        begin, last, node, best = [0], [self.start], [0], [0.0]
        previous = ""
        for word in sorted(words):
            common, most = 0, min(len(previous), len(word))
            while common < most and previous[common] == word[common]:
                common += 1
            for state in (begin, last, node, best):
                del state[common + 1 :]
            step(word, begin, last, node, best)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end = begin[end]
            out[word] = self.ids(pieces[::-1])
            previous = word
        return out

    def _rank_steps(self, word: str, begin: list[int], last: list[int], node: list[int], best: list[float]) -> None:
        memo, width, ends, step, single = self.memo, self.width, self.trie.ends, self.trie.step, self.id
        for end in range(len(last), len(word) + 1):
            letter = word[end - 1]
            at = step(node[-1], letter)
            for length, piece in ends[at]:
                before = last[end - length]
                fit = memo.get(before * width + piece)
                if self.fits(before, piece) if fit is None else fit:
                    break
            else:
                length, piece = 1, single.get(letter, self.letters + ord(letter))
            begin.append(end - length)
            last.append(piece)
            node.append(at)

    def _score_steps(self, word: str, begin: list[int], last: list[int], node: list[int], best: list[float]) -> None:
        ends, step, single, score_of = self.trie.ends, self.trie.step, self.id, self.score_of
        for end in range(len(last), len(word) + 1):
            letter = word[end - 1]
            at = step(node[-1], letter)
            one = single.get(letter)
            total, size, which = best[end - 1] + (self.unknown_score if one is None else score_of[one]), 1, self.letters + ord(letter) if one is None else one
            for length, piece in reversed(ends[at]):
                score = best[end - length] + score_of[piece]
                if score >= total:  # of equal scores the longest last piece
                    total, size, which = score, length, piece
            begin.append(end - size)
            last.append(which)
            node.append(at)
            best.append(total)

    @cached_property
    def surface(self) -> list[bytes]:
        """What each id decodes to, as bytes."""
        out = []
        for i, (name, kind) in enumerate(zip(self.names, self.kinds, strict=True)):
            if i in self.byte_of:
                out.append(bytes([self.byte_of[i]]))
            elif kind in (NORMAL, USER):
                out.append(name.replace(MARK, " ").encode())
            else:
                out.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy and ids and self.names[ids[0]].startswith(MARK):
            raw = raw[1:]
        return raw.decode(errors="replace")


@lru_cache
def load(name: str) -> PieceModel:
    with open(tokenizers.path(name), "rb") as f:
        return PieceModel(f.read())


class Encoder:
    """Encodes texts, keeping the ids of words met lately: two generations of ``WORDS_MOST`` words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.model.words(t) for t in texts]
        if len(self.known) > WORDS_MOST:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = {w for words in split for w in words if w not in known}
        if before:
            old = new & before.keys()
            known |= {w: before[w] for w in old}
            new -= old
        known |= self.model.encode_words(list(new))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]


@lru_cache
def encoder(name: str) -> Encoder:
    """The Python worker's encoder: words stay known from task to task."""
    return Encoder(load(name))


def _encode(name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = load(name), encoder(name)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch, sizes, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = words.encode(texts)
                columns = {"doc_id": part.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                else:
                    columns["ids_crc32"] = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
                    columns["round_trip"] = pa.array([model.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)])
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of each row."""
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_encode(tokenizer, True), "doc_id long, n_tokens long, ids array<int>")


def encode_digests(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): ids as CRC-32 of their little-endian 32-bit numbers, and whether they decode to the text."""
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_encode(tokenizer, False), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def decode(rows: DataFrame, tokenizer: str = "piece_bpe_32k.model", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in (v.as_py() for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


def op7_piece_codec(spark, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text of ``documents``, and their round trip."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
