"""Encoding against the library: long words, models with scores, character maps and unknown letters."""

import random

import pytest

TEXTS = ["", "  a   b ", "the house and the other river", "ﬁve ｆｕｌｌ width Å", "日本語 🎉🎉 ok", "xyz" * 30, "\n\ttabs and\nlines", "▁x ▁▁ y"]


def _proto():
    from sentencepiece import sentencepiece_model_pb2

    from ledgerlens.llm.tokenizers import path

    model = sentencepiece_model_pb2.ModelProto()
    with open(path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    return model


def _texts(seed, n):
    r = random.Random(seed)
    return TEXTS + ["".join(r.choice("abcdeinrst  aeiou\néñ1.,日") for _ in range(60)) for _ in range(n)]


def _unigram(seed=6):
    """The file's pieces as a unigram model whose sums are exact in single precision, so that ties are ties."""
    model, r = _proto(), random.Random(seed)
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.type == 1:
            piece.score = -r.randrange(8, 96) / 8
    return model


def _agree(proto, texts):
    import sentencepiece

    from ledgerlens.llm.piece_codec import Encoder, PieceModel

    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=proto), Encoder(PieceModel(proto))
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert encoder.model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_scored_models_give_the_librarys_ids():
    _agree(_unigram().SerializeToString(), _texts(1, 800))


@pytest.mark.parametrize("kind", [1, 2])
def test_unknown_letters_without_byte_fallback(kind):
    model = _unigram() if kind == 1 else _proto()
    model.trainer_spec.byte_fallback = False
    for piece in model.pieces:
        if piece.type == 6:
            piece.type = 3
    _agree(model.SerializeToString(), _texts(2, 200))


def test_character_maps():
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    mapped = sentencepiece_model_pb2.ModelProto()
    mapped.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    for model in (_unigram(), _proto()):
        model.normalizer_spec.precompiled_charsmap = mapped.normalizer_spec.precompiled_charsmap
        _agree(model.SerializeToString(), _texts(3, 200))


def test_words_of_any_length_take_linear_memory():
    import tracemalloc

    from ledgerlens.llm.piece_codec import load
    from ledgerlens.llm.tokenizers import sentence_pieces

    model, library, r = load("piece_bpe_32k.model"), sentence_pieces("piece_bpe_32k.model"), random.Random(4)
    word = "".join(r.choice("abcdefghij日本") for _ in range(200_000))
    model.encode_words(["▁" + word[:2000]])
    tracemalloc.start()
    ids = model.encode_words(["▁" + word])["▁" + word]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    import numpy as np

    assert np.frombuffer(ids, "<u4").tolist() == library.encode(word)
