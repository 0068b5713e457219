"""Public tokenizers, loaded once in each Python worker."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers

#: Code points and white space on which every implementation of the pattern agrees; other texts go to the reference library.
_PLAIN = re.compile("[\t-\r -~\xa1-\xff]*")
BYTE_BPE_END = "<|endoftext|>"


def path(name: str) -> str:
    """Where the named file lies; a name with a slash is a path already."""
    return name if "/" in name else public_tokenizers.path(name)


@lru_cache
def digest(name: str) -> str:
    """The tokenizer's version: SHA-256 of its file."""
    with open(path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache
def sentence_pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path(name))


@lru_cache
def byte_bpe(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


@lru_cache
def _ranks(name: str):
    import tiktoken

    with open(path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_ids(text: str) -> np.ndarray:
    """The ids that ``byte_bpe_50k.json`` gives, as little-endian unsigned 32-bit numbers.

    The same vocabulary is read as ranks where the text is plain, which is four
    times as fast; any other text goes through the library of the JSON file.
    """
    if _PLAIN.fullmatch(text) and BYTE_BPE_END not in text:
        return np.array(_ranks("byte_bpe_50k.tiktoken").encode_ordinary(text), "<u4")
    return np.array(byte_bpe("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids, "<u4")
