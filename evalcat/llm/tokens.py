"""Public tokenizers inside tasks.

A ``tokenizers`` file is applied to every whole text. The files used here are
BPE over pre-tokens that never span certain places (``textcache.Buffer.chunks``),
so a text's ids are the ids of its chunks one after another, and each distinct
chunk goes through the library once while it is kept. Tokenizers of any other
kind get whole texts. ``tests/llm/test_operators.py`` compares both ways.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from evalcat.llm.textcache import ChunkCoder

_BYTE_LEVEL = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
_WORD_WISE = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)"""


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    return tok


class Whole:
    """Every text through the library as it is."""

    def __init__(self, tok):
        self.tok = tok

    def lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.lists(texts)
        flat = [i for g in got for i in g]
        return np.array(flat, np.uint32), np.fromiter(map(len, got), np.int64, len(got))


@lru_cache(maxsize=4)
def coder(path: str):
    """Callable: texts -> (ids of all texts, number of ids of each text)."""
    whole = Whole(load(path))
    if whole.tok.normalizer is None and str(whole.tok.pre_tokenizer) == _BYTE_LEVEL or _WORD_WISE in str(whole.tok.pre_tokenizer):
        return ChunkCoder(whole.lists)
    return whole
