"""Byte-pair ids of whole texts by an installed public vocabulary.

The ids equal the ``tokenizers`` library's for the same vocabulary; its ranks
file is read by ``tiktoken``, which is several times as fast. Its splitting runs out of stack in very long white
space, so texts with such a run go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.tiktoken"
END = "<|endoftext|>"
#: Characters of white space in a row that are left to ``tokenizers``; ``tiktoken`` fails beyond some 500,000.
LONG_SPACE = 100_000

_encoders: dict = {}


def whole(name: str):
    """The vocabulary in the ``tokenizers`` library, loaded once per worker that needs it."""
    if name not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoders[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _encoders[name]


def spacious(text: str) -> bool:
    return len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text))


def encoder(name: str):
    """The vocabulary, loaded once per worker."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
    return _encoders[name]


def ids_of(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """The ids as little-endian unsigned 32-bit numbers; the end mark's string is the end mark."""
    if not text:
        return np.zeros(0, "<u4")
    if spacious(text):
        return np.array(whole(os.path.splitext(name)[0] + ".json").encode(text, add_special_tokens=False).ids, "<u4")
    return encoder(name).encode_to_numpy(text, allowed_special={END}, disallowed_special=()).astype("<u4", copy=False)
