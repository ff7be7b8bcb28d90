"""Byte-level BPE ids of whole texts, as the public vocabulary files define them.

``tiktoken`` and ``tokenizers`` give the same ids for the same vocabulary (a test
holds them against each other); the first is several times as fast.  Its pattern
matcher fails on very long runs of white space, so texts with such a run go to
``tokenizers``.  The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Texts of fewer characters can't have a run of white space that is too long.
LONG = 50_000
_RUN = re.compile(r"\s{20000}")


class Encoder:
    """``vocabulary``: a file of ranks; ``model``: the same vocabulary as a
    ``tokenizers`` file."""

    def __init__(self, vocabulary: str, model: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(ranks.values()) + 1
        self.model = model

    @property
    def slow(self):
        from tokenizers import Tokenizer

        if not hasattr(self, "_slow"):
            self._slow = Tokenizer.from_file(self.model)
            self._slow.encode_special_tokens = True
        return self._slow

    def ids(self, text: str) -> list[int]:
        if len(text) >= LONG and _RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.plain(text)

    def array(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.ids(text), "<u4")


@lru_cache(2)
def encoder(vocabulary: str, model: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(vocabulary, model)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
