"""Byte-level BPE of the public vocabulary, loaded once per Python worker.

``tiktoken`` runs the vocabulary's rank file, which yields the same ids as the
``tokenizers`` file of the same vocabulary (tests compare them) several times
faster. The strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k"


class Encoder:
    def __init__(self, name: str):
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        """Bytes of each token."""
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Ids of a whole text (null: empty), with ``end`` after them if given, as little-endian uint32."""
        ids = self._encode(text) if text else []
        if end is not None:
            ids.append(end)
        return np.array(ids, "<u4")


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> Encoder:
    return Encoder(name)
