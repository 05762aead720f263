"""Exact encoded length of texts under a public byte-level BPE vocabulary, without special tokens.

The vocabulary's path is a parameter; its file stays where it is. A null or empty text has length 0.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, Callable[[str | None], int]] = {}


def lengths(vocabulary: str = VOCABULARY) -> Callable[[str | None], int]:
    """The worker's own counter; a vocabulary is loaded once for each worker."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _LOADED[vocabulary] = lambda text: len(encode(text)) if text else 0
    return _LOADED[vocabulary]
