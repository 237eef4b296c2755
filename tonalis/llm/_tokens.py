"""Byte-level BPE ids from the public vocabulary, quickly and without building anything by row.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` and add_special_tokens=False: the
end-of-text string inside a text is the special id. (``ordinary_ids`` reads it as plain text.)
The vocabulary exists as ranks for ``tiktoken`` as well, which gives the same ids several times
faster; a test holds one against the other.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

#: Two white-space characters side by side: only then does the look-ahead in the pattern matter.
_DOUBLE = re.compile(r"\s\s")
#: The special string of the vocabulary; its id follows the ranks.
SPECIAL = "<|endoftext|>"
_CACHE: dict[tuple[str | None, str], Encoder] = {}


class Encoder:
    def __init__(self, path: str | None = None, pattern: str | None = None):
        """path: the ``.tiktoken`` ranks file (default: the installed byte_bpe_50k); pattern: its pre-token pattern."""
        import tiktoken

        if path is None or pattern is None:
            import public_tokenizers

            path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.special < 1 << 16 else "<u4")
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def ordinary_ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        e = self.full if _DOUBLE.search(text) else self.plain
        return np.frombuffer(array("H" if self.dtype.itemsize == 2 else "I", e.encode_ordinary(text)), self.dtype)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return self.ordinary_ids(text)
        between = np.array([self.special], self.dtype)
        return np.concatenate([x for piece in text.split(SPECIAL) for x in (between, self.ordinary_ids(piece))][1:])


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder per worker process."""
    key = (path, pattern or "")
    if key not in _CACHE:
        _CACHE[key] = Encoder(path, pattern)
    return _CACHE[key]
