"""Words and their shingles as 64-bit hashes, alike in every process."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: Words a worker remembers the hash of.
REMEMBERED = 300_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULT[3]
    h = (h ^ (h >> np.uint64(29))) * _MULT[4]
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str, memory: dict[str, int]) -> np.ndarray:
    """Hashes of the lower-cased words of the whole text, in order."""
    words = WORD.findall(text.lower())
    try:
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    except KeyError:
        new = {w: xxhash.xxh64_intdigest(w) for w in set(words) if w not in memory}
        if len(memory) + len(new) <= REMEMBERED:
            memory.update(new)
            return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        return np.fromiter((new[w] if w in new else memory[w] for w in words), np.uint64, len(words))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words. A text of fewer words has one run, of all its words; one without words has none."""
    if not len(words):
        return words
    n_own = min(n, len(words))
    out = np.full(len(words) - n_own + 1, np.uint64(n_own))
    for j in range(n_own):
        out = out * _MULT[0] + mixed(words[j : len(words) - n_own + 1 + j] + _MULT[j % 8])
    return np.unique(mixed(out))
