"""Word and shingle hashes of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .winnow import join, mix

#: Words whose hashes one worker keeps.
CACHE = 300_000


class WordHashes:
    """64-bit hashes of the words of a text: A-Z lower-cased, split at \\x20 and \\x09-\\x0D."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        seen = self.seen
        words = text.lower().split()
        found = [seen.get(w) for w in words]
        if None in found:
            if len(seen) > CACHE:
                seen.clear()
            for i, w in enumerate(words):
                if found[i] is None:
                    found[i] = seen[w] = xxhash.xxh64_intdigest(w)
        return np.array(found, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k words in a row, sorted; of fewer words the whole sequence is one."""
    if not len(words):
        return words
    size = min(k, len(words))
    out = mix(words[: len(words) - size + 1] ^ np.uint64(size))
    for i in range(1, size):
        out = join(out, words[i : len(words) - size + 1 + i])
    return np.unique(out)
