"""Words as TESTDATA.md defines them, their 64-bit fingerprints, and shingles of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: ``str`` word characters without the underscore are exactly letters and numbers.
WORD = re.compile(r"[^\W_]+")
#: Words kept in a worker's fingerprint table before it is emptied.
TABLE_LIMIT = 1 << 20


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, lower-cased; [] for a null text."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a mark, which would split a word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


class Fingerprints(dict):
    """word -> uint64, filled on demand and emptied at TABLE_LIMIT so that memory stays constant."""

    def __missing__(self, word: str) -> int:
        if len(self) >= TABLE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one, in wrap-around arithmetic."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit fingerprint for every run of ``size`` consecutive words, in order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(h[:n])
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out
