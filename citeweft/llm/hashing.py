"""Word hashes in numpy for the operators that read texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class WordHashes(dict):
    """word -> 64-bit hash, worked out when first asked for; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case. bytes.split() parts at ASCII white space only, which is the rule."""
    return text.lower().split() if text else []


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """A string column's values as UTF-8, one at a time."""
    for x in column.cast(pa.binary()):
        yield x.as_py()


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a sequence of word hashes; all of it as one where it is shorter."""
    n = len(h)
    if not n:
        return h
    if n < width:
        acc = np.array([n], U)
        for x in h:
            acc = mix64(acc * U(0x9E3779B97F4A7C15) + x)
        return acc
    acc = h[: n - width + 1].copy()
    for k in range(1, width):
        acc *= U(0x9E3779B97F4A7C15)
        acc += h[k : n - width + 1 + k]
    s = mix64(acc)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if n > width else s
