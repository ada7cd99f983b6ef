"""MD5 of many short messages of one length at once, in numpy."""

from __future__ import annotations

from math import sin

import numpy as np

#: Bytes of a message that leaves room for its end mark and length in one block.
ONE_BLOCK = 55
ADDED = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
PLACES = [(1, 0), (5, 1), (3, 5), (7, 0)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages at a time: what a step reads and writes stays in the cache.
LANES = 1 << 14


def md5(heads: np.ndarray, tail: bytes) -> np.ndarray:
    """Digests of each row of bytes followed by ``tail``, at most ``ONE_BLOCK`` bytes together, as rows of four words."""
    out = np.empty((len(heads), 4), "<u4")
    for at in range(0, len(heads), LANES):
        out[at : at + LANES] = _block(heads[at : at + LANES], tail)
    return out


def _block(heads: np.ndarray, tail: bytes) -> np.ndarray:
    n, size = heads.shape
    message = np.zeros((n, 64), np.uint8)
    message[:, :size] = heads
    rest = tail + b"\x80"
    message[:, size : size + len(rest)] = np.frombuffer(rest, np.uint8)
    message[:, 56:] = np.frombuffer((8 * (size + len(tail))).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(message.view("<u4").T).astype(np.uint32, copy=False)
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        k = i // 16
        if k == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        by, first = PLACES[k]
        f += a
        f += words[(by * i + first) % 16]
        f += ADDED[i]
        turn = TURNS[k][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a  # the array of the old a is free
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), START, strict=True)], 1)
