"""Keyed uniform draws, many at a time: the same numbers as `functions.draws.keyed_uniform`."""

from __future__ import annotations

import math

import numpy as np

_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), 4, axis=0).ravel()
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_AT_ONCE = 20_000
"""Texts whose state stays in a core's cache."""


def uniforms(seed: int, purpose: str, replicate: int, first: int, count: int) -> np.ndarray:
    """Uniform in (0, 1) of the keys (replicate, first), (replicate, first + 1) and so on."""
    out, done = np.empty(count), 0
    prefix = f"{seed}|{purpose}|{replicate}|".encode()
    while done < count:
        digits = len(str(first + done))  # numbers of one length at a time
        n = min(_AT_ONCE, count - done, 10**digits - (first + done))
        high, low = _md5(_words(prefix, np.arange(first + done, first + done + n), digits), n)
        bits = (high.byteswap().astype(np.uint64) << np.uint64(20)) | (low.byteswap() >> np.uint32(12))
        out[done:done + n] = (bits.astype(np.float64) + 0.5) / 2.0**52
        done += n
    return out


def _words(prefix: bytes, numbers: np.ndarray, digits: int) -> list:
    """The sixteen words of each padded text, prefix and number; a word that all share is a plain number."""
    size = len(prefix) + digits
    if size > 55:
        raise ValueError("a key has to fit into one block")
    text: list = [*prefix, *[0] * digits, 128, *[0] * (63 - size)]
    for k in range(size - 1, len(prefix) - 1, -1):
        numbers, last = np.divmod(numbers, 10)
        text[k] = last.astype(np.uint32) + np.uint32(48)
    words = []
    for i in range(0, 56, 4):
        fixed = sum(c << 8 * k for k, c in enumerate(text[i:i + 4]) if isinstance(c, int))
        varied = [c << np.uint32(8 * k) for k, c in enumerate(text[i:i + 4]) if not isinstance(c, int)]
        words.append(sum(varied, np.uint32(fixed)) if varied else fixed)
    return [*words, 8 * size, 0]


def _md5(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests."""
    a, b, c, d = (np.full(n, v) for v in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(b, t, out=t)
            np.bitwise_xor(d, t, out=t)
            word = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(d, t, out=t)
            np.bitwise_xor(c, t, out=t)
            word = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
            word = words[(3 * i + 5) % 16]
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(b, t, out=t)
            np.bitwise_xor(c, t, out=t)
            word = words[7 * i % 16]
        np.add(t, a, out=t)
        if isinstance(word, int):
            np.add(t, np.uint32((_ADDED[i] + word) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, word, out=t)
            np.add(t, np.uint32(_ADDED[i]), out=t)
        np.left_shift(t, _TURNS[i], out=u)
        np.right_shift(t, np.uint32(32) - _TURNS[i], out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=t)
        a, d, c, b, t = d, c, b, t, a
    return a + _START[0], b + _START[1]
