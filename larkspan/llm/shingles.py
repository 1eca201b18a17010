"""Hashed word shingles of many texts at once, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudorandom odd numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_TERMS = stream(WIDTH + 1, 3)


def normalized(text: str | None) -> bytes:
    """A-Z in lower case, words joined by one blank; words end at the six ASCII white-space characters."""
    return b" ".join((text or "").encode().lower().split())


def digest(norm: bytes) -> bytes:
    return hashlib.blake2b(norm, digest_size=16).digest()


def shingle_hashes(norms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begins): the shingles of text i are hashes[begins[i]:begins[i + 1]], repeats included.

    A text with fewer words than a shingle has one, its whole sequence; without words it has none.
    """
    data = np.frombuffer(b" ".join(norms) + b" ", np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], spaces[:-1] + 1])
    lengths = spaces - starts
    at = np.arange(len(data)) - np.repeat(starts, lengths + 1)
    part = (data.astype(U) + U(1)) * stream(int(lengths.max()) + 1, 1)[at]
    part[spaces] = 0
    sums = np.cumsum(part, dtype=U)
    word = mix(sums[spaces] - np.where(starts > 0, sums[starts - 1], U(0)) + lengths.astype(U))
    # An empty text leaves one empty word behind.
    per_text = np.array([x.count(b" ") + 1 for x in norms], np.int64)
    first = np.concatenate([[0], np.cumsum(per_text)])
    real = np.where(lengths[first[:-1]] > 0, per_text, 0)

    n = len(word)
    windows = np.zeros(max(n - WIDTH + 1, 0), U)
    for k in range(WIDTH):
        windows += word[k : k + len(windows)] * _TERMS[k]
    windows = mix(windows)
    count = np.where(real >= WIDTH, real - WIDTH + 1, np.minimum(real, 1))
    begins = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begins[-1], U)
    long = np.flatnonzero(real >= WIDTH)
    take = np.repeat(first[long] - begins[long], count[long])
    where = np.repeat(begins[long], count[long]) + (np.arange(len(take)) - np.repeat(np.cumsum(count[long]) - count[long], count[long]))
    out[where] = windows[where + take]
    for i in np.flatnonzero((real > 0) & (real < WIDTH)):
        own = word[first[i] : first[i] + real[i]] * _TERMS[: real[i]]
        out[begins[i]] = mix(own.sum(keepdims=True, dtype=U) + _TERMS[WIDTH:] * U(int(real[i])))[0]
    return out, begins


def chunks(items: list[bytes], size: int = 1 << 19):
    """Split a list into runs of about ``size`` bytes: (first, last + 1)."""
    begin = total = 0
    for i, x in enumerate(items):
        total += len(x)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(items):
        yield begin, len(items)
