"""Rolling hashes of words and word windows, for whole batches of texts at once.

Words are the pieces between ASCII white space, hashed from their UTF-8 bytes by a
polynomial modulo 2**64 over random byte values; windows of words likewise over the mixed
word hashes.  A prefix sum gives every window's hash by one subtraction (Rabin-Karp)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed together, at some 60 bytes of working memory each; one longer text is
#: hashed alone.
CHUNK_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for at, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, U(b))
            p[0] = 1
            _powers[at] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, text_starts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, without regard to where texts end."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    power, inverse = powers(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(words * power[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def inside(offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n - k + 1 windows lie in one text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return text[: n - k + 1] == text[k - 1 :]


def sliding(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of every w consecutive values."""
    span = 1
    while 2 * span <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if w > span else x
