"""64-bit hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE, _BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_LENGTH = np.uint64(0xA0761D6478BD642F)
#: Powers for texts of so many bytes are kept.
_KEPT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _made(n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE))


@cache
def _kept() -> tuple[np.ndarray, ...]:
    return _made(_KEPT)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte, end and hash of each word, first word of each text and the end); words stand between ASCII white space."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    bound = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    if not len(start):
        return data, start, end, np.empty(0, np.uint64), bound
    power, inverse = _kept() if len(data) <= _KEPT else _made(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    return data, start, end, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _LENGTH), bound
