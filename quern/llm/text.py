"""Words and word windows of whole texts as 64-bit hashes, in numpy.

All functions are exact functions of the bytes: equal words or windows have equal hashes in every
process. Unequal ones collide with a chance near 2**-62 a pair.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer text is cut at white space.
PIECE = 1 << 19
_M64 = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_IN_WORD = bytes(1 - _SPACE.astype(np.uint8))
_LOWERED = bytes(range(256)).lower()
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time.
_NEAR = 64
_BASE = 0xD6E8FEB86659FD93
_tables: dict[str, np.ndarray] = {}


def _table(name: str, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        base = _BASE if name == "power" else pow(_BASE, -1, 1 << 64)
        _tables[name] = _powers(base, max(n, PIECE + 1))
    return _tables[name]


def _far(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of any length, by sums over all bytes before them."""
    data = np.frombuffer(text, np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _table("power", len(data))[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _table("inverse", len(data))[starts]


def _piece(text: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.frombuffer(b"\0" + text.translate(_IN_WORD) + b"\0", bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    held = (text.translate(_LOWERED) if fold else text) + bytes(16)
    eight = np.ndarray(len(text) + 9, "<u8", held, strides=(1,))
    length = ends - starts
    got = mixed((eight[starts] & _KEPT[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(_ODD))
    more, at = np.flatnonzero(length > 8), 8
    while more.size and at < _NEAR:
        got[more] = mixed(got[more] + (eight[starts[more] + at] & _KEPT[np.minimum(length[more] - at, 8)]) * np.uint64(_BASE))
        at += 8
        more = more[length[more] > at]
    if more.size:
        got[more] = mixed(got[more] ^ _far(held, starts[more], ends[more]))
    return got, starts, ends


def word_hashes(text: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of the words between the six ASCII white-space characters.

    fold: A-Z count as a-z.
    """
    if len(text) <= PIECE:
        return _piece(text, fold)
    data = np.frombuffer(text, np.uint8)
    found, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and not _SPACE[data[to]]:  # a word longer than a piece makes a longer piece
            gap = np.flatnonzero(_SPACE[data[to : to + PIECE]])
            to = to + int(gap[0]) if len(gap) else min(to + PIECE, len(data))
        h, s, e = _piece(text[at:to], fold)
        found.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each of the texts that lie one behind another in data; at: where they start, then the end."""
    word = np.frombuffer(data.tobytes().translate(_IN_WORD), bool)
    first = word.copy()
    first[1:] &= ~word[:-1]
    start = at[:-1][at[:-1] < at[1:]]
    first[start] = word[start]
    return np.diff(np.searchsorted(np.flatnonzero(first), at))


def windows(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of k consecutive words, by doubling: log2(k) passes."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    left, right = np.uint64((_ODD * (2 * seed + 1)) & _M64), np.uint64((_BASE * (2 * seed + 3)) & _M64)
    have, width, power, span = None, 0, mixed(words ^ left), 1
    while True:
        if k & span:
            have, width = (power, span) if have is None else (mixed(have[: len(have) - span] * left + power[width:][: len(have) - span] * right), width + span)
        if span * 2 > k:
            return have[: len(words) - k + 1]
        power = mixed(power[: len(power) - span] * left + power[span:] * right)
        span *= 2


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values the place of the smallest, the leftmost of equal ones."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    place, span = np.arange(len(x)), 1
    low = x
    while span * 2 <= w:
        second = low[span:] < low[: len(low) - span]
        place = np.where(second, place[span:], place[: len(place) - span])
        low = x[place]
        span *= 2
    rest = w - span
    if rest:
        second = low[rest:][:n] < low[:n]
        place = np.where(second, place[rest:][:n], place[:n])
    return place[:n]
