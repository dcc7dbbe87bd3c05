"""Adaptive context-mixing range coder for token ids: blocks on their own, many lanes of a block in step.

Each block starts from the same fixed state, so it decodes alone; its ids' CRC-32 is kept beside it.
A block is cut into lanes of consecutive ids, and numpy works on one id of every lane at a time. All
lanes of a block share one adaptive model, which fits the processor's cache and learns from all of them.
For every id four predictions are mixed: the id that last followed the two before it (order 2), the id
that last followed the one before it (order 1), the block's counts of ids (order 0), and all ids alike
for one that is new. How much each may say depends on how often both contexts were right so far, by
counts of what came true; order 0 follows at the steps where _refreshed says. The mixture drives a
range coder of 64 bits with 32-bit output words and carries, a range of its own for every lane.
"""

from __future__ import annotations

import zlib

import numpy as np

LIMIT = 1 << 16  # ids are below
#: Lanes of a block at most, and ids of a lane at least where there are several.
LANES, LEAST = 2048, 256
#: Bits of a prediction's weight, and of a count in the order-0 table.
_WEIGHT, _COUNT = 12, 16
_TOTAL = _WEIGHT + _COUNT
_BITS2 = 17
_WORD, _NARROW = np.uint64(32), np.uint64(1 << 32)
_SHIFT, _MOST = np.uint64(_TOTAL), np.uint64((1 << _TOTAL) - 1)
#: Steps between new weights, and between new order-0 tables once a block has run for as long.
_REWEIGH, _RECOUNT = 16, 64


class BadBlock(ValueError):
    """A block whose ids do not have its checksum."""


def _refreshed(t: int) -> bool:
    """Whether order 0 counts anew before step t: at each power of two, then every _RECOUNT steps."""
    return t % _RECOUNT == 0 if t >= _RECOUNT else t & (t - 1) == 0


class _Model:
    """Adaptive state of one block with n lanes."""

    def __init__(self, n: int, highs: int):
        self.size = highs << 8
        self.t1, self.t2 = np.zeros(LIMIT, np.int64), np.zeros(1 << _BITS2, np.int64)  # id, and how often it was right above its 16 bits
        self.p1, self.p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.came = np.tile(np.array([4, 2, 8, 8], np.int64), 32)
        self.counts = np.zeros(self.size, np.int64)
        # entry `size` stands for an id that a context named: it needs no count
        self.f, self.c = np.ones(self.size + 1, np.uint64), np.arange(self.size + 1, dtype=np.uint64)
        self.f[-1], self.c[-1] = 1 << _COUNT, 0
        self.kind = np.full(self.size, 3, np.int64)
        self.slot = np.zeros(1 << _COUNT, np.int64)
        self.reweigh()

    def reweigh(self) -> None:
        came = self.came.reshape(32, 4)
        weight = 1 + came * ((1 << _WEIGHT) - 4) // came.sum(1)[:, None]
        weight[:, 2] += (1 << _WEIGHT) - weight.sum(1)
        before = np.cumsum(weight, 1) - weight
        self.weight, self.before = weight.ravel().astype(np.uint64), (before.ravel() << _COUNT).astype(np.uint64)
        self.event = None

    def events(self) -> np.ndarray:
        """What a value says, by context: the place of the prediction that came true."""
        if self.event is None:
            self.event = np.repeat(np.tile(np.arange(4), 32), self.weight.astype(np.int64))
        return self.event

    def recount(self, ids: np.ndarray) -> None:
        """Take the ids since the last time into the order-0 table."""
        if not ids.size:
            return
        self.counts += np.bincount(ids.ravel(), minlength=self.size)
        seen = np.flatnonzero(self.counts)
        held = self.counts[seen]
        share = 1 + held * ((1 << _COUNT) - len(seen)) // held.sum()
        share[held.argmax()] += (1 << _COUNT) - share.sum()
        self.f[seen], self.c[seen], self.kind[seen] = share, np.cumsum(share) - share, 2
        self.slot = np.repeat(seen, share)

    def predict(self):
        """The ids that both contexts name, and the place of the first of the four weights."""
        self.i2 = (self.p1 * 40503 ^ self.p2 * 30011) & ((1 << _BITS2) - 1)
        self.e2, self.e1 = self.t2.take(self.i2), self.t1.take(self.p1)
        a, b = self.e2 & 0xFFFF, self.e1 & 0xFFFF
        at = (self.e2 >> 16 << 4) + (self.e1 >> 16 << 2)
        at += (a == b) * 64
        return a, b, at

    def update(self, x: np.ndarray, right2: np.ndarray, right1: np.ndarray, came: np.ndarray) -> None:
        self.t2[self.i2] = x + (np.minimum((self.e2 >> 16) + 1, 3) * right2 << 16)
        self.t1[self.p1] = x + (np.minimum((self.e1 >> 16) + 1, 3) * right1 << 16)
        self.came += np.bincount(came, minlength=128)
        self.p2, self.p1 = self.p1, x


def _shape(n: int) -> tuple[int, int]:
    """(steps, lanes) of a block of n ids; only the last lane may be short."""
    steps = -(-n // min(LANES, max(1, n // LEAST)))
    return steps, -(-n // steps)


def _coded(ids: np.ndarray, highs: int) -> bytes:
    steps, n = _shape(len(ids))
    grid = np.zeros(steps * n, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n, steps).T)
    model = _Model(n, highs)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    out, upto = np.zeros((n, steps + 2), np.uint32), np.zeros(n, np.int64)
    fresh = 0
    for t in range(steps):
        if t and _refreshed(t):
            model.recount(grid[fresh:t])
            fresh = t
        if t % _REWEIGH == 0:
            model.reweigh()
        x = grid[t]
        a, b, at = model.predict()
        right2, right1 = x == a, x == b
        named = right2 | right1
        at += np.where(named, ~right2, model.kind.take(x))
        weight, of = model.weight.take(at), np.where(named, model.size, x)
        part = span >> _SHIFT
        add = part * (model.before.take(at) + model.c.take(of) * weight)
        low += add
        span = part * (model.f.take(of) * weight)
        if (over := low < add).any():
            lane = np.flatnonzero(over)
            back = upto[lane] - 1
            while lane.size:  # a carry goes back over words that are full
                out[lane, back] += np.uint32(1)
                go = out[lane, back] == 0
                lane, back = lane[go], back[go] - 1
        lane = np.flatnonzero(span < _NARROW)
        out[lane, upto[lane]] = low[lane] >> _WORD
        upto[lane] += 1
        low[lane] <<= _WORD
        span[lane] <<= _WORD
        model.update(x, right2, right1, at)
    every = np.arange(n)
    out[every, upto], out[every, upto + 1] = low >> _WORD, low & np.uint64(0xFFFFFFFF)
    upto += 2
    return upto.astype("<u4").tobytes() + out[np.arange(steps + 2) < upto[:, None]].astype("<u4").tobytes()


def _decoded(data: bytes, highs: int, total: int) -> np.ndarray:
    steps, n = _shape(total)
    words = np.frombuffer(data, "<u4") if len(data) % 4 == 0 else np.empty(0, "<u4")
    held = words[:n].astype(np.int64)
    if len(held) < n or held.sum() != len(words) - n or held.min() < 2 or held.max() > steps + 2:
        raise BadBlock("its lanes do not have its length")
    at = n + np.cumsum(held) - held
    last, words = len(words) - 1, words.astype(np.uint64)
    grid = np.zeros((steps, n), np.int64)
    model = _Model(n, highs)
    code, span = (words[at] << _WORD) | words[at + 1], np.full(n, (1 << 64) - 1, np.uint64)
    at += 2
    fresh = 0
    for t in range(steps):
        if t and _refreshed(t):
            model.recount(grid[fresh:t])
            fresh = t
        if t % _REWEIGH == 0:
            model.reweigh()
        a, b, k = model.predict()
        part = span >> _SHIFT
        value = np.minimum(code // part, _MOST)
        event = model.events().take((k << (_WEIGHT - 2)) + (value >> np.uint64(_COUNT)).astype(np.int64))
        k += event
        weight, before = model.weight.take(k), model.before.take(k)
        inside = ((value - before) // weight).astype(np.int64)
        named, right2 = event < 2, event == 0
        x = np.where(named, np.where(right2, a, b), model.slot.take(inside))
        if (new := np.flatnonzero(event == 3)).size:
            x[new] = np.minimum(inside[new], model.size - 1)
        of = np.where(named, model.size, x)
        code -= part * (before + model.c.take(of) * weight)
        span = part * (model.f.take(of) * weight)
        lane = np.flatnonzero(span < _NARROW)
        code[lane] = (code[lane] << _WORD) | words[np.minimum(at[lane], last)]
        at[lane] += 1
        span[lane] <<= _WORD
        model.update(x, right2, x == b, k)
        grid[t] = x
    return grid.T.reshape(-1)[:total].astype(np.uint32)


def encode(ids: np.ndarray, length: int) -> tuple[list[bytes], list[int], int]:
    """Blocks of `length` ids (the last may be shorter), their checksums, and how many high bytes the model knows."""
    if not len(ids):
        return [], [], 1
    if int(ids.max()) >= LIMIT:
        raise ValueError("ids are below 65536")
    highs = int(ids.max() >> 8) + 1
    parts = [ids[at : at + length] for at in range(0, len(ids), length)]
    return [_coded(x, highs) for x in parts], [zlib.crc32(x.astype("<u4").tobytes()) for x in parts], highs


def decode(blocks: list[bytes], sums: list[int], highs: int, length: int, total: int) -> np.ndarray:
    """All ids of the blocks, in order; raises BadBlock if one differs from its checksum."""
    out = np.empty(total if blocks else 0, np.uint32)
    for i, (block, want) in enumerate(zip(blocks, sums, strict=True)):
        part = out[i * length : (i + 1) * length]
        part[:] = _decoded(block, highs, len(part))
        if zlib.crc32(part.astype("<u4").tobytes()) != want:
            raise BadBlock(f"block {i}")
    return out
