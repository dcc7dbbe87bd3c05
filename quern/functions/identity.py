"""Identity generators and canonical JSON, on the driver."""

from __future__ import annotations

import json
import os
import secrets
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

#: Digits, upper case, lower case.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 0) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(max(width, 1), BASE62[0])


def from_base62(text: str) -> int:
    n = 0
    for c in text:
        n = n * 62 + BASE62.index(c)
    return n


def guid() -> str:
    return str(uuid.uuid4())


def short_id(length: int = 12) -> str:
    return "".join(secrets.choice(BASE62) for _ in range(length))


class UuidV7:
    """Time-ordered, monotonic within a process."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.last, self.lock = clock, 0, threading.Lock()

    def __call__(self) -> str:
        with self.lock:
            ms = int(self.clock() * 1000)
            now = (ms << 12) | secrets.randbits(11)
            self.last = now = max(now, self.last + 1)
        ms, low = now >> 12, now & 0xFFF
        value = ((ms & ((1 << 48) - 1)) << 80) | (7 << 76) | (low << 64) | (2 << 62) | secrets.randbits(62)
        return str(uuid.UUID(int=value))


class Snowflake:
    """41 bits of milliseconds since an epoch, 10 of node, 12 of sequence."""

    def __init__(self, node: int, epoch_ms: int = 1_704_067_200_000, clock: Callable[[], float] = time.time):
        if not 0 <= node < 1024:
            raise ValueError("a node has ten bits")
        self.node, self.epoch, self.clock = node, epoch_ms, clock
        self.ms, self.n, self.lock = -1, 0, threading.Lock()

    def __call__(self) -> int:
        with self.lock:
            ms = max(int(self.clock() * 1000) - self.epoch, self.ms)
            self.n = self.n + 1 if ms == self.ms else 0
            if self.n == 4096:
                ms, self.n = ms + 1, 0
            self.ms = ms
            return (ms << 22) | (self.node << 12) | self.n


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(json.loads(value) if isinstance(value, str) else value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def node_from_environment(name: str = "QUERN_NODE") -> int:
    return int(os.environ.get(name, "0"))
