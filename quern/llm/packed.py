"""Arrays shipped between tasks as binary rows: (bucket, kind, payload).

Per-item rows would cost the shuffle tens of bytes and the JVM a microsecond each. Here a task
combines its own items first, sorts them by bucket and writes one row for each bucket and chunk, so
a hot item leaves a task once. Partitions hold whole buckets; their number is the session's
spark.sql.shuffle.partitions, which the cluster sizes with the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets for each shuffle partition, so that hashing them to partitions stays even.
BUCKETS_A_PARTITION = 4


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession) -> int:
    return partitions(spark) * BUCKETS_A_PARTITION


def dealt(df: DataFrame, by: str = "bucket") -> DataFrame:
    return df.repartition(partitions(df.sparkSession), by)


def digest_of(text: bytes) -> int:
    """What Spark's xxhash64 makes of a text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def home_of(doc_id: Column, text: Column, n: int) -> Column:
    """One of n homes for a row: by its id and its text, so that neither null ids nor an id that many texts share meet in one."""
    return F.pmod(F.xxhash64(doc_id, F.xxhash64(F.coalesce(text, F.lit("")))), F.lit(n)).cast("int")


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """xxHash64 of eight bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = (seed + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def homes_of(doc_ids: np.ndarray, digests: np.ndarray, n: int) -> np.ndarray:
    """home_of for arrays of ids and digests."""
    seed = _hash_long(doc_ids.astype(np.int64).view(np.uint64), np.uint64(42))
    return np.mod(_hash_long(digests.astype(np.int64).view(np.uint64), seed).view(np.int64), n).astype(np.int32)


def one_home(doc_id: int, digest: int, n: int) -> int:
    seed = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(digest.to_bytes(8, "little", signed=True), seed)
    return (h - (1 << 64) if h >> 63 else h) % n


def join_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary: lengths in bytes first."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def split_arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", n, 4)
    at, out = 4 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data[at : at + int(size)], kind))
        at += int(size)
    return out


def texts(batches: Iterable[pa.RecordBatch], id_at: int = 0, text_at: int = 1) -> Iterator[tuple[int | None, bytes]]:
    """(id, UTF-8 text) of each row; a null text counts as empty. Reads the buffers, builds no str."""
    for batch in batches:
        ids, column = batch.column(id_at).to_pylist(), batch.column(text_at)
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        for key, value in zip(ids, column, strict=True):
            yield key, (value.as_py() or b"")


def batches_of(rows: Iterable[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows gathered to Arrow batches of about limit bytes of binary."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, list)))
        if size >= limit or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
