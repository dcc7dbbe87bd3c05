"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most `capacity` words; pieces go, longest first, into the
tightest open bin that can take them. A bin carries a bitmap of the sources and one of the duplicate
clusters it holds; a piece never joins a bin with its source or its cluster. Open bins are ordered by
residual (a bitmap of the residuals in use, and the bins of each): the search starts at the least
residual that fits and goes to the successor until a compatible bin is found, without a limit.

Bins are packed in shards of about `shard_rows` pieces, dealt by a hash of the row; a shard is the
largest thing a task holds, a hot source or cluster is dealt over all shards, and a bin is free of
conflicts because it lies in one shard. So the tightest bin is the tightest of its shard: that is the
price of packing in parallel, at every size alike beyond one shard, and README has its measure.

Edges: a document without words, or null, has one row with null bin; a null source or cluster is
unknown and conflicts with nothing; repeated rows are packed each on their own, with bins of their own;
a null id is packed. A very long text is cut into pieces of `capacity` words, each for itself. Pieces
of one length go in the order of id and row, and of equally tight bins the last one that came to that
residual takes the piece. Only the named columns are read, whatever else a table holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored
from quern.llm.text import word_counts

CAPACITY, SHARD_ROWS = 2048, 8192


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def with_n_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words in the place of the text."""
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_words")).schema

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = part.column(len(kept)).cast(pa.large_binary()).fill_null(b"")
                _, ends, data = text.buffers()
                ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
                n = word_counts(np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(n, pa.int64())], names=[*kept, "n_words"])

    return docs.select(*kept, text_col).mapInArrow(count, schema)


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> tuple[list[int], list[int], int]:
    """Bins of (length, source, cluster) pieces, in their order: (bin of each piece, words of each bin, steps)."""
    twice = defaultdict(int)
    for _, _, cluster in pieces:
        twice[cluster] += 1
    source_bit: dict[object, int] = {None: 0}
    cluster_bit: dict[object, int] = {None: 0}
    sources, clusters, used = [], [], []
    open_at: dict[int, list[int]] = defaultdict(list)
    residuals, steps = 0, 0  # bit r: some open bin has residual r
    out = [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda j: (-pieces[j][0], j)):
        length, source, cluster = pieces[i]
        s = source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.setdefault(cluster, 1 << len(cluster_bit)) if twice[cluster] > 1 else 0
        found, rest = -1, residuals >> length
        at = length
        while rest:
            skip = (rest & -rest).bit_length() - 1
            at += skip
            held = open_at[at]
            for k in range(len(held) - 1, -1, -1):
                steps += 1
                b = held[k]
                if not sources[b] & s and not clusters[b] & c:
                    found = b
                    held[k] = held[-1]
                    held.pop()
                    if not held:
                        residuals &= ~(1 << at)
                    break
            if found >= 0:
                break
            rest >>= skip + 1
            at += 1
        if found < 0:
            found, at = len(used), capacity
            sources.append(0)
            clusters.append(0)
            used.append(0)
        sources[found] |= s
        clusters[found] |= c
        used[found] += length
        out[i] = found
        if left := at - length:
            open_at[left].append(found)
            residuals |= 1 << left
    return out, used, steps


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("bin_id", pa.int64()), ("bin_words", pa.int64())])


def packed(docs: DataFrame, words: Column, source: Column, cluster: Column, row: Column, id_col: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, row, piece, start_word, n_words, bin_id, bin_words), a row for each piece. row: a number of its own for each row of docs, the same whenever docs is read again."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.cast("long").alias("n_words"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"), row.cast("long").alias("row"))
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_words") / capacity))), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        held = table.sort_by([("doc_id", "ascending"), ("row", "ascending")]).to_pylist()
        pieces, of = [], []
        for x in held:
            for k, start in enumerate(range(0, x["n_words"], capacity)):
                size = min(capacity, x["n_words"] - start)
                pieces.append((size, x["source"], x["cluster"]))
                of.append((x["doc_id"], x["row"], k, start, size))
        bins, used, _ = best_fit(pieces, capacity)
        base = held[0]["shard"] << 32
        out = [(*o, base + b, used[b]) for o, b in zip(of, bins, strict=True)]
        out += [(x["doc_id"], x["row"], 0, 0, 0, None, None) for x in held if not x["n_words"]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return dealt.groupBy("shard").applyInArrow(pack, "doc_id long, row long, piece int, start_word long, n_words long, bin_id long, bin_words long")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row, written, so that it stays the same."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_bins(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """docs with a column bins (one of that name is replaced): for each piece its start, words and bin. Clusters are exact copies of a text."""
    rows = numbered(docs, "__quern_row")
    found = packed(rows, n_words(F.col(text_col)), F.col(source_col), F.xxhash64(F.col(text_col)), F.col("__quern_row"), id_col, capacity)
    lists = found.groupBy(F.col("row").alias("__quern_of")).agg(F.sort_array(F.collect_list(F.struct("piece", "start_word", "n_words", "bin_id"))).alias("__quern_bins"))
    both = rows.join(lists, F.col("__quern_row") == F.col("__quern_of"), "left")
    return both.select(*(rows[c] for c in docs.columns if c != "bins"), F.col("__quern_bins").alias("bins"))
