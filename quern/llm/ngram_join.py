"""N-gram Jaccard join by set-relation skipping.

A document's set holds its distinct k-word shingles. Documents link when the Jaccard similarity of
their sets reaches the threshold; the answer is each document's connected component. The join is
exact for shingles held as 64-bit hashes.

1. Relevance. A set with a partner shares at least threshold of its tokens with it. Every task sends
   its distinct tokens (short hashes, four bytes each) to token buckets, which answer with those that
   occur in more than one document. A set in which fewer recur is skipped with all its tokens: most
   of a corpus ends here, and no list is ever built for it.
2. Index lists. Of what is left, equal sets are one class. Tokens are ordered globally by a corpus
   count sketch of fixed size and then by hash; each class posts its prefix. Short lists are walked by
   size and position. Long lists are cut by size into classes that grow by 1 / threshold, and these
   into blocks: a block meets the blocks of its own class and of the two beside it, all others are
   skipped by the length bound unread; in two blocks that meet, pairs pass length and position bounds.
3. Answers. A short list yields its pairs. In a long list, sets that are highly similar share their
   answers: first only the pairs with the list's head and the predecessor are verified. Sets so
   connected have one answer; of a long list's remaining pairs only those between different answers
   are derived, a block of the list against another, and verified. No pair within one answer is ever built.
4. Every pair passes a parity bitmap (an upper bound of the overlap) and is verified on full sets.
5. Numbers of links, if asked for: within a component, from each set's differences from a similar one (link_counts).

Edges: null or word-less text is an empty set and links with nothing; fewer than k words make one
shingle of the whole sequence; a null doc_id takes no part and is its own null component; rows
repeating a doc_id are one document whose texts each have a row (component: the smallest doc_id
that any reaches by links of its text). An empty table gives no rows. A very long text is hashed in
pieces and its set lies whole in one task. Homes go by id and text, so null ids, or many texts of one
id, spread over all tasks. Columns but the id and the text are not read; equal sets tie as one class.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, forget, stored
from quern.llm.link_counts import partners
from quern.llm.packed import batches_of, buckets, dealt, digest_of, home_of, join_arrays, one_home, split_arrays, texts
from quern.llm.text import mixed, windows, word_hashes

#: Bits of a token in the relevance step at most. Equal short hashes of different tokens only keep a set.
SHORT_BITS, HOME_BITS = 44, 20
#: Bits of it beside its bucket's; buckets grow with the input, so that as many tokens share them at every size.
LOW_BITS = 31
#: Bytes of short texts that are hashed together.
GATHER = 1 << 16
#: Tokens a task gathers before it sends them.
CHUNK = 2_000_000
SKETCH_BITS, SKETCH_PARTS = 20, 16
#: Lists up to this length yield all their pairs at once.
SHORT_LIST = 4
#: Members of a long list that a task compares with as many others at a time.
LIST_BLOCK = 512
FOREST_ROUNDS = 2


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z count as a-z."""
    words, _, _ = word_hashes(text, fold=True)
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(windows(words, min(k, len(words)), seed=min(k, len(words))))


def _distinct(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def _together(held: list[tuple], k: int) -> Iterator[tuple]:
    words, starts, _ = word_hashes(b" ".join(x[1] for x in held), fold=True)
    runs, at = windows(words, k, seed=k), 0
    for (key, _), to in zip(held, np.searchsorted(starts, np.cumsum([len(x[1]) + 1 for x in held])).tolist(), strict=True):
        n = to - at
        yield key, _distinct(np.sort(runs[at : to - k + 1] if n >= k else windows(words[at:to], n, seed=n) if n else words[:0]))
        at = to


def shingle_sets(rows: Iterable[tuple], k: int) -> Iterator[tuple]:
    """(key, shingles) of (key, text) rows, in their order; runs of words that cross texts are left out."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= GATHER:
            yield from _together(held, k)
            held, size = [], 0
    if held:
        yield from _together(held, k)


def needed(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The least overlap of a set of n with any partner: ceil(threshold * n)."""
    return -(-n * num // den)


def _short(tokens: np.ndarray, bits: int) -> np.ndarray:
    return tokens >> np.uint64(64 - _short_bits(bits))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), "<i8")
    return int(d[0]), int(d[1])


def _bucket_bits(n_buckets: int) -> int:
    """Leading bits of a short token that name its bucket: at least n_buckets buckets, 32 and more."""
    return min(HOME_BITS, max(5, (n_buckets - 1).bit_length()))


def _short_bits(bits: int) -> int:
    return min(SHORT_BITS, LOW_BITS + bits)


def _send(k: int, n_homes: int, bits: int):
    """Rows of a bucket: short tokens without their leading bits, by the home of their document; four bytes a token."""
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
    low_bits = _short_bits(bits) - bits
    low_mask = np.uint64((1 << low_bits) - 1)

    def flush(held: list[np.ndarray]) -> Iterator[tuple]:
        key = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        often = np.diff(np.append(at, len(key))) > 1  # in more than one document of this home
        key = key[at]
        value = ((key & low_mask) << np.uint64(1)) | often
        home = (key >> np.uint64(low_bits)) & np.uint64((1 << HOME_BITS) - 1)
        bucket = (key >> np.uint64(low_bits + HOME_BITS)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
            run = np.flatnonzero(np.append(True, home[a + 1 : b] != home[a : b - 1]))
            yield int(bucket[a]), join_arrays(home[a:b][run].astype("<u4"), np.diff(np.append(run, b - a)).astype("<u4"), value[a:b].astype("<u4"))

    def rows(batches) -> Iterator[tuple]:
        held, n = [], 0
        known = (((doc_id, text), text) for doc_id, text in texts(batches) if doc_id is not None)
        for (doc_id, text), tokens in shingle_sets(known, k):
            got = _distinct(_short(tokens, bits))
            home = np.uint64(one_home(doc_id, digest_of(text), n_homes))
            held.append(((got >> np.uint64(low_bits)) << np.uint64(low_bits + HOME_BITS)) | (home << np.uint64(low_bits)) | (got & low_mask))
            n += len(got)
            if n >= CHUNK:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return lambda batches: batches_of(rows(batches), schema)


def _recurring(bits: int):
    """Of whole buckets: for each home the tokens that occur in more than one document."""
    schema = pa.schema([("home", pa.int32()), ("payload", pa.binary())])
    short_bits, home_bits, home_mask = _short_bits(bits), np.uint64(HOME_BITS), np.uint64((1 << HOME_BITS) - 1)

    def rows(batches) -> Iterator[tuple]:
        pieces = []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                home, count, value = split_arrays(payload, "<u4", "<u4", "<u4")
                value = value.astype(np.uint64)
                key = (((np.uint64(bucket) << np.uint64(short_bits - bits)) | (value >> np.uint64(1))) << home_bits) | np.repeat(home, count)
                pieces.append(key)
                pieces.append(key[(value & np.uint64(1)) == 1])  # twice: it recurs already
        if not pieces:
            return
        key = np.sort(np.concatenate(pieces))
        pieces.clear()
        token = key >> home_bits
        same = token[1:] == token[:-1]
        key = key[np.append(same, False) | np.append(False, same)]
        key = np.sort(((key & home_mask) << np.uint64(short_bits)) | (key >> home_bits))
        home = (key >> np.uint64(short_bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(key) else np.empty(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=False):
            yield int(home[a]), _distinct(key[a:b] & np.uint64((1 << short_bits) - 1)).tobytes()

    return lambda batches: batches_of(rows(batches), schema)


def _among(known: np.ndarray, width: int):
    """Whether at least so many of some tokens (in order, of width bits) are known (in order, distinct).

    A bit table over the leading bits comes first: it has a bit for each known token and few others,
    and tokens in order read it in order. Only what it leaves is searched for.
    """
    lead = max(6, min(width, 26, 4 + len(known).bit_length()))
    drop, table = np.uint64(width - lead), np.zeros(1 << lead, bool)
    table[(known >> drop).astype(np.int64)] = True
    table = np.packbits(table, bitorder="little")

    def enough(tokens: np.ndarray, least: int) -> bool:
        place = (tokens >> drop).astype(np.int64)
        left = tokens[(table.take(place >> 3) >> (place & 7).astype(np.uint8)) & 1 == 1]
        return len(left) >= least and int((known[np.minimum(np.searchsorted(known, left), len(known) - 1)] == left).sum()) >= least

    return enough


_KEPT = "doc_id long, n int, d1 long, d2 long, part int, payload binary"


def _parity(tokens: np.ndarray) -> bytes:
    """Parity bitmap: about a bit for each token, a power of two, 64 at least."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _judge(k: int, num: int, den: int, bits: int):
    """Rows of a home: recurring tokens first, then texts. Out: a row for each document, for each set that may have a partner, and the sketch of those."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])

    def rows(batches) -> Iterator[tuple]:
        pieces, known, has, seen = [], None, None, set()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        counted, n = [], 0

        def documents() -> Iterator[tuple]:
            for batch in batches:
                kinds, ids, payloads = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4)
                column = batch.column(3).cast(pa.large_binary())
                for i, kind in enumerate(kinds):
                    if kind == 0:
                        pieces.append(np.frombuffer(payloads[i].as_py(), np.uint64))
                    else:
                        yield ids[i], column[i].as_py() or b""

        for doc_id, tokens in shingle_sets(documents(), k):
            if known is None:
                known = _distinct(np.sort(np.concatenate(pieces))) if pieces else np.empty(0, np.uint64)
                pieces.clear()
                has = _among(known, _short_bits(bits))
            d1, d2 = _digest(tokens)
            yield doc_id, len(tokens), d1, d2, -1, None
            if not len(tokens) or (d1, d2) in seen or doc_id is None or not len(known):
                continue
            if has(_short(tokens, bits), needed(len(tokens), num, den)):
                seen.add((d1, d2))
                counted.append((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if (n := n + len(tokens)) >= CHUNK:
                    sketch += np.bincount(np.concatenate(counted), minlength=len(sketch)).astype(np.uint32)
                    counted, n = [], 0
                yield None, len(tokens), d1, d2, -2, tokens.tobytes()
        if seen:
            if counted:
                sketch += np.bincount(np.concatenate(counted), minlength=len(sketch)).astype(np.uint32)
            for part, piece in enumerate(np.split(sketch, SKETCH_PARTS)):
                yield None, None, None, None, part, zlib.compress(piece.astype("<u4").tobytes(), 1)

    return lambda batches: batches_of(rows(batches), schema)


def _sum_sketch(batches) -> Iterator[pa.RecordBatch]:
    """Streams: one array for each part is held, however many tasks have sent theirs."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            piece = np.frombuffer(zlib.decompress(payload), "<u4").astype(np.uint64)
            sums[part] = sums[part] + piece if part in sums else piece
    yield from batches_of(((p, np.floor(4 * np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes()) for p, s in sums.items()), pa.schema([("part", pa.int32()), ("payload", pa.binary())]))


def _post(level, n_buckets: int, num: int, den: int):
    """Prefix postings of sets: bucket rows of (key, position) with the sets' digests and sizes."""
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def flush(held: list[tuple]) -> Iterator[tuple]:
        key = np.concatenate([x[0] for x in held])
        count = np.array([len(x[0]) for x in held])
        at = np.repeat(np.arange(len(held)), count)
        position = np.concatenate([np.arange(c) for c in count]).astype("<u4")
        d1, d2, size = (np.array([x[j] for x in held], kind) for j, kind in ((1, "<i8"), (2, "<i8"), (3, "<u4")))
        bucket = (mixed(key) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            rows = order[cut[b] : cut[b + 1]]
            sets, inverse = np.unique(at[rows], return_inverse=True)
            yield int(b), join_arrays(key[rows], position[rows], inverse.astype("<u4"), d1[sets], d2[sets], size[sets])

    def rows(batches) -> Iterator[tuple]:
        levels = level.value
        held, n = [], 0
        for batch in batches:
            for d1, d2, payload in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                tokens = np.frombuffer(payload, np.uint64)
                prefix = len(tokens) - needed(len(tokens), num, den) + 1
                key = (levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens & np.uint64((1 << 56) - 1))
                held.append((np.sort(key)[:prefix], d1, d2, len(tokens)))
                n += prefix
                if n >= CHUNK // 2:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return lambda batches: batches_of(rows(batches), schema)


_PAIR = "a1 long, a2 long, b1 long, b2 long, list long, position int, size int"


def _lists(num: int, den: int):
    """Walk whole lists. Out: pairs to verify (list is null), and the members of long lists (b1 is null)."""
    schema = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("list", pa.int64()), ("position", pa.int32()), ("size", pa.int32())])

    def walk(batches) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                key, position, at, d1, d2, size = split_arrays(payload, "<u8", "<u4", "<u4", "<i8", "<i8", "<u4")
                parts.append((key, position.astype(np.int64), d1[at], d2[at], size[at].astype(np.int64)))
        if not parts:
            return
        key, position, d1, d2, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((d2, d1, size, key))
        key, position, d1, d2, size = key[order], position[order], d1[order], d2[order], size[order]
        new = np.ones(len(key), bool)  # one set may come from several tasks
        new[1:] = (key[1:] != key[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        key, position, d1, d2, size = key[new], position[new], d1[new], d2[new], size[new]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(start, len(key)))
        of, head = np.repeat(length, length), np.repeat(start, length)
        long = of > SHORT_LIST
        pairs: list[np.ndarray] = []

        def add(i: np.ndarray, j: np.ndarray) -> None:  # i has the smaller set or an equal one
            i, j = i[fits := fit(size[i], position[i], size[j], position[j], num, den)], j[fits]
            if len(i):
                pairs.append(np.stack([d1[i], d2[i], d1[j], d2[j]], 1))

        for lag in range(1, SHORT_LIST):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & (~long[lag:] | (lag <= 1)))
            if not len(i):
                break
            add(i, i + lag)
        behind = np.flatnonzero(long & (np.arange(len(key)) > head))
        add(head[behind], behind)
        if pairs:
            every = np.unique(np.concatenate(pairs), axis=0)
            for a in range(0, len(every), 50_000):
                x = every[a : a + 50_000]
                empty = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, c]) for c in range(4)), empty, pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int32())], schema=schema)
        at = np.flatnonzero(long)
        for a in range(0, len(at), 50_000):
            x = at[a : a + 50_000]
            empty = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(d1[x]), pa.array(d2[x]), empty, empty, pa.array(key[x].view(np.int64)), pa.array(position[x].astype(np.int32)), pa.array(size[x].astype(np.int32))], schema=schema)

    return walk


def fit(size_a, position_a, size_b, position_b, num: int, den: int):
    """Length and position bounds of a pair that shares a token at these places (size_a <= size_b)."""
    overlap = -(-(size_a + size_b) * num // (num + den))
    return (size_a * den >= size_b * num) & (np.minimum(position_a, position_b) + 1 + np.minimum(size_a - position_a - 1, size_b - position_b - 1) >= overlap)


def _bound(batches) -> Iterator[pa.RecordBatch]:
    """Pairs that the parity bitmaps leave: overlap <= (|a| + |b| - differing bits) / 2."""
    for batch in batches:
        keep = []
        for pa_, pb, na, nb, num, den in zip(*(batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb", "num", "den")), strict=True):
            a, b = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in (pa_, pb))
            bits = min(len(a), len(b))
            a, b = (x.reshape(-1, bits).sum(0) & 1 if len(x) > bits else x for x in (a, b))
            most = (na + nb - int((a != b).sum())) // 2
            keep.append(most * (num + den) >= num * (na + nb))
        if any(keep):
            yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps of rows, folded to width."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width // 8), 1)


def _across(num: int, den: int, forest: int):
    """Of two blocks of a list the pairs between different answers that length, position and parity bounds leave.

    forest, if not 0: of those, in an order drawn by this number, only pairs that connect answers not
    connected by the pairs before them.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])

    def run(table: pa.Table) -> pa.Table:
        side, same, size, position, answer, a1, a2 = (table.column(c).to_numpy() for c in ("side", "same", "size", "position", "answer", "a1", "a2"))
        size, position = size.astype(np.int64), position.astype(np.int64)
        parity = table.column("parity").to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if same[0]:
            right = left  # a block with itself
        x, y = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
        keep = (answer[x] < answer[y]) if right is left else (answer[x] != answer[y])
        x, y = x[keep], y[keep]
        small, large = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        keep = fit(size[small], position[small], size[large], position[large], num, den)
        small, large = small[keep], large[keep]
        width = np.array([8 * len(p) for p in parity])
        good = np.zeros(len(small), bool)
        least = np.minimum(width[small], width[large])
        for w in np.unique(least):
            at = np.flatnonzero(least == w)
            used = np.unique(np.concatenate([small[at], large[at]]))
            rows = np.stack([_folded(np.frombuffer(parity[r], np.uint8)[None], int(w))[0] for r in used]).view(np.uint64)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                differ = np.bitwise_count(rows[np.searchsorted(used, small[part])] ^ rows[np.searchsorted(used, large[part])]).sum(1)
                both = size[small[part]] + size[large[part]]
                good[part] = (both - differ) // 2 * (num + den) >= num * both
        s, l = small[good], large[good]
        if forest and len(s):
            parent = {a: a for a in np.unique(answer).tolist()}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            keep = []
            drawn = np.random.default_rng(forest).permutation(len(s))
            s, l = s[drawn], l[drawn]
            for n, (p, q) in enumerate(zip(answer[s].tolist(), answer[l].tolist(), strict=True)):
                p, q = root(p), root(q)
                if p != q:
                    parent[p] = q
                    keep.append(n)
            s, l = s[keep], l[keep]
        return pa.Table.from_arrays([pa.array(c) for c in (a1[s], a2[s], a1[l], a2[l])], schema=schema)

    return run


def _verify(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for ta, tb, num, den in zip(*(batch.column(c).to_pylist() for c in ("ta", "tb", "num", "den")), strict=True):
            a, b = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            keep.append(den * common >= num * (len(a) + len(b) - common))
        if any(keep):
            yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep))


def _parities(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [_parity(np.frombuffer(x, np.uint64)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(got, pa.binary())], names=["d1", "d2", "n", "parity"])


_FOUR = "a1 long, a2 long, b1 long, b2 long"


def _links(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs those whose sets are similar enough. Bitmaps come first; full sets are joined only for what they leave."""
    side = lambda df, s, *what: df.select(F.col("d1").alias(s + "1"), F.col("d2").alias(s + "2"), *what)
    near = (
        pairs.join(side(bitmaps, "a", F.col("n").alias("na"), F.col("parity").alias("pa")), ["a1", "a2"])
        .join(side(bitmaps, "b", F.col("n").alias("nb"), F.col("parity").alias("pb")), ["b1", "b2"])
        .withColumns({"num": F.lit(num), "den": F.lit(den)})
        .mapInArrow(_bound, _FOUR)
    )
    return _similar(near, sets, num, den)


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs those whose full sets are similar enough."""
    side = lambda s, name: sets.select(F.col("d1").alias(s + "1"), F.col("d2").alias(s + "2"), F.col("payload").alias(name))
    return (
        pairs.join(side("a", "ta"), ["a1", "a2"])
        .join(side("b", "tb"), ["b1", "b2"])
        .withColumns({"num": F.lit(num), "den": F.lit(den)})
        .select("a1", "a2", "b1", "b2", "ta", "tb", "num", "den")
        .mapInArrow(_verify, _FOUR)
    )


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), and n_links if count_links: with how many other rows that have a doc_id the row's set links.

    n_links counts every link, copies included: two rows link when their sets are similar enough, and
    a row does not link with itself. Without words or a doc_id it is 0.
    """
    spark = docs.sparkSession
    num, den, n_buckets = percent, 100, buckets(spark)
    n_homes, bits = min(n_buckets, 1 << HOME_BITS), _bucket_bits(n_buckets)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.mapInArrow(_send(k, n_homes, bits), "bucket int, payload binary")
    answers = dealt(sent).mapInArrow(_recurring(bits), "home int, payload binary")
    both = answers.select("home", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "payload").unionAll(
        docs.select(home_of(F.col("doc_id"), F.col("text"), n_homes).alias("home"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("payload"))
    )
    judged = stored(dealt(both, "home").sortWithinPartitions("kind").mapInArrow(_judge(k, num, den, bits), _KEPT), "judged")
    rows = stored(judged.where("part = -1").select("doc_id", "n", "d1", "d2"), "documents")
    sets = stored(judged.where("part = -2").select("d1", "d2", "n", "payload").dropDuplicates(["d1", "d2"]), "sets")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for part, payload in judged.where("part >= 0").select("part", "payload").repartition(SKETCH_PARTS, "part").mapInArrow(_sum_sketch, "part int, payload binary").collect():  # a megabyte, always
        width = len(levels) // SKETCH_PARTS
        levels[part * width : (part + 1) * width] = np.frombuffer(payload, np.uint8)
    forget(judged)
    level = spark.sparkContext.broadcast(levels)
    posted = sets.select("d1", "d2", "payload").mapInArrow(_post(level, n_buckets, num, den), "bucket int, payload binary")
    walked = stored(dealt(posted).mapInArrow(_lists(num, den), _PAIR), "lists")
    bitmaps = stored(sets.select("d1", "d2", "payload", "n").mapInArrow(_parities, "d1 long, d2 long, n int, parity binary"), "bitmaps")
    pairs = walked.where("list is null").select("a1", "a2", "b1", "b2").distinct()
    links = stored(_links(pairs, sets, bitmaps, num, den), "links")
    # nodes of the graph are documents: a class is its smallest
    classes = stored(rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("w")), "classes")

    def named(df: DataFrame) -> DataFrame:
        end = lambda s: classes.select(F.col("d1").alias(s + "1"), F.col("d2").alias(s + "2"), F.col("node").alias(s))
        return df.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).select("a", "b")

    # one doc_id may have several texts: its classes are one document
    same = rows.where("n > 0 and doc_id is not null").join(classes, ["d1", "d2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    first_of = rows.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("d1", "d2").alias("texts")).where("texts > 1").select(F.col("doc_id").alias("a"))
    repeated = same.join(first_of, "a", "left_semi")
    edges = stored(named(links).unionAll(repeated), "edges")
    found = components(edges)
    every = links
    lists = walked.where("list is not null").join(classes, (F.col("a1") == classes.d1) & (F.col("a2") == classes.d2))
    lists = stored(lists.select("list", "a1", "a2", "position", "size", "node"), "members")
    # pairs within long lists: first a few that would join answers, until that joins none; then all pairs
    # between the answers that are left, which are few
    step = math.log(den / num) * (1 + 1e-9)  # sets that link are less than a step apart in the logarithm of their size
    for forest in (*range(1, FOREST_ROUNDS + 1), 0):
        members = lists.join(found, "node", "left").withColumn("answer", F.coalesce("component", "node"))
        members = members.withColumn("g", F.floor(F.log(F.col("size").cast("double")) / step).cast("int"))
        shape = members.groupBy("list", "g").agg(F.min("answer").alias("lo"), F.max("answer").alias("hi"), F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"))
        # a list's size classes and their blocks; classes are few, as they grow by a quarter each
        shape = shape.groupBy("list").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("g", "blocks"))).alias("has"))
        left = members.join(shape.where("lo < hi"), "list").join(bitmaps.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), "parity"), ["a1", "a2"])
        left = left.withColumn("own", F.pmod("a1", F.element_at("has", F.col("g"))).cast("int"))
        # a member meets the blocks of its own size class and of both beside it: no other class can hold a partner
        every_block = lambda g: F.when(F.map_contains_key("has", g), F.sequence(F.lit(0), F.try_element_at("has", g) - 1)).otherwise(F.array().cast("array<int>"))
        own_side = lambda o: F.struct(F.col("g").alias("ga"), F.least("own", o).alias("i"), F.col("g").alias("gb"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side"))
        upper = lambda o: F.struct(F.col("g").alias("ga"), F.col("own").alias("i"), (F.col("g") + 1).alias("gb"), o.alias("j"), F.lit(0).alias("side"))
        lower = lambda o: F.struct((F.col("g") - 1).alias("ga"), o.alias("i"), F.col("g").alias("gb"), F.col("own").alias("j"), F.lit(1).alias("side"))
        meets = F.concat(F.transform(every_block(F.col("g")), own_side), F.transform(every_block(F.col("g") + 1), upper), F.transform(every_block(F.col("g") - 1), lower))
        left = left.withColumn("m", F.explode(meets)).select("list", "m.*", "a1", "a2", "position", "size", "answer", "parity")
        left = left.withColumn("same", (F.col("ga") == F.col("gb")) & (F.col("i") == F.col("j")))
        pairs = left.groupBy("list", "ga", "i", "gb", "j").applyInArrow(_across(num, den, forest), _FOUR).distinct()
        more = stored(_similar(pairs, sets, num, den), "more-links")
        if more.isEmpty():
            continue
        every = every.unionAll(more)
        edges = stored(edges.unionAll(named(more)), "all-edges")
        found = components(edges)
    placed = stored(classes.join(found, "node", "left").select("d1", "d2", "w", F.coalesce("component", "node").alias("component")), "by-class")
    out = rows.join(placed, ["d1", "d2"], "left")
    worded = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(worded, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if count_links:
        others = partners(every, placed, sets, num, den).withColumnRenamed("n", "others")
        out = out.join(others, ["d1", "d2"], "left")
        columns.append(F.when(worded, F.coalesce("others", F.lit(0)) + F.col("w") - 1).otherwise(0).cast("long").alias("n_links"))
    out = out.select(*columns)
    for used in (sets, walked, bitmaps, lists):
        forget(used)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stay when one document of each component does: the smallest doc_id.

    Documents without words or without a doc_id stay. Repeated rows of one doc_id: one with the smallest text stays.
    """
    found = similar_documents(docs, id_col, text_col, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__quern_gone")).distinct()
    kept = docs.join(found, docs[id_col].cast("long") == F.col("__quern_gone"), "left_anti")
    worded = docs[id_col].isNotNull() & F.coalesce(docs[text_col].rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    again = docs.where(worded).groupBy(F.col(id_col).alias("__quern_id")).agg(F.count(F.lit(1)).alias("__quern_n")).where("__quern_n > 1").select("__quern_id")
    repeats = kept.join(again, worded & (docs[id_col] == F.col("__quern_id")), "left_semi")
    once = repeats.groupBy(F.col(id_col).alias("__quern_id")).agg(F.min_by(F.struct(*docs.columns), F.col(text_col)).alias("__quern_row")).select("__quern_row.*")
    return kept.join(again, worded & (docs[id_col] == F.col("__quern_id")), "left_anti").unionAll(once)
