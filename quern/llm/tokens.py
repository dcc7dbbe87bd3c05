"""Token ids in files: tokenising, an adaptive range-coded format, and reading it back.

Documents are dealt into ranges of ascending id, tokenised and coded; an end id follows each. A file
row (segment) holds whole documents: their ids and lengths, and the blocks of coded ids, each
independently decodable and with its checksum. Spark's writer commits the files, so a lost executor's
work is done again, not doubled. Ids of a part are in document order; parts follow each other.

The library splits a text into pieces (its byte-level pre-tokeniser) and codes each piece alone, so a
piece always has the same ids: known pieces are looked up, new ones are encoded by the library. Plain
texts (ASCII and accented Latin letters) are split and looked up together in numpy, by their bytes and not
by a hash alone; other texts of Latin-1 are split by an expression. Texts with characters beyond that, and
texts that spell one of the vocabulary's added tokens (which the library takes out before it splits), go
to the library whole.

Edges: null counts as empty (the end id alone); equal or null ids are ordered by text, nulls first; an
empty table gives a file without rows. A very long text is encoded whole and lies in one segment, which
is longer then; its blocks stay of one size. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.packed import batches_of, partitions, texts
from quern.llm.range_coder import decode, encode

END_ID, BLOCK, SEGMENT = 0, 1 << 20, 8 << 20
#: Bytes of plain texts that are split together.
GATHER = 1 << 18
#: Characters of Latin-1 that are letters, digits and white space to the pre-tokeniser.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_DIGITS = "0-9²³¹¼-¾"
_SPACES = "\\t\\n\\x0b\\x0c\\r \u0085 "
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_KNOWN_PIECES = 300_000
#: Bits of a place in the table of plain pieces, pieces of it at most, and bytes of a piece there.
_PLACES, _MOST_PLAIN, _PLAIN_BYTES = 21, 1_200_000, 16
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
#: Classes of the bytes of plain texts; a byte from 128 on is of an accented letter (0xC3 and what follows it, but the signs of multiplication and division).
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]], _CLASS[48:58], _CLASS[[32, *range(9, 14)]] = _LETTER, _DIGIT, _SPACE
_PLAIN = bytes(c for c in (*range(1, 0xC0), 0xC3) if c not in (0x97, 0xB7))
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _split(data: np.ndarray, n: int, first: np.ndarray) -> np.ndarray:
    """Where the pieces of plain texts start that lie one behind another in n bytes of data; first: where a text starts."""
    kind = _CLASS.take(data[:n])
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    # the last white space before something else stands alone; a blank goes with what follows
    after = runs[1:][(kind[runs[1:]] != _SPACE) & (kind[runs[1:] - 1] == _SPACE) & ~first[runs[1:]]]
    start[after[data[after - 1] == 0x20]] = False
    start[after - 1] = True
    short = runs[data[runs] == 0x27]
    short = short[start[short] & ~first[short + 1]]
    a, b = data[short + 1], data[short + 2]
    three = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~first[short + 2]
    for at, size in ((short[np.isin(a, list(b"stmd"))], 2), (short[three], 3)):
        start[at + 1] = False
        start[(at + size)[at + size < n]] = True
    return np.flatnonzero(start)


class _Known:
    """Ids of plain pieces: a table of places in fours, by the pieces' bytes; longer pieces in a dictionary."""

    def __init__(self, end_id: int):
        self.a, self.b = np.zeros(1 << _PLACES, np.uint64), np.zeros(1 << _PLACES, np.uint64)
        self.at, self.size = np.zeros(1 << _PLACES, np.int32), np.zeros(1 << _PLACES, np.int32)
        self.longer: dict[bytes, tuple[int, int]] = {}
        self.ids, self.upto, self.pieces = np.full(1 << 20, end_id, np.uint32), 1, 0  # the first id is the end's

    def add(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of new ids."""
        size = np.array([len(x) for x in found], np.int64)
        new = np.fromiter(chain.from_iterable(found), np.uint32)
        while self.upto + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.upto : self.upto + len(new)] = new
        at = self.upto + np.cumsum(size) - size
        self.upto, self.pieces = self.upto + len(new), self.pieces + len(found)
        return at, size

    def keep(self, place: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Give pieces a free one of their four places, or the first."""
        left = np.arange(len(place))
        for way in (0, 1, 2, 3, 0):
            where = place[left] ^ way
            if way or len(left) == len(place):
                free = self.size[where] == 0
                put, where = left[free], where[free]
            else:
                put = left
            self.a[where], self.b[where], self.at[where], self.size[where] = a[put], b[put], at[put], size[put]
            where = place[left] ^ way
            left = left[(self.a[where] != a[left]) | (self.b[where] != b[left])]
            if not left.size:
                break


class Tokens:
    """A tokenizer file with a bounded memory of pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spelt = [t.encode() for t in self.added]
        self.known: dict[str, tuple[int, ...]] = {}
        self.plain: _Known | None = None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if any(t in text for t in self.added):
            return self.whole(text)
        pieces = _PIECES.findall(text)
        known = self.known
        try:
            return np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.uint32)
        except KeyError:
            if len(known) > _KNOWN_PIECES:
                known.clear()
            new = [p for p in set(pieces) if p not in known]
            for piece, found in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
                known[piece] = tuple(found.ids)
            return np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.uint32)


    def many(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind another, each with the end id, and how many each has."""
        other = {i: np.append(self.ids(t.decode()), np.uint32(end_id)) for i, t in enumerate(texts) if t.translate(None, _PLAIN) or any(s in t for s in self.spelt)}
        if not other:
            return self._together(texts, end_id)
        ids, sizes = self._together([t for i, t in enumerate(texts) if i not in other], end_id)
        rest = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        parts = [other[i] if i in other else next(rest) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _together(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """many, for plain texts."""
        if self.plain is None or self.plain.pieces > _MOST_PLAIN or self.plain.ids[0] != end_id:
            self.plain = _Known(end_id)
        known, whole = self.plain, b"".join(texts)
        n, ends = len(whole), np.cumsum([len(t) for t in texts], dtype=np.int64)
        held = whole + bytes(32)
        data, first = np.frombuffer(held, np.uint8), np.zeros(n + 3, bool)
        first[0] = True
        first[ends] = True
        starts = _split(data, n, first)
        length = np.diff(starts, append=n)
        eight = np.ndarray(n + 24, "<u8", held, strides=(1,))
        a, b = eight[starts] & _KEPT[np.minimum(length, 8)], eight[starts + 8] & _KEPT[np.clip(length - 8, 0, 8)]
        mix = a * _SPREAD[0] + b * _SPREAD[1]
        place = ((mix ^ (mix >> np.uint64(32))) * _SPREAD[2] >> np.uint64(64 - _PLACES)).astype(np.int64)
        long = length > _PLAIN_BYTES
        where = place.copy()
        miss = np.flatnonzero((known.a.take(place) != a) | (known.b.take(place) != b) | long)
        for way in (1, 2, 3):
            where[miss] = place[miss] ^ way
            miss = miss[(known.a[where[miss]] != a[miss]) | (known.b[where[miss]] != b[miss]) | long[miss]]
        at, size = known.at.take(where).astype(np.int64), known.size.take(where).astype(np.int64)
        if miss.size:
            number: dict[bytes, int] = {}
            of = np.array([number.setdefault(whole[i : i + k], len(number)) for i, k in zip(starts[miss].tolist(), length[miss].tolist(), strict=True)])
            pieces = list(number)
            got_at, got_size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
            new = []
            for i, piece in enumerate(pieces):
                if piece in known.longer:
                    got_at[i], got_size[i] = known.longer[piece]
                else:
                    new.append(i)
            found = self.library.encode_batch([pieces[i].decode() for i in new], add_special_tokens=False)
            got_at[new], got_size[new] = known.add([x.ids for x in found])
            for i in new:
                if len(pieces[i]) > _PLAIN_BYTES:
                    known.longer[pieces[i]] = int(got_at[i]), int(got_size[i])
            one = np.zeros(len(pieces), np.int64)
            one[of] = miss  # a place where each piece stands
            one = one[np.array(new, np.int64)]
            short = ~long[one]
            kept = np.array(new, np.int64)[short]
            known.keep(place[one[short]], a[one[short]], b[one[short]], got_at[kept], got_size[kept])
            at[miss], size[miss] = got_at[of], got_size[of]
        upto = np.searchsorted(starts, ends)
        at, size = np.insert(at, upto, 0), np.insert(size, upto, 1)
        through = np.cumsum(size)
        ids = known.ids.take(np.repeat(at - (through - size), size) + np.arange(through[-1] if len(through) else 0))
        return ids, np.diff(through[upto + np.arange(len(texts))], prepend=0)


_tokenizers: dict[str, Tokens] = {}


def tokenizer(path: str) -> Tokens:
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


_FILE = "part int, segment int, doc_ids array<long>, n_tokens array<long>, block int, highs int, payload array<binary>, sums array<long>"
_SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("block", pa.int32()), ("highs", pa.int32()), ("payload", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


def _write(tokenizer_path: str, end_id: int):
    def segment(part: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        payload, sums, highs = encode(np.concatenate(ids), BLOCK)
        row = (part, number, doc_ids, np.concatenate(sizes).tolist(), BLOCK, highs, payload, sums)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    def gathered(batches) -> Iterator[tuple[list[int | None], list[bytes]]]:
        doc_ids, held, n = [], [], 0
        for doc_id, text in texts(batches):
            doc_ids.append(doc_id)
            held.append(text)
            n += len(text)
            if n >= GATHER:
                yield doc_ids, held
                doc_ids, held, n = [], [], 0
        if held:
            yield doc_ids, held

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, docs, ids, sizes, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        tokens = tokenizer(tokenizer_path)
        for doc_ids, held in gathered(batches):
            found, size = tokens.many(held, end_id)
            docs += doc_ids
            ids.append(found)
            sizes.append(size)
            n += len(found)
            if n >= SEGMENT:
                yield segment(part, number, docs, ids, sizes)
                number, docs, ids, sizes, n = number + 1, [], [], [], 0
        if docs:
            yield segment(part, number, docs, ids, sizes)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all texts, in ascending order of id, to path."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer_path, end_id), _FILE).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files at path: start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers."""
    files = spark.read.schema(_FILE).parquet(path)
    sizes = files.select("part", "segment", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each part
    before, upto = [], 0
    for part, n in totals:
        before.append((part, upto))
        upto += n
    offsets = spark.createDataFrame(before, "part int, before long")
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(F.broadcast(offsets), "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    doc_ids, n, block, highs, payload, sums, start = (batch.column(c)[i].as_py() for c in range(7))
                    ids = decode(payload, sums, highs, block, sum(n)).astype("<u4")
                    at = 0
                    for doc_id, size in zip(doc_ids, n, strict=True):
                        yield doc_id, start + at, size, ids[at : at + size].tobytes()
                        at += size

        yield from batches_of(rows(), schema)

    held = files.join(starts, ["part", "segment"]).select("doc_ids", "n_tokens", "block", "highs", "payload", "sums", "start")
    return held.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
