"""Substring deduplication by repeated-phrase automata.

Each word covered by a window of `window` consecutive words whose sequence also starts earlier (in a
document of smaller id, or earlier in the same one) is removed; windows are judged on the input.

1. Recurring passages. Of the k-word phrases in each window the one with the least hash stands for
   it: equal windows, wherever they are, have the same phrase at the same place. Tasks count their
   phrases first; buckets confirm those that occur at least twice and tell the homes (buckets of
   documents) that hold them.
2. Automata. The confirmed phrases are sharded by home: a task compiles with pyahocorasick those that
   its homes' documents hold into one automaton over word codes, whose size their text bounds. So a
   document meets the passages of its own shard only, which hold all that recur in it.
3. Locating. Every document streams once through its task's automaton, which finds each occurrence of
   its phrases; an automaton's letters are hash bits, so a hit is a candidate, not yet a match. The windows that a located phrase stands for are named by 96-bit hashes.
4. First starts. A task keeps the first start of each window it holds and knows the rest as removed;
   buckets do the same over all tasks. What is removed goes to the document's home and is cut there.

Edges: a null text has no words; a text of fewer words than the window loses none; rows without a
doc_id take no part and lose nothing; rows that repeat a doc_id are judged alike, by (doc_id, start),
each on its own text; an empty table gives no rows; other columns are not read. A very long text is
hashed in pieces and lies whole in one task, as its words do. Homes go by id and text, so rows without
a doc_id, or many texts of one, spread over all tasks; rows equal in both lie together.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.packed import batches_of, buckets, dealt, digest_of, home_of, homes_of, join_arrays, one_home, split_arrays, texts
from quern.llm.text import mixed, sliding_minimum, windows, word_hashes

#: Words in a phrase. The automaton reads two letters of six bits for each word, from its hash: few
#: children a node. A false hit only adds windows to compare.
PHRASE = 4
CHUNK = 1_000_000
_ALPHABET = np.arange(48, 112, dtype=np.uint8)


def _letters(hashes: np.ndarray) -> str:
    """A document as the automaton reads it."""
    out = np.empty((len(hashes), 2), np.uint8)
    out[:, 0] = _ALPHABET[(hashes >> np.uint64(58)).astype(np.intp)]
    out[:, 1] = _ALPHABET[((hashes >> np.uint64(52)) & np.uint64(63)).astype(np.intp)]
    return out.tobytes().decode("ascii")


def _codes(hashes: np.ndarray) -> np.ndarray:
    """Each phrase as one number: twelve bits for each of its words."""
    twelve, n = hashes >> np.uint64(52), len(hashes) - PHRASE + 1
    out = np.zeros(n, np.uint64)
    for i in range(PHRASE):
        out = (out << np.uint64(12)) | twelve[i : i + n]
    return out


def _spelt(codes: np.ndarray) -> list[str]:
    """Codes as the automaton's keys."""
    shifts = np.arange(12 * PHRASE - 6, -1, -6, dtype=np.uint64)
    letters = _ALPHABET[((codes[:, None] >> shifts) & np.uint64(63)).astype(np.intp)]
    return [x.decode("ascii") for x in np.ascontiguousarray(letters).view(f"S{2 * PHRASE}").ravel().tolist()]


def _places(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes of a document, and for each of its windows the place of the phrase that stands for it."""
    phrases = windows(hashes, PHRASE)
    return phrases, sliding_minimum(phrases, window - PHRASE + 1)


def _count(window: int, n_buckets: int):
    """Rows of a bucket: phrases that stand for windows, by the home of their document."""
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def flush(held) -> Iterator[tuple]:
        code = np.concatenate([x for _, x in held])
        home = np.repeat(np.array([h for h, _ in held], np.uint32), [len(x) for _, x in held])
        bucket = (mixed(code) % np.uint64(n_buckets)).astype(np.int32)
        order = np.lexsort((code, home, bucket))
        code, home, bucket = code[order], home[order], bucket[order]
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (home[1:] != home[:-1])))
        often = np.diff(np.append(at, len(code))) > 1
        value, home, bucket = (code[at] << np.uint64(1)) | often, home[at], bucket[at]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(value)], strict=True):
            run = np.flatnonzero(np.append(True, home[a + 1 : b] != home[a : b - 1]))
            yield int(bucket[a]), join_arrays(home[a:b][run], np.diff(np.append(run, b - a)).astype("<u4"), value[a:b])

    def rows(batches) -> Iterator[tuple]:
        held, n = [], 0
        for doc_id, text in texts(batches):
            hashes, _, _ = word_hashes(text)
            if doc_id is None or len(hashes) < window:
                continue
            _, place = _places(hashes, window)
            held.append((one_home(doc_id, digest_of(text), n_buckets), _codes(hashes)[np.unique(place)]))
            n += len(held[-1][1])
            if n >= CHUNK:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return lambda batches: batches_of(rows(batches), schema)


def _confirm(batches) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: for each home its phrases that occur at least twice."""
    values, homes = [], []
    for batch in batches:
        for payload in batch.column(1).to_pylist():
            home, count, value = split_arrays(payload, "<u4", "<u4", "<u8")
            values.append(value)
            homes.append(np.repeat(home, count))
    if not values:
        return
    value, home = np.concatenate(values), np.concatenate(homes)
    del values, homes
    order = np.argsort(value, kind="stable")
    value, home = value[order], home[order]
    code = value >> np.uint64(1)
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    length = np.diff(np.append(at, len(code)))
    keep = np.repeat((length > 1) | (np.bitwise_or.reduceat(value, at) & np.uint64(1) == 1), length)
    code, home = code[keep], home[keep]
    order = np.argsort(home, kind="stable")
    code, home = code[order], home[order]
    cut = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.empty(0, np.int64)
    rows = ((int(home[a]), np.unique(code[a:b]).tobytes()) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(home)], strict=False))
    yield from batches_of(rows, pa.schema([("home", pa.int32()), ("payload", pa.binary())]))


def _automaton(codes: np.ndarray):
    import ahocorasick

    built = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in _spelt(codes):
        built.add_word(phrase)
    built.make_automaton()
    return built


def _cover(doc: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Places of the starts that cover the same words, of starts sorted by document: one in `window` of a run, and its last."""
    if not len(start):
        return np.empty(0, np.int64)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
    run = np.flatnonzero(new)
    since = np.arange(len(start)) - np.repeat(run, np.diff(np.append(run, len(start))))
    return np.flatnonzero((since % window == 0) | np.append(new[1:], True))


def _removed_rows(doc_ids, digests, doc: np.ndarray, start: np.ndarray, window: int, n_homes: int) -> Iterator[tuple]:
    """Rows (kind 1) for the homes of documents: which starts are removed. doc: places in doc_ids."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    keep = _cover(doc, start, window)
    doc, start = doc[keep], start[keep].astype("<u4")
    which, count = np.unique(doc, return_counts=True)
    ids, marks = doc_ids[which], digests[which]
    home = homes_of(ids, marks, n_homes)
    begin = np.cumsum(count) - count
    for h in np.unique(home):
        at = np.flatnonzero(home == h)
        yield 1, int(h), int(h), join_arrays(ids[at], marks[at], count[at].astype("<u4"), np.concatenate([start[begin[i] : begin[i] + count[i]] for i in at]))


_LOCATED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("home", pa.int32()), ("payload", pa.binary())])


def _locate(window: int, n_buckets: int):
    """Rows of a home: its phrases first, then its documents."""

    def flush(held) -> Iterator[tuple]:
        doc_ids, digests = (np.array([x[i] for x in held], "<i8") for i in (0, 1))
        doc = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        start, h1, h2, bucket = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
        order = np.lexsort((start, doc_ids[doc], h2, h1))
        doc, start, h1, h2, bucket = doc[order], start[order], h1[order], h2[order], bucket[order]
        first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        leader = np.repeat(first, np.diff(np.append(first, len(h1))))
        later = (doc_ids[doc] != doc_ids[doc[leader]]) | (start != start[leader])
        yield from _removed_rows(doc_ids, digests, doc[later], start[later], window, n_buckets)
        doc, start, h1, h2, bucket = doc[~later], start[~later], h1[~later], h2[~later], bucket[~later]
        order = np.lexsort((start, doc, bucket))
        cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            rows = order[cut[b] : cut[b + 1]]
            which, count = np.unique(doc[rows], return_counts=True)
            yield 0, int(b), 0, join_arrays(doc_ids[which], digests[which], count.astype("<u4"), start[rows].astype("<u4"), h1[rows], h2[rows])

    def documents(batches, phrases: list[np.ndarray]) -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            kinds, ids, column = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary())
            for i, kind in enumerate(kinds):
                if kind == 0:
                    phrases.append(np.frombuffer(batch.column(4)[i].as_py(), "<u8"))
                else:
                    yield ids[i], column[i].as_py() or b""

    def rows(batches) -> Iterator[tuple]:
        automaton, phrases = None, []
        best: dict[bytes, int] = {}
        held, n = [], 0
        for doc_id, text in documents(batches, phrases):
            if automaton is None:
                if not phrases:
                    return  # nothing recurs here
                automaton = _automaton(np.unique(np.concatenate(phrases)))
                phrases.clear()
            hashes, _, _ = word_hashes(text)
            if doc_id is None or len(hashes) < window:
                continue
            mark = hashlib.blake2b(text, digest_size=16).digest()
            digest = digest_of(text)
            if best.setdefault(mark, doc_id) < doc_id:  # a copy of an earlier document, seen in this task: all of it goes
                last = len(hashes) - window
                start = np.append(np.arange(0, last, window), last)
                yield from _removed_rows(np.array([doc_id], "<i8"), np.array([digest], "<i8"), np.zeros(len(start), int), start, 1, n_buckets)
                continue
            best[mark] = doc_id
            found = np.fromiter((end for end, _ in automaton.iter(_letters(hashes))), np.int64)
            found = found[found % 2 == 1] // 2  # ends of whole words
            if not len(found):
                continue
            phrase, place = _places(hashes, window)
            located = np.zeros(len(phrase), bool)
            located[found - PHRASE + 1] = True
            start = np.flatnonzero(located[place])
            if not len(start):
                continue
            bucket = (mixed(phrase[place[start]]) % np.uint64(n_buckets)).astype(np.int32)
            held.append((doc_id, digest, start, windows(hashes, window)[start], (windows(hashes, window, 7)[start] >> np.uint64(32)).astype(np.uint32), bucket))
            n += len(start)
            if n >= CHUNK:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return lambda batches: batches_of(rows(batches), _LOCATED)


def _resolve(window: int, n_homes: int):
    """Of whole buckets: windows that start earlier elsewhere."""

    def rows(batches) -> Iterator[tuple]:
        parts, docs = [], []
        at = 0
        for batch in batches:
            for kind, home, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind == 1:
                    yield 1, home, home, payload
                    continue
                ids, digests, count, start, h1, h2 = split_arrays(payload, "<i8", "<i8", "<u4", "<u4", "<u8", "<u4")
                docs.append((ids, digests))
                parts.append((np.repeat(np.arange(at, at + len(ids), dtype=np.int64), count), start, h1, h2))
                at += len(ids)
        if not parts:
            return
        doc_ids, digests = (np.concatenate(x) for x in zip(*docs, strict=True))
        doc, start, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts, docs
        order = np.lexsort((start, doc_ids[doc], h2, h1))
        doc, start, h1, h2 = doc[order], start[order], h1[order], h2[order]
        first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        leader = np.repeat(first, np.diff(np.append(first, len(h1))))
        later = (doc_ids[doc] != doc_ids[doc[leader]]) | (start != start[leader])
        yield from _removed_rows(doc_ids, digests, doc[later], start[later].astype(np.int64), window, n_homes)

    return lambda batches: batches_of(rows(batches), _LOCATED)


def _cut(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def rows(batches) -> Iterator[tuple]:
        removed: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            kinds, ids, column, payloads = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary()), batch.column(4)
            for i, kind in enumerate(kinds):
                if kind == 0:
                    doc_ids, digests, count, start = split_arrays(payloads[i].as_py(), "<i8", "<i8", "<u4", "<u4")
                    ends = np.cumsum(count)
                    for doc, digest, a, b in zip(doc_ids.tolist(), digests.tolist(), (ends - count).tolist(), ends.tolist(), strict=True):
                        removed.setdefault((doc, digest), []).append(start[a:b])
                    continue
                text = column[i].as_py() or b""
                words = text.split()
                key = (ids[i], digest_of(text))
                gone = 0
                if key in removed:
                    step = np.zeros(len(words) + 1, np.int32)
                    start = np.concatenate(removed[key]).astype(np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + window, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words_kept = list(itertools.compress(words, keep.tolist()))
                else:
                    words_kept = words
                yield ids[i], len(words), gone, b" ".join(words_kept)

    return lambda batches: batches_of(rows(batches), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row; kept holds the words that stay, joined by single spaces."""
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    spark = docs.sparkSession
    n = buckets(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = docs.mapInArrow(_count(window, n), "bucket int, payload binary")
    answers = dealt(counted).mapInArrow(_confirm, "home int, payload binary")
    own = docs.select(home_of(F.col("doc_id"), F.col("text"), n).alias("home"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("payload"))
    note = lambda df: df.select("home", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "payload")
    located = dealt(note(answers).unionAll(own), "home").sortWithinPartitions("kind").mapInArrow(_locate(window, n), "kind int, bucket int, home int, payload binary")
    gone = dealt(located).mapInArrow(_resolve(window, n), "kind int, bucket int, home int, payload binary")
    texts_home = note(gone).unionAll(own)
    return dealt(texts_home, "home").sortWithinPartitions("kind").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
