"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are byte trigrams hashed to `terms` buckets, over whole texts; three more terms are the shares of
words that repeat the word one, two or three places before. The fit takes a sample of at
most `max_labelled` labelled rows (chosen by a hash of the id, the same at every input size), weighs
their logarithmic counts by inverse document frequency, scales the trigrams of a text to unit length and
then all its terms together, and keeps `rank` singular directions. The
labelled vectors are broadcast: max_labelled * rank floats, whatever the corpus. Every document's
vector is multiplied with all of them in blocks (exact cosines); the `neighbours` nearest, and all that
are as near as the last of them, vote with their label, weighted by a power of their similarity.

Edges: null or empty texts get the share of label 1 in the sample; so does every document when no
labelled text exists (0.5 then if there is no label at all). Null labels are not learnt from; a doc_id
labelled twice counts with its mean label (0.5 is 1); ids only select rows, no column but the text
enters a score, and columns of other names are not read. A very long text is counted in pieces. Each
input row gives one row, rows that repeat an id or text the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.packed import batches_of, texts
from quern.llm.text import word_hashes

TERMS, RANK, NEIGHBOURS, MAX_LABELLED, POWER = 4096, 48, 25, 4096, 8
_PIECE, _BLOCK = 1 << 20, 256
#: Distances at which words are compared for repetition.
LAGS = (1, 2, 3)


def counts(text: bytes) -> np.ndarray:
    """How often each hashed byte trigram occurs in the whole text, then the shares of repeated words."""
    data, total = np.frombuffer(text, np.uint8), np.zeros(TERMS + len(LAGS), np.float32)
    shift = np.uint32(32 - (TERMS - 1).bit_length())
    for at in range(0, max(1, len(data) - 2), _PIECE):
        x = data[at : at + _PIECE + 2].astype(np.uint32)
        if len(x) >= 3:
            code = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> shift
            total[:TERMS] += np.bincount(code, minlength=TERMS)
    words, _, _ = word_hashes(text, fold=True)
    for i, lag in enumerate(LAGS):
        if len(words) > lag:
            total[TERMS + i] = np.mean(words[lag:] == words[:-lag])
    return total


def _features(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows, in place: weighted logarithmic counts of unit length and weighted shares, of unit length together."""
    terms = rows[:, :TERMS]
    np.log1p(terms, out=terms)
    rows *= weights
    terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-12)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows


@dataclass(frozen=True)
class Voters:
    """A fitted classifier; about (terms + max_labelled) * rank floats."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        return _unit(_features(rows.copy(), self.weights) @ self.directions)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        empty = ~rows.any(axis=1)
        if not len(self.vectors):
            return np.full(len(rows), self.prior)
        near = self.project(rows) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        row, at = np.nonzero(near >= last[:, None])  # ties with the last neighbour vote too
        weight = np.maximum(near[row, at], 1e-3).astype(np.float64) ** POWER
        got = np.bincount(row, weight * self.labels[at], len(rows)) / np.bincount(row, weight, len(rows))
        return np.clip(np.where(empty, self.prior, got), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_arrays(rows: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Voters:
    """rows (float32) are used up."""
    if not len(rows):
        return Voters(np.ones(TERMS + len(LAGS), np.float32), np.zeros((TERMS + len(LAGS), 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, neighbours)
    weights = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1).astype(np.float32)
    x = _features(rows, weights)  # in place: the driver holds one copy
    rank = max(1, min(rank, *x.shape))
    draw = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    base = np.linalg.qr(x @ draw)[0]
    for _ in range(3):  # power iterations sharpen the leading directions
        base = np.linalg.qr(x @ np.linalg.qr(x.T @ base)[0])[0]
    directions = np.linalg.svd(base.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    vectors = _unit(x @ directions).astype(np.float32)
    return Voters(weights, directions, vectors, labels.astype(np.float64), float(labels.mean()), neighbours)


def _sparse(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("term", pa.binary()), ("n", pa.binary())])

    def rows():
        for doc_id, text in texts(batches):
            c = counts(text)
            at = np.flatnonzero(c)
            yield doc_id, at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes()

    yield from batches_of(rows(), schema)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, max_labelled: int = MAX_LABELLED) -> Voters:
    """Fit on at most max_labelled labelled rows. learn: of the label table, which rows may be learnt from."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    chosen = (
        usable.groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_labelled)
    )
    known = {r["__id"]: r["__label"] for r in chosen.collect()}  # max_labelled rows at most
    if not known:
        return fit_arrays(np.zeros((0, TERMS + len(LAGS)), np.float32), np.zeros(0))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in known], "__id long")
    learnt = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(wanted), "__id")
    rows = learnt.groupBy("__id").agg(F.min("__text").alias("__text")).mapInArrow(_sparse, "doc_id long, term binary, n binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    x, y = np.zeros((len(rows), TERMS + len(LAGS)), np.float32), np.zeros(len(rows))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.term, "<u2")] = np.frombuffer(r.n, "<f4")
        y[i] = known[r.doc_id]
    return fit_arrays(x, y)


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(voters)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = held.value
        ids, block = [], []

        def flush():
            got = model.scores(np.stack(block))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.float64())], schema=schema)

        for doc_id, text in texts(batches):
            ids.append(doc_id)
            block.append(counts(text))
            if len(ids) == _BLOCK:
                yield flush()
                ids, block = [], []
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold. Learns from labels that are not held out."""
    voters = fit(docs, labels, label_col, id_col, text_col, ~held_out(id_col))
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for a in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(a, _BLOCK)
                rows = np.stack([counts(t) for _, t in texts([part], at, at)])
                keep = model.scores(rows) >= threshold
                if keep.any():
                    yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
