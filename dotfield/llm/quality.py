"""Quality by votes of the nearest labelled documents in a latent semantic space.

A text's terms are trigrams of byte classes (letters, capitals, digits, blanks, signs by kind) and how its words repeat.
Counts are weighted by inverse document frequency over all documents; a truncated singular value decomposition of a
bounded labelled sample gives the latent axes. The sample's vectors are sent to every task, which computes the cosines of
all its documents with all of them in blocks and lets the nearest vote, weighted by a power of the cosine.

Bounds: at most `most` labelled documents (4096) of 1335 terms are gathered on the driver, and most * axes numbers are
sent out. Everything else covers all documents.

Cases. Null, empty and blank texts have no vector and get the sample's mean label. Repeated rows are scored alike. A
null id counts as held out. Very long texts are counted in pieces of bounded size; a word that a piece's end cuts counts as two.
Ties in cosine (to nine places) go to the example of smaller id. Without labels every score is 0.5.
An empty table gives an empty table. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_fold, map_batches
from .labelled import sample
from .ngram_join import Shingler

#: Byte classes: lower case, capitals, digits, blank, line end, full stops and commas, exclamation, bar, quotes and
#: brackets, other signs, bytes of other letters.
CLASSES = 11
_CLASS = np.full(256, 9, np.int16)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".,;:-", b"!?", b"|", b"\"'()[]{}<>", b"", range(128, 256))):
    _CLASS[list(_bytes)] = _k if _bytes else 9
TRIGRAMS = CLASSES**3
TERMS = TRIGRAMS + 4
REPEATS = 2.0


class Profiler:
    """Rows of term weights: square roots of the shares of trigrams, and of words that repeat."""

    def __init__(self):
        self.words = Shingler(1)

    def rows(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), np.float32)
        for k, t in enumerate(texts):
            if t and len(t) > 2:
                self._row(np.frombuffer(t, np.uint8), out[k])
        return out

    def _row(self, data: np.ndarray, row: np.ndarray) -> None:
        counts = np.zeros(TRIGRAMS, np.int64)
        piece = 1 << 20
        for at in range(0, max(1, len(data) - 2), piece):
            c = _CLASS[data[at : at + piece + 2]]
            counts += np.bincount(c[:-2] * np.int16(CLASSES * CLASSES) + c[1:-1] * np.int16(CLASSES) + c[2:], minlength=TRIGRAMS)
        row[:TRIGRAMS] = np.sqrt(counts / counts.sum())
        hashes = np.concatenate([self.words.words(data[at : at + piece])[0] for at in range(0, len(data), piece)])
        n = len(hashes)
        if n > 1:
            again = int((hashes[1:] == hashes[:-1]).sum())
            order = np.sort(hashes)
            new = 1 + int((order[1:] != order[:-1]).sum())
            row[TRIGRAMS:] = np.sqrt(np.array([again, n - again, 0.25 * (n - new), 0.25 * new]) / n) * (REPEATS, 0.5, 0.5, 0.5)
        elif not n:
            row[:] = 0


def _docs(documents: DataFrame) -> DataFrame:
    return crc_fold(documents.sparkSession, documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), "doc_id")


def document_frequency(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents that have each term; summed in the tasks, then over tasks."""

    def run(batches):
        profiler, n, df = Profiler(), 0, np.zeros(TERMS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = profiler.rows(b.column(0).slice(at, 256).to_pylist())
                n += len(rows)
                df += (rows > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(TERMS)], pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["term", "n"])

    sums = map_batches(documents.select(F.col("text").cast("binary")), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = dict(sums.collect())  # TERMS + 1 rows
    return out.get(-1, 0), np.array([out.get(k, 0) for k in range(TERMS)], np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-9)


class Space:
    """Latent axes and the labelled vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, idf: np.ndarray, axes: int):
        self.idf = idf
        weighted = unit(rows * self.idf)
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        self.axes = vectors[:, ::-1][:, :axes]
        self.points = unit(weighted @ self.axes)
        self.labels = labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def score(self, rows: np.ndarray, nearest: int, power: int) -> np.ndarray:
        q = unit(unit(rows * self.idf) @ self.axes)
        # Cosines to nine places, ties to the example of smaller id: then no order of sums shows in the result.
        cos = np.rint((q @ self.points.T) * 1e9)
        n = cos.shape[1]
        k = min(nearest, n)
        key = cos.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        best = np.sort(n - 1 - np.partition(key, n - k, axis=1)[:, n - k :] % n, axis=1)
        w = np.maximum(np.take_along_axis(cos, best, 1) / 1e9, 0) ** power
        total = w.sum(axis=1)
        votes = (w * self.labels[best]).sum(axis=1)
        return np.round(np.clip(np.where(total > 0, (votes + 1e-9 * self.prior) / (total + 1e-9), self.prior), 0, 1), 9)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4096, axes: int = 48) -> Space | None:
    n, df = document_frequency(documents)
    each = {0: most // 2, 1: most // 2}

    def make():
        profiler = Profiler()

        def f(b: pa.RecordBatch):
            rows = profiler.rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "doc_id", "row"])

        return f

    got = arrow_map(sample(documents, labels, label, each).select("label", F.col("text").cast("binary"), "doc_id"), "label int, doc_id long, row binary", make).collect()
    got = [(r.label, np.frombuffer(r.row, np.float32).astype(np.float64)) for r in sorted(got, key=lambda r: r.doc_id)]
    got = [x for x in got if x[1].any()]
    if not got:
        return None
    return Space(np.stack([r for _, r in got]), np.array([v for v, _ in got]), np.log((n + 1) / (df + 1)) + 1, axes)


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, nearest: int = 15, power: int = 8, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1) and predicted."""
    space = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, **how))

    def make():
        profiler = Profiler()

        def f(b: pa.RecordBatch):
            s = space.value
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = profiler.rows(part.column(1).to_pylist())
                got = s.score(rows, nearest, power) if s else np.full(len(rows), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return f

    return arrow_map(_docs(documents), "doc_id long, held_out boolean, score double, predicted int", make)
