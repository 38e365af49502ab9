"""Order-preserving packing of token streams by dynamic programming.

A task's documents, in the order of its rows, are one stream of ids. Windows of at most `window` ids are cut at ends of
documents or sentences, or inside long sentences at even steps; the cuts have the least padding plus penalties for
the documents and sentences that they break. With d[j] = min over i of d[i] + window - (p[j] - p[i]) + penalty[j] and
p[j] - p[i] <= window, the best i is the least of d[i] + p[i] in a sliding range, which a monotone queue keeps. The stream
goes through the solver in bounded blocks; the ids behind a block's best last cut go on to the next block. What is left
at a task's end is cut into powers of two, which need no padding, if their extra cuts cost less than padding it.

Nothing is shuffled: each task packs the rows it reads. Sequence ids are the task's number and a counter, so a task that
is run again gives the same ids.

Cases. Null counts as empty: the end id alone. Repeated rows and null ids are documents of their own. A very long text is
many pieces. An empty table gives an empty table. Further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches
from .tokens import MOST, Encoder, encoder, forget, load
from .tokens import STEP as TEXTS

SENTENCE, INSIDE = 2.0, 16.0
STEP, LONG = 16, 96
#: Ids in a block of the solver.
BLOCK = 1 << 17


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions to cut at, from 0 to total, and their penalties; stretches over LONG ids get cuts every STEP."""
    cut = np.zeros(total + 1, bool)
    cut[0] = cut[total] = cut[doc_ends] = cut[sentence_ends] = True
    at = np.flatnonzero(cut)
    gap = np.flatnonzero(np.diff(at) > LONG)
    if len(gap):
        for g in gap.tolist():
            cut[at[g] + STEP : at[g + 1] : STEP] = True
        at = np.flatnonzero(cut)
    cost = np.full(total + 1, INSIDE)
    cost[sentence_ends] = SENTENCE
    cost[doc_ends] = cost[0] = cost[total] = 0.0
    return at, cost[at]


def cuts(at: np.ndarray, cost: np.ndarray, window: int, last: bool) -> list[int]:
    """Positions of the best cuts, from 0; last: the final position must be one, else the best near the end is the last."""
    p, c = at.tolist(), (cost + window).tolist()
    key, back = [0.0], [0]  # of each position d[j] + p[j], and the cut before it
    queue, head = [0], 0
    for j in range(1, len(p)):
        low = p[j] - window
        while p[queue[head]] < low:
            head += 1
        i = queue[head]
        back.append(i)
        k = key[i] + c[j]
        key.append(k)
        while key[queue[-1]] >= k:  # never the head, as k is more than its key
            queue.pop()
        queue.append(j)
    j = len(p) - 1
    if not last:
        first = int(np.searchsorted(at, at[-1] - window // 2))
        j = min(range(max(1, first), len(p)), key=lambda x: key[x] - p[x])
    out = [p[j]]
    while j:
        j = back[j]
        out.append(p[j])
    return out[::-1]


class Packer:
    """Takes documents in order and gives pieces (doc, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, sentence_end: np.ndarray, first_sequence: int = 0):
        self.window, self.sentence_end, self.sequence = window, sentence_end, first_sequence
        self.docs: list[tuple[int | None, np.ndarray, int]] = []
        self.held = 0

    def add(self, doc, ids: np.ndarray):
        self.docs.append((doc, ids, 0))
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self._solve(False)

    def end(self):
        if self.held:
            yield from self._solve(True)

    def _solve(self, last: bool):
        lengths = np.array([len(ids) - s for _, ids, s in self.docs], np.int64)
        ends = np.cumsum(lengths)
        stream = np.concatenate([ids[s:] for _, ids, s in self.docs])
        stops = np.flatnonzero(self.sentence_end[stream])
        at = cuts(*boundaries(ends, stops + 1, len(stream)), self.window, last)
        if last and len(at) > 1:
            left = at[-1] - at[-2]
            powers = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
            if len(powers) > 1 and (len(powers) - 1) * 4 * INSIDE < self.window - left:
                at = at[:-1]
                for x in powers:
                    at.append(at[-1] + x)
        k, begin = 0, 0  # the document at hand and where it begins in the stream
        for a, e in zip(at, at[1:], strict=False):
            pos = a
            while pos < e:
                while pos >= begin + lengths[k]:
                    begin += lengths[k]
                    k += 1
                doc, ids, s = self.docs[k]
                n = int(min(e, begin + lengths[k]) - pos)
                start = int(s + pos - begin)
                yield doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.sequence, int(pos - a)
                pos += n
            self.sequence += 1
        done = at[-1]
        while k < len(self.docs) and begin + lengths[k] <= done:
            begin += lengths[k]
            k += 1
        self.docs = [(d, i, s + (int(done - begin) if not x else 0)) for x, (d, i, s) in enumerate(self.docs[k:])]
        self.held = len(stream) - int(done)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ids(e: Encoder, size: int) -> np.ndarray:
    """Which ids end a sentence: those whose text ends with a full stop, an exclamation or question mark or a line's end."""
    ends = {".", "!", "?", e.newline}
    out = np.zeros(size, bool)
    for token, k in e.full.get_vocab().items():
        if k < size:
            out[k] = token.removesuffix("</w>")[-1:] in ends
    return out


def pack(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, remembered: int = MOST, alone: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    remembered: pieces of text whose ids a Python worker keeps; fewer take less memory and more time. alone: it keeps them, and
    the tokenizer, for its next task too; else it gives their memory back, for the stages of other jobs that come to the worker.
    """
    spec = load(tokenizer)

    def run(batches):
        e = encoder(spec, remembered)
        size = max(e.full.get_vocab_size(), end_id + 1)
        packer = Packer(window, sentence_ids(e, size), TaskContext.get().partitionId() << 40)
        end = np.full(1, end_id, e.dtype)

        def table(rows):
            cols = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), e.encode(some.column(1).to_pylist()), strict=True):
                    rows += packer.add(doc, np.concatenate([ids, end]))
                if rows:
                    yield table(rows)
        rows = list(packer.end())
        if rows:
            yield table(rows)
        if not alone:
            del e, packer
            forget()
            give_back()

    return map_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
