"""Toxicity by the nearest labelled examples: exact cosine over a block-max inverted index.

Terms are words, word beginnings of 3 to 6 letters, and marks that a text has one of these at least 2, 3 or 4 times (as
one use may be harmless where several are not). A text's vector has for each term (1 + log of its uses) x inverse document
frequency over all documents x relevance. Relevance is what a bounded labelled sample says: how surely the term is commoner
among texts of label 1 (the z value of its log odds ratio, from LEAST_Z on, in sixths, 1 at most). Terms that do not speak for
label 1 surely, and twice as often as chance, have relevance 0 and are in no vector; there is no cap on the number of others. Without relevance, cosines follow a text's topic
and length instead (figures in the README).

The sample's vectors form an inverted index whose postings are cut into blocks of 64 examples, with the largest weight of
each term in each block. For a document the bound of each block is the product of its vector with these maxima; blocks are
scored in order of their bounds until no bound reaches the k-th best cosine. So the k nearest are exact. Their labels vote
by the square of the cosine, examples of each label counting for as many labelled documents as the sample has left out,
with the share of the label as a small prior. Votes are calibrated: isotonic regression on the votes that the examples get
from each other gives the score. The neighbours' ids are the evidence.

Bounds: at most `most` examples (1024 of label 1, 3072 of label 0), and their terms, are gathered and sent out.

Cases. Null and empty texts, and texts without a relevant term, have no neighbours and get the prior. Repeated rows are scored
alike. A null id counts as held out. Rows of one id, or of none, are told apart by the key of their text. Very long texts are
split into words as a whole. Ties in cosine go to the example with the smaller id. Without labels, or without a relevant
term, every score is the share of label 1 among the labels. An empty table gives an empty table. kept() keeps all columns, under any name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_fold, parts_for, without, written
from .labelled import sample, shares

#: ASCII signs at a word's ends are not part of it.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEGINNINGS = (3, 4, 5, 6)
#: Uses of a word or beginning in one text from which a term of its own stands for them.
LEVELS = (2, 3, 4)
CACHE = 150_000
BLOCK = 64
#: z value from which a term is relevant, and how far above it a term is wholly so.
LEAST_Z, FULL_Z = 3.0, 6.0
#: The least ratio of label 1's share among texts with a relevant term to its share among all.
LIFT = 2.0


def terms_of(word: str) -> list[str]:
    """The terms of a lower-cased word: itself, and its beginnings, marked by a star."""
    w = word.strip(SIGNS)
    return [w, *(w[:k] + "*" for k in BEGINNINGS if len(w) > k)] if w else []


def leveled(counts: Counter) -> list[str]:
    """The terms of a text from the counts of its words and beginnings."""
    return [*counts, *(f"{t}#{k}" for t, n in counts.items() if n >= LEVELS[0] for k in LEVELS if n >= k)]


class Terms:
    """Finds relevant terms in a text; words are remembered with their terms."""

    def __init__(self, kept: dict[str, int]):
        self.base = sorted({t.partition("#")[0] for t in kept})
        self.at = {t: k for k, t in enumerate(self.base)}
        self.levels = [[(k, kept[name]) for k in (1, *LEVELS) if (name := t if k == 1 else f"{t}#{k}") in kept] for t in self.base]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        got = tuple(self.at[t] for t in terms_of(word) if t in self.at)
        self.cache[word] = got
        return got

    def found(self, text: str | None) -> tuple[list[int], list[int]]:
        """The text's relevant terms in order, and the uses of each (1 for marks)."""
        words = (text or "").lower().split()
        got = list(map(self.cache.get, words))
        if None in got:
            got = [self._learn(w) if f is None else f for w, f in zip(words, got, strict=True)]
        counts = Counter(t for f in got if f for t in f)
        every = sorted((i, n if k == 1 else 1) for t, n in counts.items() for k, i in self.levels[t] if n >= k)
        return [i for i, _ in every], [n for _, n in every]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for length[0] places, then the same for the others."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Block-max inverted index of labelled examples. vectors: for each its terms and their uses; factor: idf x relevance."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[list[int], list[int]]], factor: np.ndarray, counts: tuple[float, float] = (1.0, 1.0)):
        self.ids, self.labels, self.factor = np.array(ids, np.int64), np.array(labels, np.float64), factor
        self.counts = np.where(self.labels > 0, counts[1], counts[0])
        self.blocks = -(-len(ids) // BLOCK)
        all_counts = float(self.counts.sum())
        self.prior = float(self.counts @ self.labels) / all_counts if all_counts else 0.0
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        some = [(np.array(t), self.weights(np.array(t), np.array(n))) for t, n in vectors]
        term = np.concatenate([t for t, _ in some if len(t)] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for t, w in some if len(t)] or [np.zeros(0)])
        place = np.repeat(np.arange(len(some)), [len(t) for t, _ in some])
        order = np.lexsort((place, term))
        self.place, self.weight, term = place[order], weight[order], term[order]
        # Entries: runs of one term in one block, each with its largest weight.
        run = term * max(1, self.blocks) + self.place // BLOCK
        self.entry = np.flatnonzero(np.diff(run, prepend=-1))
        self.entry_size = np.diff(np.append(self.entry, len(run)))
        self.entry_block = self.place[self.entry] // BLOCK
        self.entry_most = np.maximum.reduceat(self.weight, self.entry) if len(run) else self.weight
        self.first = np.searchsorted(term[self.entry], np.arange(len(factor) + 1))

    def weights(self, terms: np.ndarray, uses: np.ndarray) -> np.ndarray:
        if not len(terms):
            return np.zeros(0)
        w = (1 + np.log(uses)) * self.factor[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, uses: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best examples with a cosine over 0, best first; ties by place."""
        q = self.weights(terms, uses)
        sizes = self.first[terms + 1] - self.first[terms]
        entries, share = _runs(self.first[terms], sizes), np.repeat(q, sizes)
        block = self.entry_block[entries]
        bound = np.bincount(block, self.entry_most[entries] * share, self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        where, cos, floor, at, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4
        while at < len(order) and not (len(where) >= k and bound[order[at]] < floor - 1e-12):
            chosen = np.zeros(self.blocks, bool)
            chosen[order[at : at + step]] = True
            here = chosen[block]
            e = entries[here]
            flat = _runs(self.entry[e], self.entry_size[e])
            got = np.bincount(self.place[flat], self.weight[flat] * np.repeat(share[here], self.entry_size[e]))
            hit = np.flatnonzero(got > 0)
            where, cos = np.concatenate([where, hit]), np.concatenate([cos, got[hit]])
            if len(where) >= k:
                best = np.lexsort((where, -np.round(cos, 12)))[:k]
                where, cos = where[best], cos[best]
                floor = cos[-1]
            at, step = at + step, step * 2
        best = np.lexsort((where, -np.round(cos, 12)))
        return where[best], cos[best]

    def vote(self, terms: np.ndarray, uses: np.ndarray, k: int, prior_weight: float, but: int | None = None) -> tuple[float, list[int]]:
        """The share of label 1 among the k nearest examples, and their ids; but: an example that has no vote."""
        if not len(terms) or not self.blocks:
            return self.prior, []
        where, cos = self.nearest(terms, uses, k if but is None else k + 1)
        if but is not None:
            others = self.ids[where] != but
            where, cos = where[others][:k], cos[others][:k]
        w = cos * cos * self.counts[where]
        prior = prior_weight * float(self.counts.mean())
        return float((w @ self.labels[where] + prior * self.prior) / (w.sum() + prior)), self.ids[where].tolist()

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic regression of the examples' labels on the votes that they got from each other."""
        order = np.argsort(votes, kind="stable")
        blocks: list[list[float]] = []  # sum of counts, mean label, mean vote
        for v, y, c in zip(votes[order].tolist(), self.labels[order].tolist(), self.counts[order].tolist(), strict=True):
            blocks.append([c, y, v])
            while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
                c, y, v = blocks.pop()
                b = blocks[-1]
                b[1], b[2], b[0] = (b[0] * b[1] + c * y) / (b[0] + c), (b[0] * b[2] + c * v) / (b[0] + c), b[0] + c
        if blocks:
            self.curve = (np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks]))

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        """A score for each vote; a thousandth of it is the vote itself, so that higher votes stay higher."""
        return votes if self.curve is None else 0.999 * np.interp(votes, *self.curve) + 0.001 * votes


def choose_terms(examples: DataFrame, least: float = LEAST_Z, lift: float = LIFT) -> dict[str, tuple[int, float]]:
    """The terms of examples (text, label) that are commoner with label 1, each with a number and its relevance (0 to 1)."""

    def make():
        def f(b: pa.RecordBatch):
            found, labels = [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                has = leveled(Counter(t for w in (text or "").lower().split() for t in terms_of(w)))
                found += has
                labels += [label] * len(has)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], ["term", "label"])

        return f

    n = {int(r.label): r.n for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        return {}
    seen = arrow_map(examples.select("label", "text"), "term string, label int", make).groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b, c, d = F.col("a") + 0.5, F.col("b") + 0.5, ones - F.col("a") + 0.5, zeros - F.col("b") + 0.5
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    often = F.col("a") / (F.col("a") + F.col("b")) >= min(0.5, lift * ones / (ones + zeros))
    kept = seen.filter(often).select("term", F.least(F.lit(1.0), (z - least) / FULL_Z).alias("relevance")).filter("relevance > 0").orderBy("term")
    return {r.term: (k, r.relevance) for k, r in enumerate(kept.collect())}  # terms of at most sum(most) texts


def _counted(documents: DataFrame, kept: dict[str, int]) -> DataFrame:
    """doc_id, text_key, held_out, terms and uses of every whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(kept)

    def make():
        counter = Terms(sent.value)

        def f(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                got = [counter.found(t) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32()))], ["doc_id", "text_key", "held_out", "terms", "uses"])

        return f

    docs = crc_fold(documents.sparkSession, documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")), "doc_id")
    return arrow_map(docs, "doc_id long, text_key long, held_out boolean, terms array<int>, uses array<int>", make)


def _voted(counted: DataFrame, index: Index, nearest: int, prior_weight: float, threshold: float, others: bool) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted, neighbours; others: an example does not vote for itself."""
    sent = counted.sparkSession.sparkContext.broadcast(index)

    def make():
        index = sent.value

        def f(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, terms, uses = b.column(0).to_pylist(), b.column(3), b.column(4)
                t_all, n_all, ends = terms.flatten().to_numpy().astype(np.int64), uses.flatten().to_numpy(), np.cumsum([0, *terms.value_lengths().to_pylist()])
                got = [index.vote(t_all[s:e], n_all[s:e], nearest, prior_weight, k if others else None) for k, s, e in zip(ids, ends, ends[1:], strict=False)]
                scores = index.calibrated(np.array([g[0] for g in got]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "text_key", "held_out", "score", "predicted", "neighbours"])

        return f

    spread = counted.select("doc_id", "text_key", "held_out", "terms", "uses").repartition(2 * parts_for(counted.sparkSession))
    return arrow_map(spread, "doc_id long, text_key long, held_out boolean, score double, predicted int, neighbours array<bigint>", make)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: tuple[int, int] = (1024, 3072), nearest: int = 11, prior_weight: float = 0.02, **how) -> tuple[DataFrame, Index]:
    """The counted documents (a written table) and the calibrated index of the examples."""
    examples = written(sample(documents, labels, label, {1: most[0], 0: most[1]}), "toxicity-examples")
    chosen = choose_terms(examples, **how)
    kept = {t: k for t, (k, _) in chosen.items()}
    counted = written(_counted(documents, kept), "toxicity-counts")
    n = counted.count()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per kept term
    factor = (np.log((n + 1) / (np.array([df.get(k, 0) for k in range(len(kept))], float) + 1)) + 1) * np.array([r for _, r in chosen.values()], float)
    own = written(_counted(examples, kept).join(examples.select("doc_id", "label"), "doc_id"), "toxicity-vectors")
    rows = own.orderBy("doc_id").collect()  # at most sum(most) rows
    known = shares(documents, labels, label)
    taken = Counter(r.label for r in rows)
    index = Index([r.doc_id for r in rows], [r.label for r in rows], [(r.terms, r.uses) for r in rows], factor, tuple(known.get(v, 0) / max(1, taken[v]) for v in (0, 1)))
    votes = dict(_voted(own, index, nearest, prior_weight, 0.5, True).select("doc_id", "score").collect())
    if len(kept):
        index.calibrate(np.array([votes[k] for k in index.ids.tolist()]))
    return counted, index


def scored(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, nearest: int = 11, prior_weight: float = 0.02, **how) -> DataFrame:
    """One row per document: doc_id, text_key, held_out, score, predicted, neighbours (ids of the examples that voted)."""
    counted, index = fit(documents, labels, nearest=nearest, prior_weight=prior_weight, **how)
    return _voted(counted, index, nearest, prior_weight, threshold, False)


def score(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours (ids of the examples that voted)."""
    return scored(documents, labels, **how).drop("text_key")


def kept(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of documents that are not predicted toxic. Rows alike in id and text stay or go together."""
    return without(documents, scored(documents, labels, **how).filter("predicted = 1"), "toxic-keys")
