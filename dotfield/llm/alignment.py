"""Alignment of two tokenizers over whole texts, with corpus-wide counts of linked id pairs from inverted bitmaps.

Tokenizer A is byte-level BPE (a tokenizers JSON file), B is a sentencepiece model with byte fallback; A reads a blank and the text, B
adds the blank itself. Where a token of A and one of B end at the same byte, the bytes are cut; a group is what lies between
two cuts, and every token of A in it is linked to every one of B.

One pass over the texts makes an inverted table. Documents are numbered in chunks of at most CHUNK_DOCS documents or
CHUNK_LINKS links, whichever comes first, and for each id pair of a chunk there is a posting: the set of the chunk's documents
that hold it (plane 0), and for the bits of its multiplicity less one the sets of documents that have the bit (planes 1, 2,
...). What the chunk's batches hold of a pair is OR-merged. A set is a bitmap, or a sorted list of 16-bit places where that is
shorter. Populations of plane 0 summed over chunks are a pair's document count, those of all planes by weight its link count.
The counts then go back along the postings, whose bits say which documents they are added to; texts are read once.

A word after a single blank is cut alike wherever it stands: A cuts there first, and B has no piece with a blank after
another sign (asserted). So words are aligned once and remembered, up to MOST of them in a worker. A text with blank runs, or a
word whose tokens do not give its bytes back, is aligned whole.

Cases. Null and empty texts, and those whose tokens' bytes are not the blank and the text (as a U+2581 in it makes it), have no
tokens: zeros and an empty hash; they count for no pair. Special tokens' strings are text. Repeated rows and null ids are documents of their
own. A text with more than CHUNK_LINKS links is a chunk by itself. An empty table gives an empty table. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, map_batches, parts_for, small_or_shuffled, written
from .tokens import Encoder, load

CHUNK_DOCS, CHUNK_LINKS = 8192, 6_000_000
#: Words that a worker remembers; about 0.4 kB each.
MOST = 300_000
#: Counts of pairs (24 bytes each) are broadcast up to so many, else shuffled.
BROADCAST_ROWS = 1_000_000
#: Documents that are looked up together.
STEP = 64
#: A piece that is empty or begins with a blank, between NULs: such a text is not cut at its blanks. U+2581 stands for B's blank.
_UNCUT = re.compile("(?:^|\0)(?:\\s|\0|$)|▁")
POSTING = "a int, b int, plane int, n int, docs binary"
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
MADE = f"chunk long, {POSTING}, pos int, doc_id long, {COUNTS}"


class Grown:
    """An array with room to append."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(len(more), len(self.data)), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Aligned:
    """Of some words or texts: tokens, groups and links of each; pairs flat; groups as text."""

    def __init__(self, n_a, n_b, n_groups, n_links, pairs, shown, ok):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs, self.shown, self.ok = n_a, n_b, n_groups, n_links, pairs, shown, ok


class Aligner:
    def __init__(self, spec: str, model: bytes, most: int = MOST):
        import sentencepiece

        self.most = most
        self.a = Encoder(spec, most)
        assert self.a.byte_level and not json.loads(spec).get("normalizer"), "A must be byte-level BPE"
        self.a.full.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        signs = {c: b for b, c in self.a.letters.items()}
        words = self.a.full.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(signs[c] for c in w) if all(c in signs for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        assert not any("▁" in p.lstrip("▁") for p in pieces), "B has pieces over word limits"
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        table = lambda n, end: np.array([f"{i}{end}".encode() for i in range(n)], object)
        self.show_a = table(len(self.bytes_a), ","), table(len(self.bytes_a), "|")
        self.show_b = table(len(self.bytes_b), ","), table(len(self.bytes_b), ";")
        self.bits_b = len(self.bytes_b).bit_length()
        self.bits = self.bits_b + len(self.bytes_a).bit_length()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.ok, self.pairs = Grown(bool), Grown(np.int64)
        self.counts = [Grown(np.int32) for _ in range(4)]
        self.begins = Grown(np.int64)

    def align(self, texts: list[str], ids_a: list[np.ndarray], ids_b: list[list[int]]) -> Aligned:
        """texts without the blank before them, and their ids."""
        n = len(texts)
        raw = [b" " + t.encode("utf-8") for t in texts]
        of_a, of_b = (np.fromiter(map(len, x), np.int64, n) for x in (ids_a, ids_b))
        a = np.concatenate(ids_a).astype(np.int64) if n else np.zeros(0, np.int64)
        b = np.fromiter(itertools.chain.from_iterable(ids_b), np.int64, int(of_b.sum()))
        ok = np.ones(n, bool)
        for table, ids, of in ((self.bytes_a, a, of_a), (self.bytes_b, b, of_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw):
                at = np.concatenate([[0], np.cumsum(of)])
                for k in range(n):
                    ok[k] &= b"".join(map(table.__getitem__, ids[at[k] : at[k + 1]].tolist())) == raw[k]
        if not ok.all():
            a, b = a[np.repeat(ok, of_a)], b[np.repeat(ok, of_b)]
            of_a, of_b = of_a * ok, of_b * ok
        size = np.fromiter(map(len, raw), np.int64, n) * ok
        end_a, end_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(size)
        cuts = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        with_b = in_b[group_a]
        linked = np.repeat(last_b[group_a] - with_b, with_b) + np.arange(with_b.sum()) - np.repeat(np.cumsum(with_b) - with_b, with_b)
        pairs = (np.repeat(a, with_b) << self.bits_b) | b[linked]
        word_a = np.repeat(np.arange(n), of_a)
        n_links = np.bincount(word_a, with_b, minlength=n).astype(np.int64)
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(cuts, ends, "right")]))
        out = np.empty(len(a) + len(b), object)
        closes_a, closes_b = np.arange(1, len(a) + 1) == last_a[group_a], np.arange(1, len(b) + 1) == last_b[group_b]
        place_a, place_b = np.arange(len(a)) + (last_b - in_b)[group_a], np.arange(len(b)) + last_a[group_b]
        out[place_a] = np.where(closes_a, self.show_a[1][a], self.show_a[0][a])
        out[place_b] = np.where(closes_b, self.show_b[1][b], self.show_b[0][b])
        whole = b"".join(out.tolist())
        width = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out.tolist()), np.int64, len(out)))])
        at = width[np.concatenate([[0], np.cumsum(of_a + of_b)])].tolist()
        shown = [whole[i : max(i, j - 1)] for i, j in itertools.pairwise(at)]
        return Aligned(of_a, of_b, n_groups, n_links, pairs, shown, ok)

    def learn(self, words: list[str]) -> None:
        self.a._learn(words, False)
        new = self.align(words, [np.frombuffer(self.a.pieces.pop(w), self.a.dtype) for w in words], self.b.encode(words, num_threads=1))
        base = self.pairs.n
        self.known.update(zip(words, range(len(self.shown), len(self.shown) + len(words)), strict=True))
        self.shown += new.shown
        self.ok.extend(new.ok)
        for into, more in zip(self.counts, (new.n_a, new.n_b, new.n_groups, new.n_links), strict=True):
            into.extend(more)
        self.begins.extend(base + np.cumsum(new.n_links) - new.n_links)
        self.pairs.extend(new.pairs)

    def whole(self, text: str) -> tuple[np.ndarray, str, np.ndarray]:
        ids = np.array(self.a.full.encode(" " + text, add_special_tokens=False).ids, np.int64)
        x = self.align([text], [ids], [self.b.encode(text)])
        if not x.ok[0]:
            return np.zeros(4, np.int64), "", np.zeros(0, np.int64)
        return np.array([x.n_a[0], x.n_b[0], x.n_groups[0], x.n_links[0]]), hashlib.sha256(x.shown[0]).hexdigest(), x.pairs

    def documents(self, texts: list[str | None]):
        """Of each text: four counts, the hash of its groups, and its links as pairs."""
        for base in range(0, len(texts), STEP):
            some = [t or "" for t in texts[base : base + STEP]]
            cut = {k: t.split(" ") for k, t in enumerate(some) if t}
            found = {k: list(map(self.known.get, w)) for k, w in cut.items()}
            new = self._unknown(cut, found)
            if new and len(self.known) + len(new) > self.most:
                self.forget()
                found = {k: [None] * len(w) for k, w in cut.items()}
                new = self._unknown(cut, found)
            if new:
                self.learn(list(new))
            for k, text in enumerate(some):
                if not text:
                    yield np.zeros(4, np.int64), "", np.zeros(0, np.int64)
                    continue
                at = found.get(k)
                if at is None:
                    yield self.whole(text)
                    continue
                if None in at:
                    at = list(map(self.known.__getitem__, cut[k]))
                idx = np.array(at, np.int64)
                if not self.ok.data[idx].all():
                    yield self.whole(text)
                    continue
                links = self.counts[3].data[idx].astype(np.int64)
                flat = np.repeat(self.begins.data[idx] - np.cumsum(links) + links, links) + np.arange(links.sum())
                sums = np.array([*[c.data[idx].sum(dtype=np.int64) for c in self.counts[:3]], len(flat)])
                yield sums, hashlib.sha256(b";".join(map(self.shown.__getitem__, at))).hexdigest(), self.pairs.data[flat]

    def _unknown(self, cut: dict, found: dict) -> dict[str, None]:
        """Words to learn; texts that cannot be cut are taken out of found."""
        new: dict[str, None] = {}
        for k, words in cut.items():
            if None in found[k]:
                fresh = [w for w, i in zip(words, found[k], strict=True) if i is None]
                if _UNCUT.search("\0".join(fresh)) or any("\0" in w for w in fresh):
                    found.pop(k)
                else:
                    new.update(dict.fromkeys(fresh))
        return new


def containers(places: np.ndarray, of: np.ndarray, docs: int):
    """Sets of places below docs, set i having the next of[i] of them in order: (which, Arrow binary) of lists and of bitmaps."""
    width = -(-docs // 8)
    listed = 2 * of <= width
    keep = np.repeat(listed, of)
    which = np.flatnonzero(listed)
    if len(which):
        ends = np.concatenate([[0], np.cumsum(2 * of[which])]).astype(np.int32)
        yield which, pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(places[keep].astype("<u2"))])
    dense, at = np.flatnonzero(~listed), np.concatenate([[0], np.cumsum(of)])
    for k in range(0, len(dense), 1024):
        some = dense[k : k + 1024]
        bits = np.zeros((len(some), width * 8), bool)
        for row, i in enumerate(some.tolist()):
            bits[row, places[at[i] : at[i + 1]]] = True
        ends = (np.arange(len(some) + 1) * width).astype(np.int32)
        yield some, pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(np.packbits(bits, axis=1).tobytes())])


def members(docs: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, place) of all members of sets that containers() made, of n members each."""
    docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
    ends = np.frombuffer(docs.buffers()[1], np.int32)[docs.offset : docs.offset + len(docs) + 1].astype(np.int64)
    raw = np.frombuffer(docs.buffers()[2], np.uint8)
    size, sets, places = np.diff(ends), [], []
    listed = size == 2 * n
    if listed.any():
        keep = np.zeros(len(raw) + 1, np.int64)
        np.add.at(keep, ends[:-1][listed], 1)
        np.add.at(keep, ends[1:][listed], -1)
        places.append(raw[np.cumsum(keep)[:-1] > 0].view("<u2").astype(np.int64))
        sets.append(np.repeat(np.flatnonzero(listed), n[listed]))
    for i in np.flatnonzero(~listed).tolist():
        found = np.flatnonzero(np.unpackbits(raw[ends[i] : ends[i + 1]]))
        places.append(found)
        sets.append(np.full(len(found), i))
    return (np.concatenate(sets), np.concatenate(places)) if sets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Chunk:
    """Documents and links of a chunk until it is full."""

    def __init__(self, number: int, bits: int, bits_b: int, most: int):
        assert bits + 13 <= 63 and most <= CHUNK_DOCS
        self.number, self.bits_b, self.most, self.rows, self.keys, self.links = number, bits_b, most, [], [], 0

    def add(self, doc_id, counts: np.ndarray, digest: str, pairs: np.ndarray) -> None:
        self.keys.append((pairs << 13) | len(self.rows))
        self.rows.append((doc_id, *counts.tolist(), digest))
        self.links += len(pairs)

    def full(self) -> bool:
        return len(self.rows) >= self.most or self.links >= CHUNK_LINKS

    def _postings(self):
        keys = np.concatenate(self.keys)
        self.keys = []
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        more = np.diff(first, append=len(keys)) - 1
        keys = keys[first]
        for plane in range(1 + int(more.max()).bit_length() if len(more) else 0):
            held = keys if plane == 0 else keys[(more >> (plane - 1)) & 1 == 1]
            if not len(held):
                continue
            begin = np.flatnonzero(np.concatenate([[True], held[1:] >> 13 != held[:-1] >> 13]))
            of = np.diff(np.concatenate([begin, [len(held)]]))
            for which, docs in containers(held & 8191, of, len(self.rows)):
                yield held[begin[which]] >> 13, plane, of[which], docs

    def batches(self, schema: pa.Schema):
        def batch(size: int, **columns):
            fill = {f.name: columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema}
            return pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(fill.values(), schema, strict=True)], schema=schema)

        n = len(self.rows)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        columns = {c: pa.array(list(x), schema.field(c).type) for c, x in zip(names, zip(*self.rows, strict=True), strict=True)}
        yield batch(n, chunk=pa.array(np.full(n, self.number)), pos=pa.array(np.arange(n, dtype=np.int32)), **columns)
        for pair, plane, of, docs in self._postings():
            for k in range(0, len(pair), 50_000):
                some = pair[k : k + 50_000]
                yield batch(
                    len(some), chunk=pa.array(np.full(len(some), self.number)), a=pa.array((some >> self.bits_b).astype(np.int32)),
                    b=pa.array((some & ((1 << self.bits_b) - 1)).astype(np.int32)), plane=pa.array(np.full(len(some), plane, np.int32)),
                    n=pa.array(of[k : k + 50_000].astype(np.int32)), docs=docs.slice(k, len(some)),
                )


_aligners: dict[tuple, Aligner] = {}


def aligner(spec: str, model: bytes, most: int) -> Aligner:
    """One in a Python worker, so that what it remembers serves all the worker's tasks."""
    key = (hash(spec), hash(model), most)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(spec, model, most)
    return _aligners[key]


def inverted(documents: DataFrame, path_a: str, path_b: str, most: int = MOST, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Written table: rows of documents (chunk, pos, doc_id, COUNTS) and of postings (chunk, a, b, plane, n, docs)."""
    spec = load(path_a)
    with open(path_b, "rb") as f:
        model = f.read()
    sent = documents.sparkSession.sparkContext.broadcast((spec, model))
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MADE.split(", ")])

    def run(batches):
        made = aligner(*sent.value, most)
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        chunk = Chunk(next(numbers), made.bits, made.bits_b, chunk_docs)
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), made.documents(batch.column(1).to_pylist()), strict=True):
                chunk.add(doc_id, *x)
                if chunk.full():
                    yield from chunk.batches(schema)
                    chunk = Chunk(next(numbers), made.bits, made.bits_b, chunk_docs)
        if chunk.rows:
            yield from chunk.batches(schema)
        give_back()

    return written(map_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, MADE), "align-inverted")


def pair_counts(inverted: DataFrame) -> DataFrame:
    """a, b, docs (documents that hold the pair linked), links (link occurrences), best (docs is its A id's highest)."""
    weight = F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")
    pairs = inverted.filter("a is not null").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(F.lit(0))).cast("long").alias("docs"), F.sum(F.col("n") * weight).alias("links")
    )
    pairs = written(pairs, "align-pairs")
    tops = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    return pairs.join(tops, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("top")).alias("best"))


def returned(inverted: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk, pos, n_best, count_sum: the counts of pairs taken back along the postings."""
    counts = written(counts.select("a", "b", F.col("docs").alias("count"), "best"), "align-counts")
    rows = counts.count()
    postings = inverted.filter("a is not null").select("chunk", "a", "b", "plane", "n", F.col("docs").alias("held"))
    met = postings.join(small_or_shuffled(counts, rows, BROADCAST_ROWS), ["a", "b"]).select("chunk", "plane", "n", "count", "best", "held")
    if rows > BROADCAST_ROWS:  # else a chunk's postings are still together, as they were written
        met = met.repartition(parts_for(met.sparkSession), "chunk")
    out = pa.schema([("chunk", pa.int64()), ("pos", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def rows():
            for chunk, (best, total) in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], schema=out)
            sums.clear()

        for batch in batches:
            chunk, plane, n, count = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            best = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
            which, places = members(batch.column(5), n)
            for c in np.unique(chunk).tolist():
                own = chunk[which] == c
                if c not in sums:
                    if len(sums) >= 256:
                        yield from rows()
                    sums[c] = np.zeros((2, CHUNK_DOCS), np.int64)
                for row, value in enumerate((best * weight, count * weight)):
                    # Sums of a batch stay far below 2^53, so they are exact.
                    sums[c][row] += np.bincount(places[own], value[which[own]], minlength=CHUNK_DOCS).astype(np.int64)
        yield from rows()
        give_back()

    return map_batches(met, run, "chunk long, pos int, n_best long, count_sum long").groupBy("chunk", "pos").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(documents: DataFrame, path_a: str, path_b: str, most: int = MOST, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """One row per document: doc_id, COUNTS, n_best (links whose count is their A id's highest), count_sum (counts over links)."""
    table = inverted(documents, path_a, path_b, most, chunk_docs)
    sums = written(returned(table, pair_counts(table)), "align-sums")
    docs = written(table.filter("pos is not null").select("chunk", "pos", "doc_id", *[c.split()[0] for c in COUNTS.split(", ")]), "align-docs")
    dropped(table)
    out = docs.join(sums, ["chunk", "pos"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
