"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

The global order of n-grams is that of a 64-bit hash. It is cut into fragments, so each document's set falls into
segments, and each fragment is worked on by itself:

* Candidates. If two sets reach the threshold, few n-grams are in only one of them. With more non-empty segments than
  that, some segments are the same in both (pigeonhole), so equal segments are the only pairs to look at. The number of
  segments depends on a class of set sizes; a set files under its own class and the next, as a partner may be there.
  Signatures of segments go packed to buckets, and only those that several sets have go on. Of these a set leaves out the
  commonest, as many as the pigeonhole spares. A set with too many empty segments also files the first n-grams of its order
  one by one: if both sets of a pair lack segments, both are filed so. No pair is lost.
* Overlaps. A pair's partial overlap is counted in each fragment of about 200 n-grams, and the counts are summed per pair.

Equal sets are one node. Only links between what is not yet one component matter for the components. So first each group of
sets with one segment is a star around its smallest node. Groups that are still apart then give a spanning forest of
their possible links: a sketch of parity bits, as wide as the set is large, bounds from below how many n-grams are in only one of
two sets, and pairs within the bound join trees, the nearest first. Groups in which a counted pair failed give another forest without
it. After some rounds they give all pairs within the bound that are still apart: near misses, which have to be counted one
by one. Pairs that a sketch rules out are never rows. Components are those of all links.

N-grams are compared by 64-bit hashes. Sets of equal 64-bit name count as equal after another 64-bit name has been
compared; on a clash all sets are named anew.

Cases. Null, empty and blank texts have no n-gram and link with nothing. A text of fewer words is one n-gram. Repeated rows
and null ids: equal texts are one component, whose id is the smallest non-null id (a null id alone stays null). Ties among
segments or pairs change the order of work and no result. Very long texts are hashed in one piece of memory of 8 bytes
per byte of text. An empty table gives an empty table. Further columns are not read by components() and are kept, under
any name, by one_of_each().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, dropped, give_back, map_batches, parts_for, small_or_shuffled, without, written

_U = np.uint64
#: Bits of a signature that are kept for its hash; the lowest two are flags.
_KEPT = _U(2**64 - 4)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(1234567).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed at once.
PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * _U(pow(base, done, 2**64))
        done += k
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of hashed word n-grams of texts given as UTF-8 bytes."""

    def __init__(self, n: int):
        self.n = n
        self.size = 0
        self.grow(PIECE)

    def grow(self, size: int) -> None:
        if size > self.size:
            self.size = size
            self.up = _powers(int(_BASE), size + 1)
            self.down = _powers(pow(int(_BASE), -1, 2**64), size + 1)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of data."""
        self.grow(len(data))
        blank = np.empty(len(data) + 2, bool)
        blank[0] = blank[-1] = True
        blank[1:-1] = _SPACE[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=total[1:])
        return mix64((total[end] - total[start]) * self.down[start] + (end - start).astype(_U)), start

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each text its sorted distinct n-gram hashes."""
        out: list[np.ndarray] = []
        pieces, size = [], 0
        for t in texts:
            t = (t or b"").lower()
            if pieces and size + len(t) > PIECE:
                out += self._sets(pieces)
                pieces, size = [], 0
            pieces.append(t)
            size += len(t) + 1
        return out + self._sets(pieces) if pieces else out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        hashes, start = self.words(data)
        ends = np.cumsum([len(t) + 1 for t in texts])
        at = [0, *np.searchsorted(start, ends).tolist()]
        grams = np.zeros(max(0, len(hashes) - self.n + 1), _U)
        for k in range(self.n):
            grams = mix64(grams + hashes[k : k + len(grams)] + _U(k + 1)) if k else mix64(hashes[: len(grams)] + _U(1))
        out = []
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= self.n:
                out.append(np.unique(grams[a : b - self.n + 1]))
            elif b > a:
                h = mix64(hashes[a : a + 1] + _U(1))
                for k in range(1, b - a):
                    h = mix64(h + hashes[a + k : a + k + 1] + _U(k + 1))
                out.append(mix64(h + _U((b - a) << 40)))
            else:
                out.append(np.zeros(0, _U))
        return out


class Segments:
    """What a set files: signatures of its segments, for pairs with 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 2**40:
            self.bounds.append(100 * self.bounds[-1] // percent + 1)
        self.low = np.array(self.bounds)

    def differing(self, key: int) -> int:
        """The most n-grams in only one of two linked sets whose smaller one has fewer than bounds[key] n-grams."""
        return (100 - self.percent) * (100 * (self.bounds[key] - 1) // self.percent) // 100

    def number(self, key: int) -> int:
        d = self.differing(key)
        return d + 1 + (d * 8 + 99) // 100 + (2 if d else 0)

    def own(self, n: int) -> int:
        """The class of a set of n n-grams; it files under this key and the next."""
        return int(np.searchsorted(self.low, n, "right")) - 1

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Signatures of a sorted set, and for its even and its odd key how many of the commonest ones are not needed.

        The lowest bit of a signature is that of its key, the next one tells single n-grams, which are all needed.
        """
        spare = [0, 0]
        if not len(grams):
            return np.zeros(0, _U), spare
        own = self.own(len(grams))
        out, high, mixed = [], grams >> _U(32), mix64(grams)
        for key in (own, own + 1):
            d = self.differing(key)
            if d == 0:  # only equal sets link, and they are one node
                continue
            part = (high * _U(self.number(key))) >> _U(32)
            first = np.flatnonzero(np.diff(part, prepend=_U(2**63)))
            sums = np.add.reduceat(mixed, first)
            sums = (mix64(sums + mix64(part[first] + _U(key << 32))) & _KEPT) | _U(key & 1)
            sums.sort()
            sums = sums[np.diff(sums, prepend=_U(2**64 - 1)) != 0]
            out.append(sums)
            spare[key & 1] = max(0, len(sums) - d - 1)
            if len(first) <= d:
                out.append((mix64(grams[: self.prefix(len(grams))] ^ _U(key * 0x9E3779B1)) & _KEPT) | _U(2 | key & 1))
        return np.concatenate(out) if out else np.zeros(0, _U), spare

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(flat)))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary"))


def node_ids(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for each set, of its size and the sum of its mixed hashes, and another to check it by; 0 for an empty set."""
    out = []
    sizes = np.array([len(s) for s in sets], _U)
    for k in (2 * seed, 2 * seed + 1):
        sums = np.array([mix64(s + _U(k * 0x632BE59BD9B4E019 % 2**64)).sum(dtype=_U) for s in sets], _U)
        out.append(np.where(sizes > 0, np.maximum(mix64(sums + (sizes << _U(20))), _U(1)), _U(0)))
    return out[0], out[1]


ROW = "kind byte, bucket long, doc_id long, text_key long, n_shingles long, node long, other_name long, spare_even int, spare_odd int, sigs binary, nodes binary, sig long, seen int"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
DOCUMENT, PACKED, REPEATED = 0, 1, 2


def _batch(k: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"byte": pa.int8(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(k, t) for c, t in zip(COLUMNS, types, strict=True)], COLUMNS)


class Filing:
    """Collects (signature, node) pairs of a task and gives them as packed rows, one per bucket: 4 bytes of a signature and 8 of a node."""

    def __init__(self, bits: int, common: int):
        self.bits, self.common, self.turn = bits, common, 0
        self.sigs: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.held = 0

    def add(self, sigs: np.ndarray, node) -> None:
        self.sigs.append(sigs)
        self.nodes.append(np.full(len(sigs), node, _U))
        self.held += len(sigs)

    def rows(self):
        if not self.held:
            return
        sigs, nodes = np.concatenate(self.sigs), np.concatenate(self.nodes)
        self.sigs, self.nodes, self.held = [], [], 0
        order = np.argsort(sigs, kind="stable")
        sigs, nodes = sigs[order], nodes[order]
        begin = np.flatnonzero(np.diff(sigs, prepend=sigs[0] ^ _U(1)))
        many = np.diff(np.append(begin, len(sigs))) > self.common
        if many.any():  # a very common signature is no task's: it goes round its bucket, which is only told that it is common
            hot = np.repeat(many, np.diff(np.append(begin, len(sigs))))
            yield self._spread(sigs[hot], nodes[hot])
            told = sigs[begin[many]]
            sigs, nodes = np.concatenate([sigs[~hot], told]), np.concatenate([nodes[~hot], np.zeros(len(told), _U)])
            order = np.argsort(sigs, kind="stable")
            sigs, nodes = sigs[order], nodes[order]
        bucket, rest = _parts(sigs, self.bits)
        cut = np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ _U(1)))
        ends = np.append(cut[1:], len(bucket))
        packed = [(rest[a:e].tobytes(), nodes[a:e].tobytes()) for a, e in zip(cut.tolist(), ends.tolist(), strict=True)]
        k = len(packed)
        for at in range(0, k, 512):
            some = packed[at : at + 512]
            yield _batch(len(some), kind=pa.array([PACKED] * len(some), pa.int8()), bucket=pa.array(_signed(bucket[cut[at : at + 512]].copy())), sigs=pa.array([x[0] for x in some], pa.binary()), nodes=pa.array([x[1] for x in some], pa.binary()))

    def _spread(self, sigs: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        bucket, rest = _parts(sigs, self.bits)
        at = mix64(nodes) >> _U(64 - self.bits)
        k = len(sigs)
        return _batch(k, kind=pa.array(np.full(k, REPEATED, np.int8)), bucket=pa.array(_signed(at)), sig=pa.array(_signed((bucket << _U(32)) | rest)), node=pa.array(_signed(nodes)), seen=pa.array(np.full(k, COMMON, np.int32)))


def _parts(sigs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each signature (its first bits), and 30 bits after these with the two flags."""
    return sigs >> _U(64 - bits), (((sigs >> _U(34 - bits)) << _U(2)) | (sigs & _U(3))).astype(np.uint32)


#: The count of a signature that is in so many sets or more; all of these count alike.
COMMON = 1 << 20
#: Signatures that a task packs at once, and sets with one signature among them from which it counts as common.
PACK, OFTEN = 1 << 19, 256


def packed_rows(documents: DataFrame, n: int, percent: int, bits: int, seed: int) -> DataFrame:
    """Rows of ROW: of each document (kind DOCUMENT), and packed signatures of the tasks' distinct sets."""

    def run(batches):
        shingler, segments, seen, filing = Shingler(n), Segments(percent), set(), Filing(bits, OFTEN)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = shingler.sets(b.column(2).to_pylist())
                nodes, other = node_ids(sets, seed)
                spare = []
                for node, s in zip(nodes.tolist(), sets, strict=True):
                    sigs, left = segments.of(s)
                    spare.append(left)
                    if node not in seen and len(sigs):
                        filing.add(sigs, node)
                        if len(seen) < REMEMBERED:
                            seen.add(node)
                k = b.num_rows
                where = mix64(nodes + np.arange(k, dtype=_U)) >> _U(64 - bits)
                yield _batch(
                    k, kind=pa.array(np.full(k, DOCUMENT, np.int8)), bucket=pa.array(_signed(where)), doc_id=b.column(0), text_key=b.column(1), n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                    node=pa.array(_signed(nodes)), other_name=pa.array(_signed(other)), spare_even=pa.array([x[0] for x in spare], pa.int32()), spare_odd=pa.array([x[1] for x in spare], pa.int32()),
                )
                if filing.held >= PACK:
                    yield from filing.rows()
        yield from filing.rows()
        give_back()

    return map_batches(_keyed(documents), run, ROW)


#: Names of sets that a task remembers; sets beyond are filed again, which changes no result.
REMEMBERED = 200_000


def repeated(packed: list[tuple[bytes, bytes]], bucket: int) -> pa.RecordBatch | None:
    """The signatures of a bucket that several sets have, once for each set, with their count."""
    rest = np.concatenate([np.frombuffer(x[0], np.uint32) for x in packed])
    node = np.concatenate([np.frombuffer(x[1], _U) for x in packed])
    order = np.argsort(rest, kind="stable")
    rest, node = rest[order], node[order]
    size = np.diff(np.append(np.flatnonzero(np.diff(rest, prepend=~rest[0])), len(rest)))
    twice = np.repeat(size > 1, size)
    rest, node = rest[twice], node[twice]
    if not len(rest):
        return None
    order = np.lexsort((node, rest))
    rest, node = rest[order], node[order]
    first = np.ones(len(rest), bool)
    first[1:] = (rest[1:] != rest[:-1]) | (node[1:] != node[:-1])
    rest, node = rest[first], node[first]
    begin = np.flatnonzero(np.diff(rest, prepend=~rest[0]))
    size = np.diff(np.append(begin, len(rest)))
    told = node[begin] == 0  # common in some task
    count = np.repeat(np.where(told, COMMON, np.minimum(size, COMMON)), size)
    take = (np.repeat((size > 1) | told, size)) & (node != 0)
    k = int(take.sum())
    if not k:
        return None
    sig = (_U(bucket) << _U(32)) | rest[take].astype(_U)
    return _batch(k, kind=pa.array(np.full(k, REPEATED, np.int8)), bucket=pa.array(np.full(k, bucket, np.int64)), node=pa.array(_signed(node[take])), sig=pa.array(_signed(sig)), seen=pa.array(count[take].astype(np.int32)))


def filed(documents: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """A written table of documents and of repeated signatures, as ROW; other signatures are gone after one packed shuffle."""
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first().n or 0
    buckets = max(64, size // 2_500_000)  # about 250,000 signatures each
    bits = min(20, int(buckets).bit_length())

    def run(batches):
        held: list[tuple[bytes, bytes]] = []
        now = None
        for b in batches:
            kind = b.column(0).to_numpy()
            plain = np.flatnonzero(kind != PACKED)
            if len(plain):
                yield b.take(pa.array(plain))
            some = b.take(pa.array(np.flatnonzero(kind == PACKED)))
            for bucket, s, v in zip(some.column(1).to_pylist(), some.column(9).to_pylist(), some.column(10).to_pylist(), strict=True):
                if held and bucket != now:
                    if (out := repeated(held, now)) is not None:
                        yield out
                    held = []
                now = bucket
                held.append((s, v))
        if held and (out := repeated(held, now)) is not None:
            yield out
        give_back()

    rows = packed_rows(documents, n, percent, bits, seed).repartition(parts_for(documents.sparkSession, size), "bucket").sortWithinPartitions("bucket")
    return written(map_batches(rows, run, ROW).drop("sigs", "nodes", "bucket"), "filed")


def named(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """filed(), in which equal names mean equal sets: if two names of a set disagree, all are named anew."""
    for seed in range(8):
        rows = filed(documents, n, percent, seed)
        clash = rows.filter(F.col("kind") == DOCUMENT).groupBy("node").agg(F.min("other_name").alias("low"), F.max("other_name").alias("high")).filter("low <> high")
        if clash.isEmpty():
            return rows
        dropped(rows)
    raise RuntimeError("names of sets clash under every seed")


def grain(size: int, per: int = 256) -> int:
    """A set of this size is cut into 2 ** grain fragments, of 128 to 256 n-grams where it has more than that."""
    return (size // per).bit_length()


def sketch_bits(n: int) -> int:
    """Bits of a set's sketch: a power of two, between once and twice the set's size, 512 at least."""
    return max(512, 1 << int(n).bit_length())


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of n-grams in buckets: two sets' sketches differ in no more bits than the sets in n-grams."""
    bits = sketch_bits(len(grams))
    odd = np.bincount((mix64(grams) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fragments_of(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """node, n (set size), grain, part, grams, sketch: each set cut at fixed places of the global order.

    A set whose larger partner may be cut finer is also cut so. documents: the wanted node, and text. The sketch of the
    whole set is in its first part only.
    """

    def make():
        shingler, seen = Shingler(n), set()

        def f(whole: pa.RecordBatch):
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for node, s in zip(b.column(0).to_pylist(), shingler.sets(b.column(1).to_pylist()), strict=True):
                    if node in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(node)
                    bits: list | None = sketch(s).tolist()
                    for g in sorted({grain(len(s)), grain(100 * len(s) // percent)}):
                        part = s >> _U(64 - g) if g else np.zeros(len(s), _U)
                        first = np.flatnonzero(np.diff(part, prepend=_U(2**64 - 1)))
                        for a, e in zip(first.tolist(), [*first[1:].tolist(), len(s)], strict=True):
                            for c, v in zip(cols, (node, len(s), g, int(part[a]), s[a:e], bits), strict=True):
                                c.append(v)
                            bits = None
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), _lists(cols[4]), pa.array(cols[5], pa.list_(pa.int64()))], ["node", "n", "grain", "part", "grams", "sketch"])

        return f

    return arrow_map(documents, "node long, n long, grain long, part long, grams array<bigint>, sketch array<bigint>", make)


def _apart(a: str, b: str) -> Column:
    """In how many bits two sketches differ, the wider one folded to the other's width."""

    def fold(x, y):
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))

    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


#: Sets of one group, or pairs of one set, that meet in one place.
SIDE = 256


def frequent_ends(pairs: DataFrame) -> DataFrame | None:
    """end (a or b), node, k: the nodes that meet their pairs in k shares of about SIDE each; None if there are none."""
    ends = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("node")), F.struct(F.lit("b").alias("end"), F.col("b").alias("node")))).alias("x"))
    many = ends.groupBy("x").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > SIDE)
    many = written(many.select("x.end", "x.node", F.ceil(F.col("k") / SIDE).cast("int").alias("k")), "frequent-ends")
    return None if many.isEmpty() else many


def _met(pairs: DataFrame, many: DataFrame | None, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """pairs (a, b, ...) joined with a table for each end, on that end and further keys.

    A node of frequent_ends() meets its pairs in shares, for each of which its rows are repeated; so no task has all.
    """
    shares = []
    if many is not None:
        rows, k = many.count(), F.coalesce("k", F.lit(1))
        tables = dict(tables)
        for end, other in (("a", "b"), ("b", "a")):
            side = small_or_shuffled(many.filter(F.col("end") == end).select(F.col("node").alias(end), "k"), rows)
            shares.append(f"__share_{end}")
            pairs = pairs.join(side, end, "left").withColumn(shares[-1], F.pmod(F.xxhash64(other), k).cast("int")).drop("k")
            tables[end] = tables[end].join(side, end, "left").withColumn(shares[-1], F.explode(F.sequence(F.lit(0), k - 1))).drop("k")
    for n, end in enumerate(("a", "b")):
        pairs = pairs.join(tables[end], [end, *shares[n : n + 1], *keys[end]])
    return pairs


def near_enough(pairs: DataFrame, many: DataFrame | None, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out: a, b, na, nb, grain. sizes: node, n, grain, sketch."""
    of = {x: sizes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("grain").alias("g" + x), F.col("sketch").alias("s" + x)) for x in ("a", "b")}
    both = _met(pairs, many, of, {"a": [], "b": []})
    near = both.filter((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    near = near.filter(_apart("sa", "sb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return near.select("a", "b", "na", "nb", F.greatest("ga", "gb").alias("grain"))


def overlaps(near: DataFrame, many: DataFrame | None, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of near_enough() that link: partial overlaps are counted in each fragment and summed per pair."""
    of = {x: parts.select(F.col("node").alias(x), "grain", "part", F.col("grams").alias("x" + x)) for x in ("a", "b")}
    both = _met(near, many, of, {"a": ["grain"], "b": ["grain", "part"]})
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).cast("long").alias("shared"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def segment_groups(rows: DataFrame) -> DataFrame:
    """sig, node: the sets that have a signature, after each set has left out the commonest of its signatures.

    Of a set's a signatures under one key at most d are spoiled by n-grams that a linked set lacks, so it shares a - d of
    them; then the first d + 1 in any one order, here rarest first, share one (prefix filter). What many unlike sets have
    in common, such as a licence, is common and goes.
    """
    known = rows.filter((F.col("kind") == DOCUMENT) & (F.col("node") != 0)).groupBy("node").agg(F.max("spare_even").alias("spare_even"), F.max("spare_odd").alias("spare_odd"))
    odd, single = F.col("sig").bitwiseAND(F.lit(1)), F.col("sig").bitwiseAND(F.lit(2))
    commonest = W.partitionBy("node", odd, single).orderBy(F.col("seen").desc(), F.col("sig").desc())
    found = rows.filter(F.col("kind") == REPEATED).select("sig", "node", "seen").join(known, "node").withColumn("__at", F.dense_rank().over(commonest))
    kept = found.filter((single != 0) | (F.col("__at") > F.when(odd == 1, F.col("spare_odd")).otherwise(F.col("spare_even"))))
    return kept.select("sig", "node").dropDuplicates(["sig", "node"])


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with one row per group (sig, size, ...); groups over SIDE are few and are not met on their key."""
    big = groups.filter(F.col("size") > SIDE)
    big = small_or_shuffled(big, big.count())
    return rows.join(big, "sig").unionByName(rows.join(big.select("sig"), "sig", "left_anti").join(groups.filter(F.col("size") <= SIDE), "sig"))


def star_pairs(kept: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each group's smallest node with its others."""
    groups = written(kept.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("a")).filter("size > 1"), "group-sizes")
    return _with_group(kept, groups).filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _forest(node, label, n, bits, side, gone: dict[int, list[int]], percent: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of one block that may link, join different labels, and did not fail: a forest of near ones, or every one.

    side: 0 and 1 for residents and visitors, all 0 for a block with itself. gone: for a node the partners with which it failed.
    """
    two = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(node)),) * 2
    tree = np.unique(label, return_inverse=True)[1]  # grows together as trees are joined
    out: list[tuple[int, int]] = []
    for k, a in enumerate(left.tolist()):
        others = right if two else right[k + 1 :]
        others = others[tree[others] != tree[a]] if not every else others[label[others] != label[a]]
        if len(others):
            far = np.bitwise_count(bits[others] ^ bits[a]).sum(axis=1, dtype=np.int64)
            ok = (far * (100 + percent) <= (n[others] + n[a]) * (100 - percent)) & (n[others] * 100 >= n[a] * percent) & (n[a] * 100 >= n[others] * percent)
            if (lost := gone.get(int(node[a]))) is not None:
                ok &= ~np.isin(node[others], lost)
            hit = others[ok]
            if not every and len(hit):
                hit = hit[np.argsort(far[ok], kind="stable")]
                hit = hit[np.sort(np.unique(tree[hit], return_index=True)[1])]  # the nearest of each tree
                tree[np.isin(tree, tree[hit])] = tree[a]
            out += [(int(node[a]), x) for x in node[hit].tolist()]
    return list(dict.fromkeys((min(p), max(p)) for p in out))


def _folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches in rows, all folded to the narrowest one's width."""
    width = min(map(len, sketches))
    out = []
    for s in sketches:
        while len(s) > width:
            s = s[: len(s) // 2] ^ s[len(s) // 2 :]
        out.append(s)
    return np.stack(out).view(_U)


def apart_pairs(kept: DataFrame, labels: DataFrame, sizes: DataFrame, failed: DataFrame | None, percent: int, every: bool) -> DataFrame:
    """sig, a, b (a < b): pairs to count next, in groups of kept (sig, node) that hold more than one label.

    failed: (sig, a, b) that were counted in a group and do not link. A group over SIDE is cut into blocks of its sets; the
    sets that do not have the group's commonest label visit all blocks. A block's pairs are looked at in one piece of memory.
    """
    told = written(kept.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label")), "told")
    groups = told.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda c: F.ceil(c / SIDE).cast("int")
    groups = written(groups.select("sig", "size", F.col("most.label").alias("main"), blocks(F.col("size")).alias("rooms"), blocks(F.col("size") - F.col("most.n")).alias("tours")), "apart")
    rows = _with_group(told, groups).withColumns({"room": F.pmod(F.xxhash64("node"), F.col("rooms")).cast("int"), "tour": F.pmod(F.xxhash64("node", F.lit(1)), F.col("tours")).cast("int")})
    one, many = F.col("rooms") == 1, F.col("rooms") > 1
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.when(one, F.lit(0)).otherwise(F.col(c) - 1)))
    slim = ["sig", "node", "label"]
    residents = rows.select(*slim, F.col("room").alias("p"), up_to("tours").alias("q"), F.lit(0).alias("side"))
    visitors = rows.filter(many & (F.col("label") != F.col("main"))).select(*slim, up_to("rooms").alias("p"), F.col("tour").alias("q"), F.lit(1).alias("side"))
    asked = residents.unionByName(visitors).join(sizes.select("node", "n", "sketch"), "node").select("sig", "p", "q", "side", "node", "label", "n", "sketch")
    if failed is not None:
        lost = _with_group(failed.join(groups.select("sig"), "sig", "left_semi"), groups.select("sig", "size", "rooms", "tours"))
        lost = lost.unionByName(lost.withColumns({"a": F.col("b"), "b": F.col("a")}))
        lost = lost.select("sig", F.pmod(F.xxhash64("a"), F.col("rooms")).cast("int").alias("p"), F.when(one, F.lit(0)).otherwise(F.pmod(F.xxhash64("b", F.lit(1)), F.col("tours")).cast("int")).alias("q"), F.lit(2).alias("side"), F.col("a").alias("node"), F.col("b").alias("label"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("sketch"))
        asked = asked.unionByName(lost)

    def run(batches):
        def solve(rows: pa.Table):
            node, label, n, side = (rows.column(c).to_numpy() for c in ("node", "label", "n", "side"))
            gone: dict[int, list[int]] = {}
            for a, b in zip(node[side == 2].tolist(), label[side == 2].tolist(), strict=True):
                gone.setdefault(a, []).append(b)
            real = np.flatnonzero(side < 2)
            if not len(real):
                return []
            flat = rows.column("sketch").combine_chunks()
            values, offset = flat.values.to_numpy().view(_U), flat.offsets.to_numpy()
            bits = _folded([values[offset[k] : offset[k + 1]] for k in real.tolist()])
            return _forest(node[real], label[real], n[real], bits, side[real], gone, percent, every)

        def table(sig, pairs):
            return pa.RecordBatch.from_arrays([pa.array([sig] * len(pairs), pa.int64()), pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["sig", "a", "b"])

        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = np.column_stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
            if not len(keys):
                continue
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cut, cut[1:], strict=False):
                now = tuple(keys[s].tolist())
                if held and now != key:
                    if out := solve(pa.Table.from_batches(held)):
                        yield table(key[0], out)
                    held = []
                key = now
                held.append(b.slice(s, e - s))
        if held and (out := solve(pa.Table.from_batches(held))):
            yield table(key[0], out)
        give_back()

    spread = asked.repartition(parts_for(asked.sparkSession), "sig", "p", "q").sortWithinPartitions("sig", "p", "q")
    return map_batches(spread, run, "sig long, a long, b long")


def min_labels(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes of links (a, b).

    Each round takes the smallest label among the neighbours, tells it to the old label's node too, so that trees hang
    together, and then takes the label of that label; a chain of n nodes needs about log n rounds. Minima per node are taken
    before the shuffle; each round's labels are a written table.
    """
    both = written(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = written(labels, "labels")
    none = F.lit(None).cast("long")
    for k in range(rounds):
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", none.alias("old"))
        best = told.unionByName(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        hung = best.select(F.explode(F.array(F.struct("node", "label", "old"), F.struct(F.col("old").alias("node"), F.col("label"), none.alias("old")))).alias("x")).select("x.*")
        hung = written(hung.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), f"hung{k}")
        jump = hung.filter("node <> label").select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        labels = written(hung.join(jump, F.col("label") == F.col("__n"), "left").select("node", F.least("label", F.coalesce("__l", "label")).alias("label"), "old"), f"labels{k}")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
    raise RuntimeError("components did not settle")


def linked_nodes(documents: DataFrame, rows: DataFrame, n: int, percent: int, rounds: int = 2) -> DataFrame | None:
    """node, label for nodes that have links; None if there are no links. rows: what named() gave."""
    kept = written(segment_groups(rows), "segment-groups")
    pairs = written(star_pairs(kept), "star-pairs")
    if pairs.isEmpty():
        return None
    wanted = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "candidates")
    first = rows.filter(F.col("kind") == DOCUMENT).select("node", "doc_id", "text_key").join(small_or_shuffled(wanted, wanted.count()), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    first = written(first.select("node", F.col("row.doc_id").alias("__id"), F.col("row.text_key").alias("__key")), "representatives")
    texts = _keyed(documents).join(small_or_shuffled(first, first.count()), (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
    parts = written(fragments_of(texts, n, percent), "fragments")
    sizes = written(parts.filter("sketch is not null").dropDuplicates(["node"]).select("node", "n", "grain", "sketch"), "sketches")
    many = frequent_ends(pairs)
    near = written(near_enough(pairs, many, sizes, percent), "near-pairs")
    links = written(overlaps(near, many, parts, percent), "links")
    lost = written(near.select("a", "b").join(links, ["a", "b"], "left_anti"), "lost-pairs")
    labels = wanted.select("node", F.col("node").alias("label")) if links.isEmpty() else min_labels(links)
    failed = None
    for k in range(rounds + 1):
        asked = written(apart_pairs(kept, labels, sizes, failed, percent, every=k == rounds), f"asked{k}")
        if asked.isEmpty():
            break
        new = written(asked.select("a", "b").distinct().join(lost, ["a", "b"], "left_anti"), f"new-pairs{k}")
        many = frequent_ends(new)
        near = written(near_enough(new, many, sizes, percent), f"near-pairs{k}")
        if not near.isEmpty():
            found = written(overlaps(near, many, parts, percent), f"links{k}")
            lost = written(lost.unionByName(near.select("a", "b").join(found, ["a", "b"], "left_anti")), f"lost-pairs{k}")
            if not found.isEmpty():
                links = links.unionByName(found)
                labels = min_labels(links)
        if k == rounds or lost.isEmpty():
            break
        # Only a group in which a pair was lost may have other pairs to offer.
        again = asked.join(lost, ["a", "b"], "left_semi")
        failed = written(again if failed is None else failed.unionByName(again).distinct(), f"failed{k}")
        kept = kept.join(again.select("sig").distinct(), "sig", "left_semi")
        if again.isEmpty():
            break
    dropped(parts)
    return labels if not links.isEmpty() else None


def labelled(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document (a written table): doc_id, text_key, n_shingles, label (that of its component; null for empty texts)."""
    rows = named(documents, n, percent)
    labels = linked_nodes(documents, rows, n, percent)
    own = rows.filter(F.col("kind") == DOCUMENT).select("doc_id", "text_key", "n_shingles", "node")
    if labels is None:
        return own.select("doc_id", "text_key", "n_shingles", F.when(F.col("node") != 0, F.col("node")).alias("label"))
    return written(own.join(labels, "node", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("node") != 0, F.coalesce("label", "node")).alias("label")), "labelled")


def components(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included)."""
    rows = labelled(documents, n, percent)
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("label", "component_id")
    out = rows.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents without those that link, directly or not, with one of smaller id, then text key.

    A null id comes after all others. Rows alike in id and text stay or go together.
    """
    rows = labelled(documents, n, percent).filter("label is not null").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("row")).distinct()
    first = rows.groupBy("label").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    gone = rows.join(first.select("label", "first"), "label").filter("row > first")
    return without(documents, gone.select("row.doc_id", "row.text_key"), "near-copies")
