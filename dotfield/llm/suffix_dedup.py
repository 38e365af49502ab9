"""Long repeated substrings of a whole corpus by prefix-free parsing, and texts without them.

A place is repeated if the LENGTH bytes that start there also start anywhere else, in any document. Its suffix, to that
depth, decides; so suffixes are brought into classes of equal beginnings through a parse of the texts:

- Triggers. A rolling hash runs over all strings of GRAM bytes. The trigger of a place is the least hash of those inside its LENGTH bytes,
  so it depends on these bytes alone, and no text can be without one.
- Phrases. Neighbouring places with one trigger are a phrase: their run with the LENGTH - 1 bytes that follow the last, by which
  phrases overlap. The parse of a text is its row of phrases; the dictionary has each distinct phrase once, with its number of places in
  the parse. A trigger that occurs once in the corpus settles its phrase: nothing in it is repeated.
- A phrase with two places in the parse has all its places repeated, and is not looked into. This is what makes the method fit for highly repetitive text.
- Suffixes of the dictionary. Where a trigger has several phrases and one of them stands alone, the suffixes of its phrases are compared: first in strips of
  STRIP neighbouring places around a common core of LENGTH - STRIP + 1 bytes, named by 128 bits; equal strips are one class, a core that
  has one strip is settled. Only strips that differ about one core are taken apart into places, each of which is the core's name and the other bytes. A suffix class is repeated if dictionary and parse together give it two places.

Names take the part of ranks, as in prefix doubling, since to a fixed depth only equality counts: no task sorts a text, a bucket of suffixes
or a trigger's group. Everything is joins and groups by name, with counts made before the shuffle; phrases and strips carry their place,
so doing a task again changes nothing. Texts are read three times: for the parse, for phrases to look into, and to cut.

Cases. Null counts as empty; a text below LENGTH bytes has no place and keeps all. Equal texts, repeated rows and null ids each
count as documents. Periodic texts repeat themselves: a phrase in which its trigger occurs twice is always looked into. A cut may part a
character of several bytes; the rest is bytes. Very long texts are hashed in blocks of BLOCK places. An empty table gives an empty table. Further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, give_back, map_batches, small_or_shuffled, written

LENGTH, GRAM = 200, 64
#: Neighbouring places of a strip; their windows differ from the core they share by STRIP - 1 bytes.
STRIP = 16
BLOCK = 1 << 20
#: Triggers (16 bytes each in memory) are broadcast up to so many, else shuffled.
BROADCAST_TRIGGERS = 2_000_000
PARSED = "t1 long, t2 long, start int, places int, trigger long, name long, again boolean"
STRIPS = "c1 long, c2 long, low int, high int, before binary, after binary, many boolean, t1 long, t2 long, start int"

_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def rolling(x: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of x[i : i + gram] for each i; gram is a power of two."""
    h, power, n = _BYTE[x], _BASE, 1
    with np.errstate(over="ignore"):
        while n < gram:
            h = h[:-n] * power + h[n:] if len(h) > n else h[:0]
            power, n = power * power, 2 * n
        h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[i : i + width] for each i."""
    n, k, m = len(v) - width + 1, 1, v
    while 2 * k <= width:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return np.minimum(m[:n], m[width - k : width - k + n])


def phrases(x: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(text, start, places, trigger, again) arrays of the phrases of texts that lie one after the other in x and end at ends.

    again: the trigger's string may occur twice in the phrase; it does at least once more in the block.
    """
    begins = np.concatenate([[0], ends[:-1]])
    for base in range(0, len(x) - length + 1, BLOCK):
        part = x[base : base + BLOCK + length - 1]
        v = rolling(part)
        low = least(v, length - GRAM + 1)
        at = np.arange(base, base + len(low))
        text = np.searchsorted(ends, at, "right")
        inside = at + length <= ends[np.minimum(text, len(ends) - 1)]
        new = np.empty(len(low), bool)
        new[0] = True
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
        # A run ends before the first place whose window leaves the text.
        first = np.flatnonzero(new & inside)
        last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        trigger = low[first]
        v.sort()
        again = np.searchsorted(v, trigger, "right") - np.searchsorted(v, trigger) > 1
        yield text[first], at[first] - begins[text[first]], last - first + 1, trigger, again


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after the other, and where each ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def _key() -> list:
    """Names of a text: equal texts have equal ones."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(13), "text").alias("t2"), F.col("text").cast("binary").alias("data")]


def parse(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The phrases of every text: PARSED."""
    texts = documents.select(F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= length).select(*_key())
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("places", pa.int32()), ("trigger", pa.int64()), ("name", pa.int64()), ("again", pa.bool_())])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, ends = _bytes_of(batch.column(2))
            t1, t2, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), memoryview(x)
            begins = np.concatenate([[0], ends[:-1]])
            for text, start, places, trigger, again in phrases(x, ends, length):
                at = begins[text] + start
                name = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(at.tolist(), (at + places + length - 1).tolist(), strict=True)), np.uint64, len(at))
                columns = [t1[text], t2[text], start.astype(np.int32), places.astype(np.int32), trigger.view(np.int64), name.view(np.int64), again]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
        give_back()

    return map_batches(texts, run, PARSED)


def _by_text(rows: DataFrame, *values: str) -> DataFrame:
    """t1, t2 and the rows of each text as one list, which is no longer than the text."""
    return rows.groupBy("t1", "t2").agg(F.collect_list(F.struct(*values)).alias("rows"))


def _met(texts: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """texts (t1, t2, data, ...) with the list of their rows; lists are broadcast if their counted bytes are few, else both are shuffled."""
    lists = written(lists, name)
    size = lists.agg(F.coalesce(F.sum(F.size("rows") * 24 + 64), F.lit(0))).first()[0]
    return texts.join(small_or_shuffled(lists, size, 64 << 20), ["t1", "t2"], how)


def strips(documents: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """The strips of wanted phrases (t1, t2, start, places, trigger, many): STRIPS; the text is told for phrases of one place alone.

    A place that is `back` bytes before the core's start has `back` bytes of its window before the core and the rest of STRIP - 1 after it;
    a strip has those of its places from low to high.
    """
    texts = documents.select(F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= length).select(*_key())
    met = _met(texts, _by_text(wanted, "start", "places", "trigger", "many"), "suffix-wanted", "inner")
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in STRIPS.split(", ")])
    rest = STRIP - 1

    def of_some(x, v, low_at, data, begin, start, places, trigger, many, t1, t2):
        """Strips of phrases at begin + start in x; v are the hashes of x from low_at on."""
        at = begin + start
        spans = places + length - GRAM
        owner = np.repeat(np.arange(len(at)), spans)
        where = np.repeat(at - np.cumsum(spans) + spans, spans) + np.arange(len(owner))
        hit = v[where - low_at] == trigger[owner]
        far = np.int64(len(x) + 1)
        found = owner[hit] * far + where[hit]
        owner = np.repeat(np.arange(len(at)), places)
        place = np.repeat(at - np.cumsum(places) + places, places) + np.arange(len(owner))
        anchor = found[np.searchsorted(found, owner * far + place)] - owner * far
        core = anchor - (anchor - place) // STRIP * STRIP
        first = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.append(first[1:], len(core)) - 1
        core, f, owner = core[first], place[first], owner[first]
        low, high, end = core - place[last], core - f, core + length - rest
        cut = lambda a, b: [bytes(data[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        names = b"".join(xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(core.tolist(), end.tolist(), strict=True))
        names = np.frombuffer(names, np.int64).reshape(-1, 2)
        alone = ~many[owner]
        told = lambda c: pa.array(c, mask=~alone)
        columns = [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(cut(f, core), pa.binary()), pa.array(cut(end, end + rest - low), pa.binary())]
        columns += [pa.array(many[owner]), told(t1[owner]), told(t2[owner]), told((f - begin[owner]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, ends = _bytes_of(batch.column(2))
            lists = batch.column(3)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            start, places, trigger, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            begin = np.concatenate([[0], ends[:-1]])[row]
            t1, t2 = (batch.column(k).to_numpy()[row] for k in range(2))
            at = begin + start
            order = np.argsort(at, kind="stable")
            begin, start, places, trigger, many, t1, t2, at = (c[order] for c in (begin, start.astype(np.int64), places.astype(np.int64), trigger.view(np.uint64), many.astype(bool), t1, t2, at))
            k = 0
            while k < len(at):  # as many phrases as lie in a block
                stop = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK)))
                end = int((at[k:stop] + places[k:stop]).max()) + length - 1
                yield of_some(x, rolling(x[at[k] : end]), at[k], memoryview(x), begin[k:stop], start[k:stop], places[k:stop], trigger[k:stop], many[k:stop], t1[k:stop], t2[k:stop])
                k = stop
        give_back()

    return map_batches(met.select("t1", "t2", "data", "rows"), run, STRIPS)


def _repeated_strips(table: DataFrame) -> DataFrame:
    """t1, t2, start, places of the repeated places of strips that have one place alone."""
    kind = F.xxhash64("low", "high", "before", "after").alias("kind")
    place = F.xxhash64("t1", "t2", "start")
    classes = table.groupBy("c1", "c2", "low", "high", "before", "after").agg(
        F.max("many").alias("many"), F.min(place).alias("one"), F.max(place).alias("other"), F.min(F.when(F.col("start").isNotNull(), F.struct("t1", "t2", "start"))).alias("at")
    )
    classes = classes.withColumn("full", F.col("many") | (F.col("one") != F.col("other"))).withColumn("kind", kind).drop("one", "other", "many")
    classes = written(classes, "suffix-classes")
    cores = classes.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("settled")).filter("n > 1 and not settled").select("c1", "c2")
    # A place is so many bytes before the core, and as many of the following ones as fill the window.
    ext = f"concat(substring(before, length(before) - back + 1, back), substring(after, 1, {STRIP - 1} - back))"
    apart = classes.join(cores, ["c1", "c2"]).withColumn("back", F.explode(F.sequence("low", "high"))).withColumn("ext", F.expr(ext))
    apart = apart.select("c1", "c2", "back", "ext", "full", F.when(~F.col("full"), F.struct("at.*", "high")).alias("at"))
    apart = written(apart, "suffix-apart")
    places = apart.groupBy("c1", "c2", "back", "ext").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full")).filter("n > 1 or full").select("c1", "c2", "back", "ext")
    part = apart.filter("not full").join(places, ["c1", "c2", "back", "ext"]).select("at.t1", "at.t2", (F.col("at.start") + F.col("at.high") - F.col("back")).alias("start"), F.lit(1).alias("places"))
    full = classes.filter("full and at is not null").select("c1", "c2", "kind")
    hit = table.filter("not many").select("c1", "c2", kind, "t1", "t2", "start", (F.col("high") - F.col("low") + 1).alias("places")).join(full, ["c1", "c2", "kind"])
    return hit.select("t1", "t2", "start", "places").unionByName(part)


def repeated_places(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2 (a text's names), start, places: the runs of places whose length bytes start elsewhere too."""
    parsed = written(parse(documents, length), "suffix-parse")
    again = parsed.groupBy("trigger").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).filter("n > 1").select("trigger")
    again = written(again, "suffix-triggers")
    kept = written(parsed.join(small_or_shuffled(again, again.count(), BROADCAST_TRIGGERS), "trigger"), "suffix-kept")
    dropped(parsed, again)
    at = F.struct("t1", "t2", "start", "places")
    dictionary = kept.groupBy("trigger", "name").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.min(at).alias("at"))
    dictionary = written(dictionary, "suffix-dictionary")
    triggers = dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases"), F.min("n").alias("least"), F.max("again").alias("again"))
    open_ = triggers.filter("least = 1 and (phrases > 1 or again)").select("trigger")
    wanted = dictionary.join(open_, "trigger").select("at.*", "trigger", (F.col("n") > 1).alias("many"))
    table = written(strips(documents, wanted, length), "suffix-suffixes")
    often = dictionary.filter("n > 1").select("trigger", "name")
    full = kept.join(often, ["trigger", "name"]).select("t1", "t2", "start", "places")
    return _runs(full.unionByName(_repeated_strips(table)).distinct())  # copies of a text tell the same


def _runs(places: DataFrame) -> DataFrame:
    """Runs of places (t1, t2, start, places) that touch or overlap as one."""
    text = W.partitionBy("t1", "t2").orderBy("start", "places")
    reach = F.max(F.col("start") + F.col("places")).over(text.rowsBetween(W.unboundedPreceding, -1))
    marked = places.withColumn("begins", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    marked = marked.withColumn("run", F.sum("begins").over(text.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy("t1", "t2", "run").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("places")) - F.min("start")).alias("places")).drop("run")


def cut(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document (doc_id) with n_bytes, n_removed, n_spans and kept, the bytes that no repeated string covers."""
    lists = _by_text(repeated_places(documents, length), "start", "places")
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", *_key())
    met = _met(texts, lists, "suffix-places", "left").select(F.col("doc_id").cast("long"), "data", "rows")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def one(data: bytes, rows: list | None):
        if not rows:
            return len(data), 0, 0, data
        start, places = (np.array([r[c] for r in rows], np.int64) for c in ("start", "places"))
        n = len(data)
        step = np.bincount(start, minlength=n + 1) - np.bincount(start + places - 1 + length, minlength=n + 1)
        gone = np.cumsum(step[:n]) > 0
        return n, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()

    def run(batches):
        for batch in batches:
            made = [one(data, rows) for data, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [list(c) for c in zip(*made, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)
        give_back()

    return map_batches(met, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    return cut(documents, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
