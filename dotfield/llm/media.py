"""Finding cropped and edited copies of images by local descriptors.

Keypoints are the strongest Harris corners of an image and of smaller versions of it (LEVELS, a factor of the fourth root of
two apart), as many as the image's area asks for. Each has the direction of its patch's intensity centroid, and 120 binary tests of
pairs of points, turned into that direction, as its descriptor; the patch is as wide as its level is coarse, so a copy of
another size has the same descriptors on other levels. Descriptors match within 9 bits: noise, blur, recompression, small turns
and rescaling leave enough keypoints of an image within that (see the README). Two such descriptors have one of five 24-bit
pairs of parts in which they differ in at most one bit. So descriptors are filed under their five pairs, looked up under
these and all values one bit away, and an equi-join on (pair, value) finds all matches. Values that many descriptors share are
salted. Matches of two images vote for the turn, scale and shift that take one to the other, in overlapping bins; enough
matches at different places in one bin are a copy.

Most matches are chance ones of a query's commonest descriptors, so pairs of images are found by the others: of 4 matches at different
places one at least is not at the query's 3 commonest places, and two are not at its 2 commonest. Only pairs of images that
pass both are compared whole. Any choice of places gives the same links; which are commonest is told by a sample of the index.

Images of equal pixels are one class, on either side: its representative is searched, its members are counted by a join.
links() gives all pairs of classes that are copies; find_copies() a row for each class of images with all its links, the one that
agrees most first, and copies_of_each() a row for each image. Descriptors in which nearly all tests agree (flat patches) are left out by a fixed
rule that looks at nothing but the descriptor.

Images here are grey pixels, one byte each, of any width and height. from_vectors() draws one for each vector: its numbers are
heights on a coarse grid, and sums of pairs of them on a finer one, in ranks, blown up by bilinear interpolation.

Cases. A null image, one whose bytes are not width x height, one with a side under 24 pixels, or a null vector, has no keypoints and matches nothing.
Repeated rows are members of one class, rows of one id with different pixels are images of their own. Null ids take no part. An image without corners matches nothing. Corners that tie in strength
are taken in reading order, queries that tie in matches by the smaller id. A very large image is described as a whole, in its task's memory. An empty table gives an empty
table. Further columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, dropped, small_or_shuffled, written

SIDE = 64
#: Sizes of the versions of an image, and the blur of all of them.
LEVELS, BLUR = (1.0, 0.8409, 0.7071, 0.5946, 0.5), 2
#: Corners of a level for 64 x 64 pixels of the whole image; larger images have more.
CORNERS = 12
LEAST_SIDE = 24
BITS, PARTS, WIDTH = 120, 10, 12
#: The most bits in which matching descriptors differ; below PARTS, so that one part is equal.
DIFFERENCE = 9
#: Parts are filed in pairs; of PAIRS pairs one differs in at most one bit, as DIFFERENCE < 2 * PAIRS.
PAIRS, PAIR_BITS = PARTS // 2, 2 * WIDTH
#: One in SAMPLED images tells which values are hot; a hot value is dealt out to shares of about HOT descriptors.
SAMPLED, HOT = 16, 4096
#: About so many keypoints of the index, of whole images, tell which places of a query are its commonest.
SURVEYED = 250_000
#: Two images are compared descriptor by descriptor if these are so many comparisons at most, else by the join.
WHOLE = 1 << 18
RADIUS = 9
_TESTS = np.clip(np.random.default_rng(77).normal(0, RADIUS / 2.2, (2, BITS, 2)), -RADIUS, RADIUS)


def _blown_up(grid: np.ndarray) -> np.ndarray:
    """(n, c, c) heights as (n, SIDE, SIDE), bilinear between the grid's points."""
    at = np.linspace(0, grid.shape[1] - 1, SIDE)
    low = np.minimum(at.astype(int), grid.shape[1] - 2)
    w = (at - low).astype(np.float32)
    rows = grid[:, low] * (1 - w)[None, :, None] + grid[:, low + 1] * w[None, :, None]
    return rows[:, :, low] * (1 - w)[None, None] + rows[:, :, low + 1] * w[None, None]


def draw(vectors: np.ndarray) -> np.ndarray:
    """(n, 64) numbers as (n, SIDE, SIDE) grey images: the numbers' ranks on a coarse grid, and as detail the ranks of their
    pairwise sums and differences on a finer one."""
    n, cells = len(vectors), int(vectors.shape[1] ** 0.5)
    ranks = lambda v: v.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable").astype(np.float32) / (v.shape[1] - 1)
    base = ranks(vectors).reshape(n, cells, cells)
    k = np.arange(vectors.shape[1])
    fine = np.stack([vectors[:, k] * (-1.0) ** (k + s) + vectors[:, (k * 5 + 11 * s + 3) % len(k)] for s in range(4)], axis=2)
    fine = ranks(fine.reshape(n, -1)).reshape(n, 2 * cells, 2 * cells)
    return np.rint(255 * (0.45 * _blown_up(base) + 0.55 * _blown_up(fine))).astype(np.uint8)


def _blur(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squares, borders repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float32)
        ahead, behind = [slice(None)] * 3, [slice(None)] * 3
        ahead[axis], behind[axis] = slice(2 * r + 1, None), slice(None, -(2 * r + 1))
        a = (c[tuple(ahead)] - c[tuple(behind)]) / (2 * r + 1)
    return a


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """(n, h, w) images as (n, height, width), bilinear between pixel centres."""
    out = images
    for axis, size in ((1, height), (2, width)):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        w = (at - low).astype(np.float32).reshape([-1 if k == axis else 1 for k in range(3)])
        out = np.take(out, low, axis) * (1 - w) + np.take(out, np.minimum(low + 1, n - 1), axis) * w
    return out


def corners(soft: np.ndarray, blur: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """image, y, x of the strongest corners of blurred images, `most` of each at most."""
    gy, gx = np.gradient(soft, axis=(1, 2))
    xx, yy, xy = _blur(gx * gx, blur + 1), _blur(gy * gy, blur + 1), _blur(gx * gy, blur + 1)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    m = RADIUS // 2
    inner = r[:, m:-m, m:-m]
    top = np.ones(inner.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                top &= inner > r[:, m + dy : r.shape[1] - m + dy, m + dx : r.shape[2] - m + dx]
    value = np.where(top & (inner > 1e-3), inner, 0).reshape(len(soft), -1)
    best = np.argsort(-value, axis=1, kind="stable")[:, :most]
    strong = np.take_along_axis(value, best, 1) > 0
    y, x = np.divmod(best[strong], inner.shape[2])
    return np.nonzero(strong)[0], y + m, x + m


def describe(images: np.ndarray) -> dict[str, np.ndarray]:
    """image, x, y (in the whole image), level, angle (degrees) and descriptor (its pairs of parts, and all bits in two 64-bit
    numbers) of all keypoints of images of one size."""
    names = ("image", "x", "y", "level", "angle", "parts", "all")
    out: dict[str, list] = {n: [] for n in names}
    n, height, width = images.shape if images.ndim == 3 else (0, 0, 0)
    if not n or min(height, width) < LEAST_SIDE:
        return {"image": np.zeros(0, int), "x": np.zeros(0), "y": np.zeros(0), "level": np.zeros(0, int), "angle": np.zeros(0), "parts": np.zeros((0, PAIRS), np.int32), "all": np.zeros((0, 2), np.int64)}
    most = max(CORNERS, CORNERS * height * width // (SIDE * SIDE))
    span = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = np.meshgrid(span, span, indexing="ij")
    disc = (dx * dx + dy * dy <= RADIUS * RADIUS).ravel()
    dy, dx = dy.ravel()[disc], dx.ravel()[disc]
    for level, factor in enumerate(LEVELS):
        h, w = round(height * factor), round(width * factor)
        if min(h, w) < LEAST_SIDE:
            break
        soft = _blur(resized(images.astype(np.float32), h, w), BLUR)
        image, y, x = corners(soft, BLUR, most)
        o = RADIUS * 2
        padded = np.pad(soft, [(0, 0), (o, o), (o, o)], mode="edge")
        patch = padded[image[:, None], y[:, None] + dy + o, x[:, None] + dx + o]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def at(t: np.ndarray, image=image, y=y, x=x, padded=padded, c=c, s=s, o=o) -> np.ndarray:
            px, py = t[:, 0] * c - t[:, 1] * s, t[:, 0] * s + t[:, 1] * c
            return padded[image[:, None], np.rint(y[:, None] + py).astype(int) + o, np.rint(x[:, None] + px).astype(int) + o]

        bits = at(_TESTS[0]) < at(_TESTS[1])
        ones = bits.sum(axis=1)
        good = (ones >= 12) & (ones <= BITS - 12)
        parts = (bits.reshape(-1, PAIRS, PAIR_BITS) << np.arange(PAIR_BITS)).sum(axis=2).astype(np.int32)
        every = np.packbits(np.pad(bits, [(0, 0), (0, 128 - BITS)]), axis=1).view(np.int64)
        placed = (image, (x + 0.5) * width / w - 0.5, (y + 0.5) * height / h - 0.5, np.full(len(x), level), np.degrees(angle), parts, every)
        for name, v in zip(names, placed, strict=True):
            out[name].append(v[good])
    return {k: np.concatenate(v) for k, v in out.items()}


IMAGE = "id long, pixels binary, width int, height int"


def from_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, pixels, width, height: an image for each vector."""

    def make():
        def f(b: pa.RecordBatch):
            for at in range(0, b.num_rows, 128):
                some = b.slice(at, 128)
                rows = some.column(1).to_pylist()
                good = [k for k, v in enumerate(rows) if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
                drawn = draw(np.array([rows[k] for k in good], np.float64)) if good else []
                pixels: list[bytes | None] = [None] * len(rows)
                for k, d in zip(good, drawn, strict=True):
                    pixels[k] = d.tobytes()
                side = pa.array([SIDE] * len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pixels, pa.binary()), side, side], ["id", "pixels", "width", "height"])

        return f

    return arrow_map(table.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")), IMAGE, make)


def edited(images: DataFrame, keep: float = 0.75) -> DataFrame:
    """Copies of the images as a thief might make them: turned by a quarter if the id says so, darker, with a flat label in a
    corner, and cut to their lower right part or, every third one, brought to two thirds of their size."""

    def make():
        def f(b: pa.RecordBatch):
            out = []
            for k, p, w, h in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if p is None or len(p) != w * h:
                    out.append((p, w, h))
                    continue
                a = np.rot90(np.frombuffer(p, np.uint8).reshape(h, w), (k or 0) // 100 % 2)
                if (k or 0) // 100 % 3 == 2:
                    a = resized(a[None].astype(np.float32), round(a.shape[0] / 1.5), round(a.shape[1] / 1.5))[0]
                else:
                    a = a[a.shape[0] - int(a.shape[0] * keep) :, a.shape[1] - int(a.shape[1] * keep) :]
                a = a * 0.8 + 5
                a[: a.shape[0] // 6, : a.shape[1] // 6] = 250
                out.append((np.rint(a).astype(np.uint8).tobytes(), a.shape[1], a.shape[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], ["id", "pixels", "width", "height"])

        return f

    return arrow_map(images.select("id", "pixels", "width", "height"), IMAGE, make)


def keypoints(images: DataFrame) -> DataFrame:
    """id, x, y, level, angle, d0 and d1 (the descriptor as two longs), parts (as PAIRS whole numbers)."""

    def make():
        def f(b: pa.RecordBatch):
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                ids, raw, widths, heights = (some.column(c).to_pylist() for c in range(4))
                shapes: dict[tuple[int, int], list[int]] = {}
                for k, (p, w, h) in enumerate(zip(raw, widths, heights, strict=True)):
                    if p is not None and w and h and len(p) == w * h:
                        shapes.setdefault((h, w), []).append(k)
                for (h, w), of in shapes.items():
                    got = describe(np.frombuffer(b"".join(raw[k] for k in of), np.uint8).reshape(-1, h, w))
                    owner = np.array([ids[k] for k in of], np.int64)[got["image"]] if len(got["image"]) else np.zeros(0, np.int64)
                    halves = got["all"]
                    ends = np.arange(0, len(owner) * PAIRS + 1, PAIRS, dtype=np.int32)
                    parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(got["parts"].reshape(-1)))
                    columns = [pa.array(owner), *(pa.array(got[c].astype(np.float32)) for c in ("x", "y")), pa.array(got["level"].astype(np.int32)), pa.array(got["angle"].astype(np.float32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), parts]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "x", "y", "level", "angle", "d0", "d1", "parts"])

        return f

    return arrow_map(images.filter("id is not null and pixels is not null").select("id", "pixels", "width", "height"), "id long, x float, y float, level int, angle float, d0 long, d1 long, parts array<int>", make)


def digested(images: DataFrame) -> DataFrame:
    """The images that have an id, with h: the digest of their size and pixels, null without pixels."""
    size = F.format_string("%s x %s:", "width", "height").cast("binary")
    return images.filter("id is not null").select("id", "pixels", "width", "height", F.unhex(F.sha2(F.concat(size, "pixels"), 256)).alias("h"))


def classes(images: DataFrame) -> DataFrame:
    """h, class (the smallest id of an image of these pixels), members, rows (of that id and these pixels) and key, a number of
    their own for each distinct pixels: ids may be repeated with other pixels."""
    by_id = images.filter("h is not null").groupBy("h", "id").agg(F.count(F.lit(1)).alias("n"))
    of = by_id.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"), F.sum("n").alias("members"))
    return of.select("h", F.col("first.id").alias("class"), "members", F.col("first.n").alias("rows"), F.monotonically_increasing_id().alias("key"))


def firsts(images: DataFrame, named: DataFrame) -> DataFrame:
    """An image for each of the written classes, with its key as id; only the pixels of rows that repeat an image's id are moved."""
    of = small_or_shuffled(named.select("h", F.col("class").alias("id"), "key", "rows"), named.count())
    some = images.join(of, ["h", "id"])
    once = [some.filter("rows = 1"), some.filter("rows > 1").dropDuplicates(["key"])]
    return once[0].unionByName(once[1]).select(F.col("key").alias("id"), "pixels", "width", "height")


def _close(n: int) -> Column:
    """Whether the descriptors (qd0, qd1) and (d0, d1) differ in at most one bit of pair n."""
    mask = np.zeros(128, np.uint8)
    mask[n * PAIR_BITS : (n + 1) * PAIR_BITS] = 1
    low, high = np.packbits(mask).view(np.int64).tolist()
    bits = [F.bit_count(F.col("q" + c).bitwiseXOR(F.col(c)).bitwiseAND(F.lit(m))) for c, m in (("d0", low), ("d1", high)) if m]
    return (bits[0] if len(bits) == 1 else bits[0] + bits[1]) <= 1


def near_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, id, and place, level and angle of both (of the query with a q before): the pairs of keypoints whose descriptors differ in at most DIFFERENCE bits, once each.

    If queries have a column meets, a keypoint only meets those of the index whose level is the place of a 1 in that number.
    """
    limits = [c for c in ("meets",) if c in queries.columns]
    slot = lambda n, v: F.shiftleft(n.cast("long"), PAIR_BITS).bitwiseOR(v.cast("long"))
    filed = index.select("*", F.posexplode("parts").alias("__n", "__v")).withColumn("slot", slot(F.col("__n"), F.col("__v"))).drop("parts", "__n", "__v")
    some = filed.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    hot = written(some.filter(F.col("n") * SAMPLED > HOT).select("slot", F.ceil(F.col("n") * SAMPLED / HOT).cast("int").alias("shares")), "hot-values")
    hot = small_or_shuffled(hot, hot.count())
    # Any two dealings of the keys agree, so it is of no matter that the sample only estimates the shares.
    shares = F.coalesce("shares", F.lit(1))
    filed = filed.join(hot, "slot", "left").withColumn("share", F.pmod(F.xxhash64("id", "x", "y", "level", "angle"), shares).cast("int")).drop("shares")
    q = queries.select(F.col("id").alias("query"), *limits, *[F.col(c).alias("q" + c) for c in ("x", "y", "level", "angle", "d0", "d1")], F.posexplode("parts").alias("pair", "__v"))
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(PAIR_BITS)])
    q = q.withColumn("__f", F.explode(flips)).withColumn("slot", slot(F.col("pair"), F.col("__v").bitwiseXOR(F.col("__f")))).drop("__v", "__f")
    q = q.join(hot, "slot", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    apart = F.bit_count(F.col("qd0").bitwiseXOR(F.col("d0"))) + F.bit_count(F.col("qd1").bitwiseXOR(F.col("d1")))
    meets = apart <= DIFFERENCE
    if limits:
        meets = F.expr("shiftright(meets, level) & 1 = 1") & meets
    for n in range(PAIRS - 1):  # only the first of several close pairs counts
        meets = meets & ~((F.col("pair") > n) & _close(n))
    near = filed.join(q, ["slot", "share"]).filter(meets)
    return near.select("query", "id", "qx", "qy", "qlevel", "qangle", "x", "y", "level", "angle")


def agreeing(group: np.ndarray, m: dict[str, np.ndarray], groups: int, shift: float, turn: float, place: int) -> np.ndarray:
    """For each group of matches the most that agree: see matches()."""
    rad, level = np.radians(m["t"]), np.array(LEVELS)
    scale = level[m["level"]] / level[m["qlevel"]]
    ox = m["qx"] - scale * (m["x"] * np.cos(rad) - m["y"] * np.sin(rad))
    oy = m["qy"] - scale * (m["x"] * np.sin(rad) + m["y"] * np.cos(rad))
    at = lambda v, w, half=0.0: np.floor(v / w + half).astype(np.int64)
    most = np.zeros(groups, np.int64)
    for halves in itertools.product((0.0, 0.5), repeat=3):
        a = at(np.mod(m["t"], 360.0), turn, halves[0]) % int(360 / turn)
        rows = np.stack([group, m["qlevel"] - m["level"], a, at(ox, shift, halves[1]), at(oy, shift, halves[2])], axis=1)
        bins, bin_of = np.unique(rows, axis=0, return_inverse=True)
        sides = []
        for x, y in (("x", "y"), ("qx", "qy")):
            places = np.unique(np.stack([bin_of.reshape(-1), at(m[x], place), at(m[y], place)], axis=1), axis=0)
            sides.append(np.bincount(places[:, 0], minlength=len(bins)))
        np.maximum.at(most, bins[:, 0], np.minimum(*sides))
    return most


def _square(x: str, y: str, side: int) -> Column:
    """The square of side `side` around a place, as one number."""
    at = lambda c: F.floor(F.col(c).cast("double") / side)
    return (at(x) * F.lit(1 << 31) + at(y)).alias("square")


def commonest(queries: DataFrame, index: DataFrame, few: int, place: int) -> DataFrame:
    """query, apart, square, rank: the squares, `few` at most, in which a query has the most matches with images of the sample, for each
    difference in level (of the query less of the image); the first has rank 1."""
    share = F.lit(SURVEYED / max(index.count(), 1) * (1 << 20))
    some = index.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share)
    met = near_pairs(queries, some).groupBy("query", (F.col("qlevel") - F.col("level")).alias("apart"), _square("qx", "qy", place)).count()
    order = Window.partitionBy("query", "apart").orderBy(F.desc("count"), "square")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few).drop("count")


def likely(queries: DataFrame, index: DataFrame, least: int, place: int) -> DataFrame:
    """query, id, written: all pairs of images that can have `least` matches of one difference in level in different squares of the query.

    Such a pair has one outside the least - 1 commonest squares, and two outside the least - 2 commonest.
    """
    common = written(commonest(queries, index, least - 1, place), "common-squares")
    n = common.count()
    keyed = queries.withColumn("square", _square("x", "y", place)).withColumnRenamed("id", "query")
    of = small_or_shuffled(common.groupBy("query", "square").agg(F.collect_set("apart").alias("aparts")), n)
    meets = [F.when(F.array_contains("aparts", F.col("level") - k), 0).otherwise(1 << k) for k in range(len(LEVELS))]
    rare = keyed.join(of, ["query", "square"], "left").withColumn("meets", sum(meets)).filter("meets > 0").withColumnRenamed("query", "id")
    seen = near_pairs(rare, index).groupBy("query", "id", (F.col("qlevel") - F.col("level")).alias("apart"))
    square = _square("qx", "qy", place)
    seen = seen.agg(F.min(square).alias("low"), F.max(square).alias("high"))
    if least < 2:  # one match will do
        return written(seen.select("query", "id").distinct(), "likely-pairs")
    seen = written(seen, "seen-pairs")
    next_of = keyed.join(small_or_shuffled(common.filter(F.col("rank") == least - 1), n), ["query", "square"])
    next_of = next_of.groupBy("query", "apart").agg(F.collect_list(F.struct((F.col("level") - F.col("apart")).alias("level"), "d0", "d1")).alias("next"))
    once = seen.filter("low = high").join(small_or_shuffled(next_of, n), ["query", "apart"]).select("query", F.col("id").alias("with"), "next")
    bits = lambda k: F.bit_count(k["d0"].bitwiseXOR(F.col("d0"))) + F.bit_count(k["d1"].bitwiseXOR(F.col("d1")))
    twice = F.exists("next", lambda k: (k["level"] == F.col("level")) & (bits(k) <= DIFFERENCE))
    once = index.select("id", "level", "d0", "d1").join(once, (F.col("id") == F.col("with")) & twice)
    pairs = written(seen.filter("low < high").select("query", "id").union(once.select("query", "id")).distinct(), "likely-pairs")
    dropped(common, seen)
    return pairs


def _met(near: DataFrame, match: Callable) -> DataFrame:
    """query, id, of: the pairs of keypoints of near_pairs() by pairs of images, each as match(q, k)."""
    return near.groupBy("query", "id").agg(F.collect_list(match(lambda c: F.col("q" + c), F.col)).alias("of"))


def _compared(pairs: DataFrame, queries: DataFrame, index: DataFrame, match: Callable) -> DataFrame:
    """query, id, of: all matches of the written pairs of images, each as match(q, k) of its two keypoints' columns."""
    points = F.collect_list(F.struct("x", "y", "level", "angle", "d0", "d1"))
    asked = queries.groupBy(F.col("id").alias("query")).agg(F.count(F.lit(1)).alias("n"))
    found = index.join(pairs.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("m"))
    sized = written(pairs.join(small_or_shuffled(asked, asked.count()), "query").join(found, "id").select("query", "id", (F.col("n") * F.col("m") > WHOLE).alias("large")), "sized-pairs")
    dropped(pairs)
    small, large = sized.filter("not large").drop("large"), sized.filter("large").drop("large")
    those = lambda t, of, c: t.join(of.select(F.col(c).alias("id")).distinct(), "id", "left_semi")
    asked = those(queries, small, "query").groupBy(F.col("id").alias("query")).agg(points.alias("asked"))
    found = those(index, small, "id").groupBy("id").agg(points.alias("found"))
    both = small.join(small_or_shuffled(asked, asked.count(), 10_000), "query").join(found, "id")  # some kilobytes a query
    apart = lambda q, k: F.bit_count(q["d0"].bitwiseXOR(k["d0"])) + F.bit_count(q["d1"].bitwiseXOR(k["d1"]))
    each = lambda q: F.transform(F.filter("found", lambda k: apart(q, k) <= DIFFERENCE), lambda k: match(q.getField, k.getField))
    of = both.select("query", "id", F.flatten(F.transform("asked", each)).alias("of"))
    if large.isEmpty():
        return of
    near = near_pairs(those(queries, large, "query"), those(index, large, "id")).join(large, ["query", "id"], "left_semi")
    return of.union(_met(near, match))


def matches(queries: DataFrame, index: DataFrame, least: int = 4, shift: float = 8.0, turn: float = 30.0, place: int = 4) -> DataFrame:
    """query, id, inliers from keypoint tables: pairs of images with least matches that agree on turn, scale and shift.

    A match gives the turn, the difference in level, and where the index image's origin lands; bins of width `shift` and `turn`
    are laid with each of turn and the two shifts as it is or half a width apart, in all eight ways, so that matches within half
    a width of each other in all three meet in some bin. Matches in one square of side `place` count once, on either side.
    """
    match = lambda q, k: F.struct(*[q(c).alias("q" + c) for c in ("x", "y", "level")], *[k(c).alias(c) for c in ("x", "y", "level")], (q("angle") - k("angle")).alias("t"))
    if index.count() <= SURVEYED:  # the sample would be all of it
        near = _met(near_pairs(queries, index), match).filter(F.size("of") >= least)
    else:
        near = _compared(likely(queries, index, least, place), queries, index, match)

    def make():
        def f(b: pa.RecordBatch):
            of = b.column(2)
            flat = of.flatten()
            group = np.repeat(np.arange(b.num_rows), of.value_lengths().to_numpy(zero_copy_only=False))
            whole = {"qlevel", "level"}
            m = {c.name: flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64 if c.name in whole else np.float64) for k, c in enumerate(flat.type)}
            most = agreeing(group, m, b.num_rows, shift, turn, place)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(most)], ["query", "id", "inliers"])

        return f

    return arrow_map(near, "query long, id long, inliers long", make).filter(F.col("inliers") >= least)


def _linked(images: DataFrame, queries: DataFrame, how: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digested images, their classes, and key (of an image's class), query, query_members, inliers: all links of classes."""
    images, queries = written(digested(images), "images"), written(digested(queries), "query-images")
    named, asking = written(classes(images), "image-classes"), written(classes(queries), "query-classes")
    index = written(keypoints(firsts(images, named)), "keypoints")
    asked = written(keypoints(firsts(queries, asking)), "query-keypoints")
    dropped(queries)
    found = matches(asked, index, **how).withColumnsRenamed({"query": "__q", "id": "key"})
    found = found.join(asking.select(F.col("key").alias("__q"), F.col("class").alias("query"), F.col("members").alias("query_members")), "__q")
    return images, named, written(found.select("key", "query", "query_members", "inliers"), "image-links")


def links(images: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """query, query_members, image, members, inliers: every pair of a class of queries and a class of images that are copies.

    query and image are the smallest ids of their classes of equal pixels, the members their rows.
    """
    _, named, found = _linked(images, queries, how)
    return found.join(named, "key").select("query", "query_members", F.col("class").alias("image"), "members", "inliers")


def _summed(found: DataFrame) -> DataFrame:
    """key, query, inliers, queries, links: the best link of an image's class, the queries of all its links, and all of them."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("inliers")).alias("n"), "query", "query_members")))
    of = found.groupBy("key").agg(F.sum("query_members").alias("queries"), ordered.alias("of"))
    link = lambda x: F.struct(x["query"].alias("query"), x["query_members"].alias("members"), (-x["n"]).alias("inliers"))
    of = of.select("key", "queries", F.transform("of", link).alias("links"))
    return of.select("key", F.col("links")[0]["query"].alias("query"), F.col("links")[0]["inliers"].alias("inliers"), "queries", "links")


def find_copies(images: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """image (a class), members, query, inliers, queries, links: the classes of images of which some query is a cropped or edited copy.

    query: the one with the most inliers, then of smallest id; queries: the number of queries that agree with the image; links:
    all of them, as an array of (query, members, inliers) with queries of equal pixels as one.
    """
    _, named, found = _linked(images, queries, how)
    return _summed(found).join(named, "key").select(F.col("class").alias("image"), "members", "query", "inliers", "queries", "links")


def copies_of_each(images: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """One row per image with an id: image, class, members, query, inliers, queries, links as in find_copies().

    Without a link query and inliers are null and queries is 0. The links of a class are on the row of its smallest id alone.
    An image without pixels is a class of its own.
    """
    images, named, found = _linked(images, queries, how)
    of = named.select("h", "key", "class", "members").join(_summed(found), "key", "left").drop("key")
    rows = images.select("id", "h").join(of, "h", "left")
    first = F.col("id") == F.col("class")
    return rows.select(F.col("id").alias("image"), F.coalesce("class", "id").alias("class"), F.coalesce("members", F.lit(1)).alias("members"), "query", "inliers", F.coalesce("queries", F.lit(0)).alias("queries"), F.when(first, F.col("links")).alias("links"))
