"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns are laid out in ranges of (conversation, turn), so that a conversation of any length is cut into pieces; positions and
prefix names are counted within a piece, and what earlier pieces hold is added. A prefix is named by its depth and by the
exclusive or of 2 x 64 bits of every turn, hashed with its place, so a name needs no pass over the turns before it. Nodes
are groups of equal names.

Totals of subtrees come from contraction. A round rakes all leaves (their totals are final and go to the parent) and
compresses chains: of the nodes with one child left, some of which no two are neighbours go, their weight to the parent and
their child to the grandparent. In round r these are the nodes whose depth has bit r set, which halves a chain; when the
bits are used up, coins by hash decide. So the rounds grow with the logarithm of the nodes, for chains and bushes alike.
Afterwards the compressed nodes are taken up again in reverse order: such a node's total is its weight when it went plus the
total of the child that it had. Every round is a written table; the driver sees counts only.

Cases. A null turn comes first; turns of equal number are ordered by the beginnings of role and text, then
by a hash, and equal rows count each. A null role or
text is empty. Rows of a null conv_id are of no conversation and are left out. For a negative conv_id the remainder by 100 is
negative, as in SQL. Very long texts are hashed where they are read and travel no further. A conversation that is left without
turns is a member of the root. An empty table has no root: the result is empty. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, map_batches, parts_for, written

#: Every conversation of one family of FAMILY ids borrows fewer than BORROWED turns from the family's first.
FAMILY, BORROWED = 100, 6
#: Ids below this bit are strung together in one row before they are hashed.
ID_BITS = 12


def borrowed(conv: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """piece, conv, what orders its turns, t1 and t2 (names of role and text), points (code points of the text).

    Pieces are ranges of all turns in order, so no task has a long conversation whole.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), half(1).alias("t1"), half(17).alias("t2"),
        F.length(text).cast("long").alias("points"), F.substring(role, 1, 20).alias("role20"), F.substring(text, 1, 40).alias("text40"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "role20", "text40", "t1", "t2"]
    rows = rows.repartitionByRange(parts_for(spark), *order, "row").withColumn("piece", F.spark_partition_id().cast("long"))
    return written(rows.drop("row"), "trie-turns")


def numbered(laid: DataFrame) -> DataFrame:
    """piece, conv, i (1, 2, ... in a piece), t1, t2, points."""
    here = W.partitionBy("piece", "conv").orderBy("turn", "role20", "text40", "t1", "t2")
    return laid.select("piece", "conv", F.row_number().over(here).cast("long").alias("i"), "t1", "t2", "points")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (piece, conv, depth, e1, e2, points) and the conversations (conv, depth).

    A conversation with h = borrowed(conv) is the first h turns of its family's first conversation, then its own after its first h.
    The borrowed ones are piece -1.
    """
    laid = turns(conversations)
    rows = written(numbered(laid), "trie-numbered")
    dropped(laid)
    pieces = rows.groupBy("piece", "conv").agg(F.max("i").alias("n"))
    pieces = pieces.withColumn("before", F.sum("n").over(W.partitionBy("conv").orderBy("piece")) - F.col("n"))
    pieces = written(pieces, "trie-pieces")
    sizes = pieces.groupBy("conv").agg(F.sum("n").alias("n"))
    first = sizes.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    convs = sizes.withColumn("h", borrowed(F.col("conv"))).withColumn("first", F.col("conv") - F.col("conv") % FAMILY).join(first, "first", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("n_first", F.lit(0)))).drop("n_first")
    convs = written(convs.withColumn("depth", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")

    own = rows.join(pieces.join(convs.select("conv", "h", "m"), "conv").drop("n"), ["piece", "conv"]).withColumn("j", F.col("before") + F.col("i"))
    loans = own.filter((F.col("j") < BORROWED) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("first"), "j", "t1", "t2", "points")
    taken = convs.filter("m > 0").select("conv", "first", "m").join(loans, "first").filter("j <= m")
    taken = taken.select(F.lit(-1).cast("long").alias("piece"), "conv", F.col("j").alias("depth"), "t1", "t2", "points")
    own = own.filter("j > h").select("piece", "conv", (F.col("m") + F.col("j") - F.col("h")).alias("depth"), "t1", "t2", "points")
    placed = own.unionByName(taken).select(
        "piece", "conv", "depth", F.xxhash64("depth", "t1", "t2").alias("e1"), F.xxhash64("t2", "depth", "t1", F.lit(1)).alias("e2"), "points"
    )
    return placed, convs.select("conv", "depth")


def prefixes(placed: DataFrame) -> DataFrame:
    """conv, depth, k1 and k2 (name of the prefix), p1 and p2 (of the prefix before it), points."""
    xors = lambda: [F.bit_xor(c).alias(x) for c, x in (("e1", "x1"), ("e2", "x2"))]
    pieces = placed.groupBy("piece", "conv").agg(*xors())
    earlier = W.partitionBy("conv").orderBy("piece")
    until = lambda c: F.bit_xor(c).over(earlier).bitwiseXOR(F.col(c))
    pieces = pieces.select("piece", "conv", until("x1").alias("b1"), until("x2").alias("b2"))
    here = W.partitionBy("piece", "conv").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = placed.withColumn("r1", F.bit_xor("e1").over(here)).withColumn("r2", F.bit_xor("e2").over(here)).join(pieces, ["piece", "conv"])
    rows = rows.withColumn("k1", F.col("r1").bitwiseXOR(F.col("b1"))).withColumn("k2", F.col("r2").bitwiseXOR(F.col("b2")))
    return rows.select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "points")


def hashed_ids(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ends_sha256: SHA-256 of each group's ids (conv) in ascending order, comma-joined.

    Ids are strung together by ranges of 2^12, and the ranges are hashed one after the other, so a task holds one range at a time.
    """
    spark = members.sparkSession
    strung = members.groupBy(*keys, F.shiftright("conv", ID_BITS).alias("__range")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("__ids"))
    strung = strung.repartition(parts_for(spark), *keys).sortWithinPartitions(*keys, "__range").select(*keys, "__ids")

    def run(batches):
        now, state = None, None

        def rows(done):
            table = {c: pa.array([key[n] for key, _ in done], pa.int64()) for n, c in enumerate(keys)}
            return pa.RecordBatch.from_pydict({**table, "ends_sha256": [s.hexdigest() for _, s in done]})

        for b in batches:
            done = []
            for *key, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(now, state)])

    return map_batches(strung, run, ", ".join(f"{c} long" for c in keys) + ", ends_sha256 string")


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """v, dep and the sum of each value over the subtree of every node.

    tree: v and dep (together a node's name; dep is its depth), p and pdep (its parent's, null for a root) and the values, long.
    """
    sums = lambda pick: [F.sum(F.when(pick, F.col(c))).alias(f"__{c}") for c in values]
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c)
    as_parent = lambda df, *also: df.withColumnsRenamed({"p": "v", "pdep": "dep"}).select("v", "dep", *also)
    state = written(tree.select("v", "dep", "p", "pdep", *values), "trie-state")
    bits = int(state.agg(F.coalesce(F.max("dep"), F.lit(0))).first()[0]).bit_length()
    finals, folded, r = [], [], 0
    while not state.filter("p is not null").isEmpty():
        # Rake: nodes without children are final; their totals go to their parents.
        kids = as_parent(state.filter("p is not null").groupBy("p", "pdep").agg(F.count(F.lit(1)).alias("n")), "n")
        now = written(state.join(kids, ["v", "dep"], "left").withColumn("leaf", F.col("n").isNull()), "trie-leaves")
        dropped(state)
        left = F.when(~F.col("leaf"), F.struct("v", "dep"))
        given = now.filter("p is not null").groupBy("p", "pdep").agg(*sums(F.col("leaf")), F.count(left).alias("alive"), F.min(left).alias("child"))
        given = as_parent(given, *[f"__{c}" for c in values], "alive", "child")
        finals.append(now.filter("leaf and p is not null").select("v", "dep", *values))
        raked = now.filter("not leaf or p is null").join(given, ["v", "dep"], "left").select("v", "dep", "p", "pdep", *map(more, values), "alive", "child")
        # Compress: of the nodes with one child, those under a node that does not go itself.
        coin = F.shiftright("dep", r).bitwiseAND(F.lit(1)) == 1 if r < bits else F.xxhash64("v", "dep", F.lit(r)).bitwiseAND(F.lit(1)) == 1
        raked = written(raked.withColumn("willing", (F.col("alive") == 1) & F.col("p").isNotNull() & coin), "trie-raked")
        above = raked.filter("willing").select(F.col("v").alias("p"), F.col("dep").alias("pdep"), F.lit(True).alias("stays"))
        marked = raked.join(above, ["p", "pdep"], "left").withColumn("goes", F.col("willing") & F.col("stays").isNull())
        marked = written(marked.select("v", "dep", "p", "pdep", *values, "child", F.coalesce("goes", F.lit(False)).alias("goes")), "trie-marked")
        dropped(raked)
        gone = marked.filter("goes")
        folded.append(gone.select("v", "dep", *values, "child"))
        heirs = gone.select(F.col("child.v").alias("v"), F.col("child.dep").alias("dep"), F.col("p").alias("p2"), F.col("pdep").alias("pdep2"))
        gifts = as_parent(gone.groupBy("p", "pdep").agg(*[F.sum(c).alias(f"__{c}") for c in values]), *[f"__{c}" for c in values])
        rest = marked.filter("not goes").join(heirs, ["v", "dep"], "left").join(gifts, ["v", "dep"], "left")
        state = written(rest.select("v", "dep", F.coalesce("p2", "p").alias("p"), F.coalesce("pdep2", "pdep").alias("pdep"), *map(more, values)), "trie-state")
        r += 1
    total = state.select("v", "dep", *values)
    for f in finals:
        total = total.unionByName(f)
    # Take the compressed nodes up again, the last ones first; each part is a table, and those known so far are read together.
    for part in reversed(folded):
        below = total.select(F.col("v").alias("cv"), F.col("dep").alias("cdep"), *[F.col(c).alias(f"__{c}") for c in values])
        back = part.join(below, (F.col("child.v") == F.col("cv")) & (F.col("child.dep") == F.col("cdep"))).select("v", "dep", *map(more, values))
        total = total.unionByName(written(back, "trie-back"))
    return total


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, named by its smallest member and its depth."""
    placed, convs = rebuilt(conversations)
    convs = written(convs, "trie-depths")
    rows = written(prefixes(placed), "trie-prefixes")
    key = ["depth", "k1", "k2"]
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs > 0")
    nodes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("points").alias("points"))
    nodes = written(nodes.unionByName(root.select(*zero(*key), "n_convs", "conv_id", *zero("p1", "p2", "points"))), "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "p1", "p2"], "left")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = written(nodes.drop("p1", "p2"), "trie-family")

    pdep = F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1)
    tree = nodes.select(
        F.col("conv_id").alias("v"), F.col("depth").alias("dep"), F.col("parent_conv_id").alias("p"), pdep.alias("pdep"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"),
    )
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"]).withColumnsRenamed({"v": "conv_id", "dep": "depth"})

    ends = rows.join(convs, ["conv", "depth"], "left_semi").select("conv", *key)
    ends = ends.unionByName(convs.filter("depth = 0").select("conv", *zero(*key)))
    out = nodes.join(hashed_ids(ends, key), key, "left").join(sums, ["conv_id", "depth"])
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
