"""The prefix trie against brute force: awkward rows, long chains, large groups."""

import collections
import hashlib
import zlib

import pytest

from dotfield.llm import prefix_trie

KINDS = "conv_id long, turn long, role string, text string, depth long, v string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or ""), (text or "")))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = own.get(family, [])[:h] + mine[h:]
    members = collections.defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS).repartition(5)).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_awkward_rows(spark):
    long = "long " * 50_000
    rows = [(c, t, "user" if t % 2 else None, f"t{(c // 7 + t) % 3}" if t else "hello") for c in [*range(30), 100, 101, 150, 199, -3, -100, -120] for t in range(c % 7 + 1)]
    rows += [(None, 1, "user", "lost"), (5, None, "user", "first"), (6, None, None, None), (8, 2, "user", "same"), (8, 2, "user", "same"), (300, 0, "a", long), (301, 0, "a", long), (302, 0, "é", "é 😀")]
    rows += [(777, None, "x", "only one, and none to borrow")]
    check(spark, rows)


def test_long_chain_and_copies(spark):
    rows = [(c, t, "u", f"n{t}") for c in (0, 1, 2) for t in range(150)]
    rows += [(1000 + c, t, "u", "same") for c in range(5000) for t in (0, 1)]
    check(spark, rows)


def test_ids_are_hashed_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    check(spark, [(c, 0, "u", "same") for c in range(-40, 60)])


def test_contraction_against_recursion(spark):
    """A chain of 200, a broom and a star, from several roots."""
    parent = {("a", k): ("a", k - 1) if k else None for k in range(200)}
    parent |= {("b", 0): None} | {(f"b{k}", 1): ("b", 0) for k in range(30)} | {("c", 0): None, ("c", 1): ("c", 0), ("c1", 2): ("c", 1), ("c2", 2): ("c", 1)}
    name = {v: (zlib.crc32(v[0].encode()), v[1]) for v in parent}
    want = collections.Counter()
    for k, v in enumerate(sorted(parent)):
        while v is not None:
            want[name[v]] += k
            v = parent[v]
    rows = [(*name[v], *(name[parent[v]] if parent[v] else (None, None)), k) for k, v in enumerate(sorted(parent))]
    got = prefix_trie.subtree_sums(spark.createDataFrame(rows, "v long, dep long, p long, pdep long, w long"), ["w"]).collect()
    assert {(r.v, r.dep): r.w for r in got} == {n: want[n] for n in name.values()}


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")]])
def test_nothing(spark, rows):
    assert prefix_trie.trie(spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS)).count() == 0
