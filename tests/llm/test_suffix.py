"""Repeated substrings against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotfield.llm import suffix_dedup
from dotfield.llm.queries import QUERIES


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        yield len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()


def check(rows, texts):
    want = list(brute(texts))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    return want


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgéü"), rng.integers(2, 8))) for _ in range(n))


def test_awkward_texts(spark):
    rng = np.random.default_rng(5)
    shared = [words(rng, 60) for _ in range(6)]
    exact = shared[0].encode()[:260].decode(errors="ignore")
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 201, "b" * 5000, "abc" * 400, "xyz" * 66 + "xy", shared[5] + "xyz" * 66 + "xy" + words(rng, 5)]
    texts += [words(rng, 40) + " " + shared[k % 5] + " " + words(rng, 40) for k in range(12)]
    texts += [shared[1] + shared[1], exact[:199], exact[10:210] + "é", "q" + exact[3:250], exact + "r" + exact[1:], words(rng, 3000)]
    texts += [texts[-1], texts[-1][:5000] + "!" + texts[-1][5001:], texts[-1][2000:9000], "日本語" * 300, "本語日" * 100]
    one = words(rng, 90)
    texts += [one[:k] + "#" + one[k:] for k in range(0, len(one), 37)]
    docs = spark.createDataFrame([(k, t, 1, "n", b"x") for k, t in enumerate(texts)], "doc_id long, text string, start int, name string, data binary").repartition(3)
    want = check(suffix_dedup.digest(docs).collect(), texts)
    assert want[3][1] == 0 and want[4][1] == 200 and want[5][1] == 201 and want[6][1] == 5000


def test_blocks_and_shuffles(spark, monkeypatch):
    """Texts longer than a block, and lists of places too large to broadcast."""
    monkeypatch.setattr(suffix_dedup, "small_or_shuffled", lambda df, rows, limit: df)
    rng = np.random.default_rng(6)
    long = words(rng, 1500)
    for base in (300, 777):
        parts = []
        monkeypatch.setattr(suffix_dedup, "BLOCK", base)
        for text, start, places, _, _ in suffix_dedup.phrases(np.frombuffer(long.encode(), np.uint8), np.array([len(long.encode())])):
            assert not text.any()
            parts += list(zip(start.tolist(), places.tolist(), strict=True))
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) == len(long.encode()) - 199
    texts = [long, long[:3000], words(rng, 200), long[100:900] + long[:500]]
    check(suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), texts)


def test_large_group_of_near_copies(spark):
    """One passage in a third of all texts, every time with another border; and exact copies."""
    rng = np.random.default_rng(7)
    passage, copy = words(rng, 80), words(rng, 60)
    texts = [words(rng, 20) + passage + words(rng, 20) if k % 3 == 0 else copy if k % 3 == 1 else words(rng, 50) for k in range(300)]
    check(suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), texts)


def test_null_ids_repeated_rows_and_nothing(spark):
    text = words(np.random.default_rng(8), 100)
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.cut(docs).collect())
    n = len(text.encode())
    assert got == [(-1, 0, 0, 0), (-1, n, n, 1), (4, n, n, 1), (4, n, n, 1)]
    assert suffix_dedup.digest(docs.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    dir_ = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect()
    texts = [t for _, t in sorted((r.doc_id, r.text) for r in rows)]
    assert sum(w[1] > 0 for w in check(QUERIES["op13_suffix_dedup"](spark, dir_).collect(), texts)) > 5


def test_sliding_least():
    v = np.random.default_rng(9).integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 3, 64, 137, 300):
        assert suffix_dedup.least(v, width).tolist() == [int(v[i : i + width].min()) for i in range(len(v) - width + 1)]
