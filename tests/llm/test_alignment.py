"""Alignment of two tokenizers against brute force."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dotfield.llm import alignment
from dotfield.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(texts):
    """Row of each text, by walking both token lists byte by byte."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()
    done, held = [], collections.Counter()
    for t in texts:
        groups = []
        if t:
            ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
            xb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(xa) == b"".join(xb) == (" " + t).encode():
                ends = {0}
                ends_a, ends_b = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
                low = 0
                for cut in sorted(set(ends_a) & set(ends_b) - ends):
                    groups.append(([i for i, e in zip(ia, ends_a, strict=True) if low < e <= cut], [i for i, e in zip(ib, ends_b, strict=True) if low < e <= cut]))
                    low = cut
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        done.append((groups, links))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for groups, links in done:
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        yield (
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links),
            sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def check(rows, texts):
    want = dict(enumerate(brute(texts)))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], texts[r.doc_id]


ODD = [None, "", " ", "  a  b ", "a\n b", "a \nb", "It's o'clock 12 34abc\r\nx", "<|endoftext|> x <s>y</s>", "é́ ñ. Σας İx", "a\xa0b", "tab\tx y\n\nz\n w",
       "▁", "a▁b", " lead", "trail ", "日本 語 x。", "²³ ½ 😀🏳️‍🌈", "nul\0here \0 x", "a a a a a the the the", "word", "word", "x" * 3000, "\n", "plain words here and there and there again"]


def test_awkward_texts(spark):
    rows = [(k, t, "x", "y", 1, 2) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, chunk string, n int, pos int")
    out = alignment.aligned(docs.repartition(3), A, B)
    check(out.collect(), ODD)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_null_ids_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, None), (3, "one two"), (3, "one two")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_a, r.count_sum) for r in alignment.aligned(docs, A, B).collect())
    n = got[-1][1]
    assert [g[:2] for g in got] == [(-1, 0), (-1, n), (3, n), (3, n)] and len({g[2] for g in got[1:]}) == 1 and got[1][2] == 3 * n
    assert alignment.aligned(docs.filter(F.lit(False)), A, B).count() == 0


def test_query_against_brute_force_in_small_chunks(spark, monkeypatch):
    """All documents of the smallest tables; many chunks, a small memory, counts too many to broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert sorted(texts) == list(range(len(texts)))
    texts = [texts[k] for k in sorted(texts)]
    check(QUERIES["op12_alignment"](spark, "/root/testdata/sf0.001").collect(), texts)
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    check(alignment.aligned(docs, A, B, most=500, chunk_docs=7).collect(), texts)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(0, "go go go go go"), (1, "go on"), (2, None)], "doc_id long, text string")
    got = {(r.docs, r.links, r.best) for r in alignment.pair_counts(alignment.inverted(docs, A, B)).collect()}
    assert got == {(2, 6, True), (1, 1, True)}


@pytest.mark.parametrize("docs", [8192, 100, 9, 1])
def test_sets_come_back(docs):
    rng = np.random.default_rng(docs)
    sets = [np.flatnonzero(rng.random(docs) < p) for p in (0.001, 0.02, 0.5, 1.0, 0.06, 0.07)]
    sets = [s for s in sets if len(s)]
    of = np.array([len(s) for s in sets])
    for which, packed in alignment.containers(np.concatenate(sets), of, docs):
        for packed in (packed, pa.concat_arrays([pa.array([b"z"], pa.binary()), packed]).slice(1)):
            i, places = alignment.members(packed, of[which])
            for k, w in enumerate(which.tolist()):
                assert sorted(places[i == k].tolist()) == sets[w].tolist()
