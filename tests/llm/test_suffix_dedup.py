"""Repeated spans against a brute-force count of all windows, and the merge against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidalgrid.llm import suffix_dedup as S
from tidalgrid.llm.queries.op01_suffix_dedup import op1_suffix_dedup, repeat_digests


def characters(raw):
    """Each character with the bytes it takes, from a to z."""
    at = 0
    for c in raw.decode():
        yield c, at, at + len(c.encode())
        at += len(c.encode())


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = S.joined_spans((i, i + 1) for i, x in enumerate(hit) if x)
        kept = "".join(c for c, a, z in characters(t) if not all(hit[a:z]))
        out.append((len(t), sum(hit), len(spans), hashlib.sha256(S.without(t, spans)).hexdigest(), kept))
    return out


def compare(spark, rows, length, gram, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in repeat_digests(df, length=length, gram=gram, **options).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute([(t or "").encode() for _, t in rows], length), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    return sum(r[2] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_small_random_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(S, "RUN_BYTES", 900)
    rng = random.Random(seed)
    words = ["alpha ", "bé ", "c", "dd ", "eeee", "日本 "]
    parts = ["".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(4))) + str(rng.random())) for i in range(60)]
    rows += [(7, None), (None, ""), (8, "a" * 300), (9, "ab" * 200), (10, rows[3][1]), (3, rows[3][1]), (None, rows[5][1] * 2), (None, "zz")]
    assert compare(spark, rows, 24, 6) > 0
    assert compare(spark, rows, 40, 8, ranges=5) > 0


def test_gram_that_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 4000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(12))
    rows = []
    for i in range(300):
        a, z = rng.randrange(8), rng.randrange(8)
        rows.append((i, " ".join(word() for _ in range(5)) + passage[a : len(passage) - z] + " ".join(word() for _ in range(5))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, cut = S.splitters(S._keyed(df, "doc_id", "text"), 60, 50_000, 48, 8)
    assert cut
    assert compare(spark, rows, 48, 8, ranges=60) > 0


def test_whole_table(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op1_suffix_dedup(spark, small_dir).collect()}
    want = brute([t.encode() for _, t in docs], 400)
    assert [got[i] for i, _ in docs] == want and sum(x[1] for x in want) > 0


def test_remove_repeats_keeps_characters_and_columns(spark):
    same = "é" * 300 + " und so weiter"
    rows = [(1, "x" + same, "p"), (2, same, "q"), (3, None, "r"), (4, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(tuple(r) for r in S.remove_repeats(df).collect())
    assert got[0] == (1, "x", "p") and got[1] == (2, "", "q") and got[2] == (3, None, "r") and got[3] == (4, "", "s")
    assert S.remove_repeats(df.limit(0)).collect() == []


def test_merge_runs_equals_sorting():
    rng = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(40))) for _ in range(k)]
        shared = lambda r: [(x, S.common_prefix(r[i - 1], x) if i else 0, i) for i, x in enumerate(r)]
        got = list(S.merge_runs([iter(shared(r)) for r in runs]))
        want = sorted(x for r in runs for x in r)
        assert [g[0] for g in got] == want
        assert [g[1] for g in got[1:]] == [S.common_prefix(a, b) for a, b in zip(want, want[1:])]


def test_anchors_are_the_same_for_equal_windows():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 4, 90).astype(np.uint8)
    raws = [np.concatenate([rng.integers(0, 4, n).astype(np.uint8), passage, rng.integers(0, 4, 50).astype(np.uint8)]) for n in (40, 73)]
    picks = []
    for n, raw in zip((40, 73), raws, strict=True):
        at = np.zeros(len(raw) - 64 + 1, int)
        for a, first, last in zip(*S.anchors(raw, 64, 9), strict=True):
            at[first : last + 1] = a
        picks.append(at[n : n + 27] - n)
    assert (picks[0] == picks[1]).all()


def test_anchors_are_few_and_grams_hash_alike():
    raw = np.random.default_rng(4).integers(0, 256, 50_000).astype(np.uint8)
    first = S.anchors(raw, 400, 32)[0]
    assert 50_000 / 250 < len(first) < 50_000 / 140
    gram = raw[700:732]
    assert S._gram_hashes(raw, 32)[700] == S._gram_hashes(gram, 32)[0] == S._gram_hashes(np.concatenate([raw[:9], gram]), 32)[9]
