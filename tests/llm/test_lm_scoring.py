"""The attention model against a naive evaluation, and whole-table scores against brute-force counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from tidalgrid.llm import attention as A
from tidalgrid.llm import lm_scoring as L
from tidalgrid.llm.queries.op02_lm_scoring import op2_lm_scoring

PATH = public_tokenizers.path("byte_bpe_50k.json")


def toy(n=40, seed=0):
    r = np.random.default_rng(seed)
    blank = np.arange(n) % 3 == 0
    p = A.map_pieces(r.integers(1, 90, n).astype(float), blank)
    prior = A.counted_prior(p, r.random(p.classes) * 9, r.random((p.inputs, p.classes)) * 9, r.random(p.inputs) * 9, 5.0)
    w = {k: v + r.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in A.initial(p).items()}
    return p, prior, w


def stream(p, body):
    return np.array([p.n + 1, *body, p.n])


def naive(p, prior, w, s, i):
    """(log P of each class | opens), (| goes on), P(opens) after symbol ``i`` of stream ``s``."""
    first = max(0, (i // A.STRIDE - 1) * A.STRIDE)
    x = p.input_of[s[first : i + 1]]
    e = w["e"][x].astype(float)
    k, v, q = e @ w["k"], e @ w["v"], e[-1] @ w["q"]
    a = np.exp(k @ q / math.sqrt(A.WIDTH) + w["bias"][np.arange(len(x) - 1, -1, -1)])
    o = (a / a.sum()) @ v
    soft = lambda z: z - np.log(np.exp(z).sum())
    return soft(o @ w["start"] + prior.start), soft(o @ w["follow"] + prior.follow[x[-1]]), 1 / (1 + math.exp(-float(o @ w["stop"][:, 0] + prior.stop[x[-1]])))


def test_windows_score_each_symbol_once_as_a_naive_model():
    p, prior, w = toy()
    r = np.random.default_rng(3)
    streams = [stream(p, r.integers(0, p.n, k)) for k in (0, 1, 14, 15, 16, 40, 97)]
    which, kind = A.score_streams(p, w, prior, np.concatenate(streams), np.array([len(s) for s in streams]), at_once=3)
    at = 0
    for s in streams:
        for i in range(len(s) - 1):
            start, follow, opens = naive(p, prior, w, s, i)
            y = s[i + 1]
            want = (start if p.opens[y] else follow)[p.class_of[y]] + p.log_inside[y]
            assert abs(which[at + i] - want) < 1e-3 and abs(kind[at + i] - math.log(opens if p.opens[y] else 1 - opens)) < 1e-3
        assert which[at + len(s) - 1] == kind[at + len(s) - 1] == 0
        at += len(s)


def test_next_symbol_is_a_distribution():
    p, prior, w = toy()
    body = np.random.default_rng(1).integers(0, p.n, 21)
    total = 0.0
    for y in range(p.n + 1):
        s = np.array([p.n + 1, *body, y, p.n])
        which, kind = A.score_streams(p, w, prior, s, np.array([len(s)]))
        total += math.exp(which[len(body)] + kind[len(body)])
    assert abs(total - 1) < 1e-3


def test_training_lowers_the_loss():
    p, prior, _ = toy()
    r = np.random.default_rng(2)
    # Even texts use the lower half of the pieces, odd texts the upper: only context tells.
    streams = [stream(p, r.integers(0, p.n // 2, 30) + (i % 2) * (p.n // 2)) for i in range(60)]
    symbols, size = np.concatenate(streams), np.array([len(s) for s in streams])
    w0 = A.initial(p)
    w1 = A.train(w0, prior, *A.training_windows(p, symbols, size), steps=150)
    loss = [-sum(x.sum() for x in A.score_streams(p, w, prior, symbols, size)) / len(symbols) for w in (w0, w1)]
    assert loss[1] < loss[0] - 0.3


def test_gradients_of_a_step_are_those_of_the_naive_loss():
    """Windows of several streams, some shorter than a stride, symbols that open a word, go on or count for nothing."""
    p, prior, w = toy()
    r = np.random.default_rng(5)
    # As in texts, what follows BEGIN opens a word (piece 0) or is END.
    streams = [stream(p, r.integers(0, p.n, k) * (np.arange(k) > 0)) for k in (0, 3, 20, 33)]
    x, ok, y, opens, use = A.training_windows(p, np.concatenate(streams), np.array([len(s) for s in streams]))
    wide = {k: v.astype(float) for k, v in w.items()}

    def loss(w):
        total, n = 0.0, 0
        for s in streams:
            for i in range(len(s) - 1):
                start, follow, begins = naive(p, prior, w, s, i)
                nxt = s[i + 1]
                total -= (start if p.opens[nxt] else follow)[p.class_of[nxt]] + math.log(begins if p.opens[nxt] else 1 - begins)
                n += 1
        return total / n

    g = {k: np.full_like(v, 9) for k, v in w.items()}
    before = {"start": np.exp(prior.start), "follow": np.exp(prior.follow), "stop": prior.stop}
    code = np.where(use, y + np.where(opens, 0, p.classes), -1).astype(np.int16)
    A.gradients(w, before, x, ok, code, np.arange(w["e"].size).reshape(w["e"].shape), g)
    for name, v in wide.items():
        for at in r.permutation(np.flatnonzero(np.abs(g[name]) > 1e-4))[:6].tolist() + [v.size - 1]:
            ends = []
            for by in (1e-4, -1e-4):
                moved = v.copy()
                moved.flat[at] += by
                ends.append(loss({**wide, name: moved}))
            assert abs((ends[0] - ends[1]) / 2e-4 - g[name].flat[at]) < 2e-5, (name, at)


def test_inputs_are_projected_once_and_large_logits_stay_finite(monkeypatch):
    """Windows of one input alone against rows of its own for each place; the gradients of equal inputs add up."""
    p, prior, w = toy()
    x = np.full((3, 2 * A.STRIDE), 5, np.int32)
    ok, code = np.ones(x.shape, bool), np.arange(3 * A.STRIDE, dtype=np.int16).reshape(3, A.STRIDE) % (2 * p.classes)
    spread = np.arange(100, 100 + x.size, dtype=np.int32).reshape(x.shape)
    wide = {**w, "e": w["e"].copy(), "start": w["start"] * 400}
    wide["e"][spread] = w["e"][5]
    before = {"start": np.exp(prior.start), "follow": np.exp(prior.follow).copy(), "stop": prior.stop.copy()}
    before["follow"][spread], before["stop"][spread] = before["follow"][5], before["stop"][5]
    largest, bounded = [], A._bounded_exp
    monkeypatch.setattr(A, "_bounded_exp", lambda z: (largest.append(z.max()), bounded(z)))
    got = []
    for inputs in (x, spread):
        g = {k: np.full_like(v, 9) for k, v in wide.items()}
        A.gradients(wide, before, inputs, ok, code, np.arange(w["e"].size).reshape(w["e"].shape), g)
        got.append(g)
    one, many = got
    assert max(largest) > 60 and all(np.isfinite(v).all() for v in one.values())
    assert np.allclose(one["e"][5], many["e"][spread].sum(axis=(0, 1)), rtol=1e-3, atol=1e-4)
    assert all(np.allclose(one[k], many[k], rtol=1e-3, atol=1e-4) for k in one if k != "e")


def test_steps_follow_adam(monkeypatch):
    p, prior, w = toy()
    x, *rest = A.training_windows(p, stream(p, np.arange(20)), np.array([22]))
    given, seen = np.random.default_rng(4), []

    def gradients(w, before, x, ok, code, cells, g):
        seen.append({k: given.normal(size=v.shape).astype(np.float32) for k, v in g.items()})
        for k, v in g.items():
            v[:] = seen[-1][k]

    monkeypatch.setattr(A, "gradients", gradients)
    got = A.train(w, prior, x, *rest, steps=4, rate=0.02)
    for k, v in w.items():
        want, m1, m2 = v.astype(float), 0, 0
        for t, g in enumerate(seen, 1):
            m1, m2 = 0.9 * m1 + 0.1 * g[k], 0.99 * m2 + 0.01 * g[k].astype(float) ** 2
            want = want - 0.02 * (1 - t / 8) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        assert np.abs(got[k] - want).max() < 1e-5


def test_every_window_comes_in_the_steps_of_a_trainer():
    for n in (1, 63, 64, 65, 9_601, 20_000):
        batches = A.shuffled_batches(n, min(A.BATCH, n), 0)
        seen = np.zeros(n, bool)
        for _ in range(L.least_steps(n)):
            seen[next(batches)] = True
        assert seen.all()


def test_training_moves_the_input_row_of_every_window():
    p, prior, _ = toy()
    n = 12_000
    # A window each for 2,000 inputs, and 10,000 of one more input: all rows must move.
    inputs = np.full(n, 2000)
    inputs[:2000] = np.arange(2000)
    x = np.repeat(inputs[:, None], 2 * A.STRIDE, axis=1).astype(np.int32)
    ok, shape = np.ones(x.shape, bool), (n, A.STRIDE)
    w0 = A.initial(p)
    w0 = w0 | {k: np.full_like(w0[k], 0.1) for k in ("start", "follow", "stop")}
    w1 = A.train(w0, prior, x, ok, np.ones(shape, np.int32), np.ones(shape, bool), np.ones(shape, bool), steps=L.least_steps(n))
    assert (w1["e"][:2001] != w0["e"][:2001]).any(axis=1).all()


def test_each_training_text_is_dealt_to_one_round():
    table = pa.table({"key": range(40), "text": [f"t{i // 2}" for i in range(40)], "train": [i % 5 != 0 for i in range(40)]})
    dealt = [L.dealt_texts(9, table, turn) for turn in range(L.ROUNDS)]
    assert sorted(t for d in dealt for t in d) == sorted(f"t{i // 2}" for i in range(40) if i % 5)
    assert max(map(len, dealt)) - min(map(len, dealt)) <= 1


def test_words_are_split_at_ascii_white_space_only():
    r = np.random.default_rng(8)
    texts = [None, "", " ", "\x0b\x0c \r\n", *["".join(map(chr, r.choice([*range(0x21), 65, 90, 97, 0x7F, 0x85, 0xA0, 0xC9, 0x2003, 0x1F600], 60))) for _ in range(200)]]
    for texts in (texts, [None], [], texts[:4]):
        words, numbers, n_words = L.split_words(pa.chunked_array([texts[:2], texts[2:]], pa.string()))
        own = words.to_pylist()
        want = [(t or "").encode().lower().split() for t in texts]
        assert [own[i].encode() for i in numbers] == [w for ws in want for w in ws] and n_words.tolist() == [len(ws) for ws in want]
        assert len(set(own)) == len(own)


def test_answers_lie_in_the_order_of_a_blocks_words(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} Common w{i} x{i * i}" if i else None) for i in range(40)], "doc_id long, text string").repartition(3)
    prepared = L.prepare(docs, "doc_id", "text", F.col("doc_id") < 30, 5).localCheckpoint()
    answered = L.count_words(prepared.where("target >= 0"), PATH, 5).localCheckpoint()
    total = Counter(w for i in range(1, 30) for w in f"w{i % 7} common w{i} x{i * i}".split())
    blocks = prepared.where(F.col("target") == L._DOCS).collect()
    assert len(blocks) == 3
    for row in blocks:
        block = L.Block.unpack(row["payload"])
        parts = [L._unpack(r["payload"]) for r in answered.where(F.col("target") == row["source"]).orderBy("source").collect()]
        words = block.words.to_pylist()
        assert np.concatenate([c for c, _, _ in parts]).tolist() == [total[w] for w in words]
        flat, size = L.codec(PATH).encode_words(words)
        assert np.array_equal(np.concatenate([f for _, f, _ in parts]), flat) and np.array_equal(np.concatenate([s for *_, s in parts]), size)
        at = np.split(block.numbers, np.cumsum(block.n_words)[:-1])
        assert [" ".join(words[j] for j in n) for n in at] == [f"w{i % 7} common w{i} x{i * i}" if i else "" for i in block.key.to_pylist()]


def test_attention_learns_from_every_training_text(spark):
    words = [chr(97 + i) + chr(97 + i) + chr(97 + (i + 5) % 26) + chr(97 + (3 * i + 1) % 26) for i in range(24)]
    docs = spark.createDataFrame([(i, f"{w} " * 40) for i, w in enumerate(words)], "doc_id long, text string").repartition(3)
    prepared = L.prepare(docs, "doc_id", "text", F.col("doc_id") < 20, 2).localCheckpoint()
    answered = L.count_words(prepared.where("target >= 0"), PATH, 2)
    p, prior = L.count_transitions(answered.where(F.col("target") == L._WORDS).coalesce(1), PATH, 20)
    w = L.fit_attention(prepared.where(F.col("target") == L._DOCS), PATH, p, prior, 2)
    moved = (w["e"] != A.initial(p)["e"]).any(axis=1)
    flat, size = L.codec(PATH).encode_words(words).take(np.arange(len(words)))
    pieces = np.split(flat.astype(np.int64), np.cumsum(size)[:-1])
    own = [set(x.tolist()) - {y for j, z in enumerate(pieces) if j != i for y in z.tolist()} for i, x in enumerate(pieces)]
    assert all(own) and all(moved[p.input_of[y]] for x in own[:20] for y in x)


def counted(docs, train):
    c, texts = Counter(), 0
    for (_, t), learn in zip(docs, train, strict=True):
        if learn:
            c.update((t or "").encode().lower().split())
            texts += 1
    c["END"] = texts
    return Counter({k: v for k, v in c.items() if v})


def check(rows, docs, train):
    c = counted(docs, train)
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in docs:
        ws = [*(t or "").encode().lower().split(), "END"]
        want.append((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_whole_table(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = op2_lm_scoring(spark, small_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    check(got, docs, [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, ""), (3, "Ab ab\x0bAB é\x85x \x1cy nb sp"), (None, "held"), (4, "word " * 3000), (5, "<|endoftext|> a<|endoftext|>b")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, source string").repartition(2)
    check(L.lm_scores(df, F.col("doc_id") > 0, PATH).collect(), docs, [d[0] is not None for d in docs])
    check(L.lm_scores(df, F.lit(False), PATH).collect(), docs, [False] * len(docs))
    assert L.lm_scores(df.limit(0), F.lit(True), PATH).collect() == []
