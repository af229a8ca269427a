"""The pipeline's rows against a brute-force version of all five stages, and the entry's contract."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidalgrid.llm import suffix_dedup as S
from tidalgrid.llm.quality_rules import RULES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def passes(spark, texts):
    from tidalgrid.llm.quality_rules import apply_rules

    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r.i for r in apply_rules(df).where("kept").collect()}


def near(texts):
    """Indices that stay when each component of similarity 0.8 keeps its first."""
    grams = []
    for t in texts:
        w = WORDS.findall(t)
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    by = defaultdict(list)
    for i, g in enumerate(grams):
        for x in g:
            by[x].append(i)
    shared = Counter((a, b) for m in by.values() for k, a in enumerate(m) for b in m[k + 1 :])
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), k in shared.items():
        if k >= 0.8 * (len(grams[a]) + len(grams[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if find(i) == i]


def cut(texts, length):
    raws = [t.encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raws for i in range(len(t) - length + 1))
    out = []
    for t in raws:
        spans = S.joined_spans((i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1)
        out.append(S.without(t, S.whole_characters(t, spans)).decode())
    return out


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    w, hit = words(text), set()
    grams = {}
    for t in items:
        b = words(t)
        for i in range(max(1, len(b) - 12) if b else 0):
            grams.setdefault(min(13, len(b)), set()).add(tuple(b[i : i + 13]))
    for k, g in grams.items():
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in g:
                hit.update(range(i, i + k))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def brute(spark, docs, items):
    docs = sorted(docs)
    docs = [docs[i] for i in sorted(passes(spark, [t for _, t in docs]))]
    docs = [docs[i] for i in near([t for _, t in docs])]
    docs = list(zip([i for i, _ in docs], cut([t for _, t in docs], corpus_pipeline.REPEAT_BYTES), strict=True))
    docs = [(i, t) for i, t in docs if not contaminated(t, items)]
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in docs:
        ids = tk.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_run_equals_brute_force(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, small_dir).collect())
    assert got == brute(spark, docs, items) and 0 < len(got) < len(docs)


def test_stages_keep_columns_and_odd_rows(spark, small_dir):
    long = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long + " tail", "en", "s", 5), (3, None, None, None, None), (None, "of the " * 3, "de", "t", 1), (4, "", "fr", "u", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, small_dir)
        assert kept.columns == docs.columns
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(1, long)]
    everything = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        everything = stage(spark, everything, small_dir)
    assert sorted(str(r.doc_id) for r in everything.collect()) == ["1", "3", "4", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small_dir).collect() == []


def test_a_repeat_of_51_short_words_goes(spark, small_dir):
    passage = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + 7 * i % 26)}" for i in range(51))
    own = lambda k: " ".join(f"own{k}word{i}" for i in range(80))
    rows = [(k, f"{own(k)} {k}{passage}{k} {own(k + 10)}") for k in range(3)] + [(3, own(3))]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, small_dir).collect()}
    assert len(passage) == 203 and got == {k: f"{own(k)} {k}{k} {own(k + 10)}" for k in range(3)} | {3: own(3)}


def test_unrelated_texts_of_one_id_or_none_all_stay(spark):
    from tidalgrid.llm.ngram_join import keep_one

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2) + " end"), (7, text(3)), (7, text(4)), (7, text(4)), (9, text(5)), (None, text(5)), (8, text(3) + " end")]
    blank = [(None, None), (None, ""), (None, " \n"), (7, ""), (7, None), (7, None)]
    docs = spark.createDataFrame(rows + blank, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    either = [r for r in got if r[1] in (text(2), text(2) + " end")]
    assert len(either) == 1
    assert got == sorted([(None, text(0)), (None, text(1)), *either, (7, text(3)), (7, text(4)), (9, text(5)), *blank], key=str)


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"]
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= names and len(RULES) > 5


@pytest.mark.parametrize("bad", [True, False])
def test_lists_without_repeats(bad):
    assert near(["a b c d e f"] * (2 if bad else 1)) == [0]
