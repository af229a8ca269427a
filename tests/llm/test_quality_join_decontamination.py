"""Quality rules, n-gram join and decontamination against brute force, with odd rows and clashing names."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidalgrid.llm.chat_format import format_conversations, read_loss, read_turns
from tidalgrid.llm.decontamination import contamination
from tidalgrid.llm.ngram_join import keep_one, near_duplicates
from tidalgrid.llm.quality_rules import apply_rules, document_measures, passing
from tidalgrid.llm.suffix_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words, text = WORD.findall(text or ""), text or ""
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n", "a", "a b c a b c", "x " * 70, "# | <b> && 100%", "same line\nsame line\n\n other\nsame line", "日本 語 é x", "w" * 50_000, "the cat sat on the mat " * 3000]


def test_measures(spark):
    rng = random.Random(3)
    texts = TEXTS + [rng.choice("\n ").join(rng.choice(["a", "b", "c!!", "|", "é.", "\t"]) for _ in range(rng.randrange(40))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, 1, "q", i) for i, t in enumerate(texts * 2)], "id long, text string, measures int, qr_words string, kept long")
    got = document_measures(df.repartition(3)).collect()
    assert got[0].__fields__ == ["id", "text", "measures", "qr_words", "kept", "_measures"]
    assert {r.id: tuple(r._measures)[:5] for r in got} == {i: measured(t) for i, t in enumerate(texts * 2)}
    ruled = apply_rules(df)
    assert ruled.columns[-3:] == ["_measures", "broken_rules", "_kept"] and ruled.where(F.col("_kept") != (F.size("broken_rules") == 0)).count() == 0
    assert passing(df).columns == df.columns and sorted(r.id for r in passing(df).collect()) == sorted(r.id for r in ruled.where("_kept").collect())
    assert apply_rules(df.limit(0)).collect() == []


def grams(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))] for _ in range(25)]
    rows = [(i, " ".join(rng.choice(base))) for i in range(40)]
    for i in range(40, 140):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "one"), (None, "one two"), (None, "one two"), (7, rows[7][1])]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, key int, bands string").repartition(4)).select("doc_id", "class_id", "copy_id", "n_links", "n_class_links").collect()), key=str)
    sets = [grams(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    label = list(range(len(rows)))
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    for _ in rows:
        label = [min([label[i], *[label[j] for j in links[i]]]) for i in range(len(rows))]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = []
    for i, (k, _) in enumerate(rows):
        if not sets[i]:
            want.append((k, k, k, 0, 0))
            continue
        same = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i]]
        together = [rows[j][0] for j in range(len(rows)) if sets[j] and label[j] == label[i]]
        want.append((k, least(together), least(same), len(links[i]), len({frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])})))
    assert got == sorted(want, key=str)


def contaminated(text, items):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, seen = cut(text), set(), []
    for name, item in items:
        b = cut(item)
        found = {i + j for s in range(max(1, len(b) - 12) if b else 0) for i in range(len(w)) if w[i : i + len(b[s : s + 13])] == b[s : s + 13] for j in range(len(b[s : s + 13]))}
        hit |= found
        seen += [name] * bool(found)
    return len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(12)] + ["É", "a-b"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", some(rng.choice([1, 2, 5, 13, 14, 30]))) for k in range(25)] + [("none", None), ("empty", ""), ("signs", "--"), ("twice", "rare phrase here"), ("twin", "rare phrase here")]
    docs = [(k, some(rng.randrange(60))) for k in range(60)] + [(70, None), (71, ""), (72, "Rare, PHRASE\nhere!"), (72, "Rare, PHRASE\nhere!"), (None, "rare phrase"), (73, "x " * 4000 + items[5][1])]
    docs += [(80 + k, " ".join(items[k][1].split()[:13]).upper()) for k in range(10)]
    got = contamination(spark.createDataFrame([(*r, "t", 0) for r in docs], "doc_id long, text string, term string, hit int"), spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, window int"))
    got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((k, *contaminated(t, items)) for k, t in docs), key=str)


def test_conversations_read_back(spark):
    marks = ["</s>[INST] ok [/INST]", "<|end|><|start|>user<|says|>", "<||", "<|", "|>", "", None, "plain\ntext", "<|also|>" * 3, "long " * 30_000]
    rng = random.Random(2)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, "<|says|>"]), rng.choice(marks)) for c in [*range(40), None] for t in range(rng.randrange(7))]
    rows += [(50, 1, "assistant", "same")] * 300
    d = format_conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, t int, formatted string").repartition(5))
    got = {r.conv_id: ([tuple(x) for x in r.turns], r.loss) for r in d.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        want[c] = [(r, x) for _, _, r, x in own], "".join(x for _, _, r, x in own if r == "assistant")
    assert got == want


@pytest.mark.parametrize("stage", [keep_one, remove_repeats, passing])
def test_stages_take_any_names(spark, stage):
    names = ["kept_key", "kept_hash", "text_hash", "own_key", "own_hash", "own_spans", "measures", "kept", "key", "spans", "h", "k", "row"]
    text = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, text, *range(13)), (1, text, *range(1, 14)), (2, text + " tail", *range(13)), (3, "other of the " * 2, *range(13)), (4, None, *range(13))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = stage(df)
    assert out.columns == df.columns and 1 <= out.count() <= 5
    if stage is keep_one:
        assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
