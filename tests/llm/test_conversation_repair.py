"""Repairs against a search over all edits, conversations cut over many tasks, and odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidalgrid.llm.conversation_repair import DELETE, INSERT, REROLE, repair_conversations, repair_summaries, segment_matrix, unroll
from tidalgrid.llm.queries.op11_conversation_repair import damaged, op11_conversation_repair, repaired

FORM = re.compile(r"(s?(ua)+)?\Z")


def search(rows):
    """(cost, letters, new rows) of the cheapest edits of (initial, role, text, must go, extra): best-first over written prefixes."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, letters, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and FORM.match(roles):
            return cost, letters, list(out)
        # What is written matters only by its last role.
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))

        def push(c, letter, to, role, text):
            new = roles if role is None else roles + (role[:1] or "?")
            if re.match(r"s?(ua)*u?\Z", new):
                heapq.heappush(heap, (cost + c, letters + letter, to, new, out if role is None else (*out, f"{role}:{text}")))

        for role in ("user", "assistant"):
            push(INSERT, "I", at, role, "")
        if at < len(rows):
            role, text, gone, extra = rows[at]
            push(DELETE, "D", at + 1, None, "")
            if not gone:
                push(extra, "K", at + 1, role, text)
                for new in ("user", "assistant"):
                    push(REROLE + extra, "R", at + 1, new, text)
    raise AssertionError


def brute(turns, keep_all=False):
    """The contract, row by row, from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in turns}:
        rows = []
        for _, turn, role, text in [r for r in turns if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            rule = 9 if keep_all else zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
            rows += [(turn, "user" if rule == 4 else role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:100], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, new = search([(role, text, f in ("blank", "duplicate"), 3 if f == "truncated" else 0) for (_, role, text), f in zip(rows, faults, strict=True)])
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(new).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def random_turns(seed, convs, most):
    rng = random.Random(seed)
    texts = ["a b.", "Yes!", "no end", "", " \n", "x?", None, "c.\x0b", "long " * 40 + "."]
    out = []
    for conv in [*range(convs), None]:
        for k in range(rng.randint(0, most)):
            turn = rng.choice([k, k, k, None, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None, "System"])
            out.append((conv, turn, role, f"{k} {rng.choice(texts)}" if rng.random() < 0.5 else rng.choice(texts)))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def test_random_conversations_equal_the_search(spark):
    turns = random_turns(1, 300, 9)
    assert found(repaired(spark.createDataFrame(turns, TURNS))) == brute(turns)


def test_given_conversations_equal_the_search(spark, small_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_conversation_repair(spark, small_dir)) == brute(turns)


def test_a_conversation_over_many_tasks(spark):
    """A third of all rows in one conversation, with long runs and texts that come again in other blocks."""
    rng = random.Random(2)
    hot = [(5, k // 2, rng.choice(["user", "user", "assistant"]), rng.choice([f"{k}.", f"{k // 3} and", "again.", "", "same!"])) for k in range(700)]
    hot += [(5, 400, "user", f"run {k}.") for k in range(300)] + [(None, None, "assistant", f"other {k}") for k in range(200)] + [(7, 2, "user", "equal.")] * 900
    turns = hot + random_turns(3, 60, 6)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edits = repair_conversations(damaged(spark.createDataFrame(turns, TURNS)))
        assert edits.where("conv_id = 5").select("block").distinct().count() > 1 and edits.where("conv_id = 7").select("block").distinct().count() > 1
        got, want = found(repaired(spark.createDataFrame(turns, TURNS))), brute(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want


def test_edits_of_one_conversation(spark):
    turns = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 1, "user", "Hello?"), (1, 2, "user", "Still there?"), (1, 3, "assistant", "Yes")]
    got = repair_conversations(spark.createDataFrame(turns, TURNS)).orderBy("step").collect()
    assert [(r.edit, r.was, r.role, r.text, r.fault) for r in got] == [
        ("K", "system", "system", "Be brief.", None), ("K", "user", "user", "Hello?", None), ("D", "user", None, "Hello?", "duplicate"),
        ("I", None, "assistant", "", None), ("K", "user", "user", "Still there?", None), ("K", "assistant", "assistant", "Yes", "truncated")]
    assert found(repair_summaries(repair_conversations(spark.createDataFrame(turns, TURNS)))) == brute(turns, keep_all=True)


@pytest.mark.parametrize("symbols", ["u" * 1000 + "A" * 37 + "x" * 65 + "s" * 33, "o" * 511, "ua" * 40 + "uu"])
def test_long_runs(symbols):
    rows = [({"s": "s", "u": "u", "a": "a"}.get(c.lower(), "o"), "", c == "x", 3 if c.isupper() else 0) for c in symbols]
    cost, audit, _ = search(rows)
    got = [letters for letters, _ in unroll(symbols)]
    assert audit.startswith("".join(got)) and set(audit[len("".join(got)) :]) <= {"I"}
    assert min(segment_matrix(symbols)[0][0], segment_matrix(symbols)[0][3], segment_matrix(symbols)[0][2] + INSERT, segment_matrix(symbols)[0][1] + 2 * INSERT) == cost


def test_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repaired(empty).collect() == [] == repair_conversations(empty).collect()
    shape = TURNS + ", block int, step int, digest string, again int, first int, number int, cut_id int"
    long = "wörd " * 200_000 + "."
    turns = [(1, 0, "user", long), (1, 1, "assistant", "ok."), (2, None, None, None)]
    got = found(repaired(spark.createDataFrame([(*t, 1, 2, "d", 3, 4, 5, 6) for t in turns], shape)))
    assert got == brute(turns)
    # A conversation of which the damage leaves nothing still has its row.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(repaired(spark.createDataFrame([(gone, 0, "user", "a.")], TURNS))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
