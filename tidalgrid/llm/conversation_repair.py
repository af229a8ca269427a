"""Repairing the turns of conversations by the cheapest edits.

A repaired conversation is empty, or turns user, assistant, user, assistant ... behind at most one
system turn.  Each row is a symbol: its role's initial and its fault.  A symbol's min-plus matrix says
what it costs to pass the row from one state to another; a run of equal symbols is passed through the
cached binary powers of that matrix.  The costs still to come then fix the edits from the front.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

#: Costs of the edits; an undeleted truncated row costs TRUNCATED on top.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing written, or the last turn written is of system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state in which an inserted or reroled turn leaves, for each state before it.
TURN = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INF = 1 << 60

Vector = tuple[int, int, int, int]


def symbol(role: str, fault: str | None) -> str:
    """One letter a row: x must go; s, u, a and o (other) may stay, in capitals if truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def _kept(state: int, letter: str) -> int | None:
    """The state after a row that is kept, None where the order forbids it."""
    if letter == "s":
        return SYSTEM if state == START else None
    target = {"u": USER, "a": ASSISTANT}.get(letter)
    return target if target == TURN[state] else None


def _edits(sym: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) that pass one row, in the order of their letters."""
    if sym == "x":
        return [("D", DELETE, state)]
    extra = TRUNCATED if sym.isupper() else 0
    kept = _kept(state, sym.lower())
    return [("D", DELETE, state), *([("K", KEEP + extra, kept)] if kept is not None else []), ("R", REROLE + extra, TURN[state])]


def _times(a, b):
    """The min-plus product of two matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _applied(a, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


IDENTITY = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
_ONE = tuple(tuple(min(IDENTITY[i][j], INSERT if TURN[i] == j else INF) for j in range(4)) for i in range(4))
#: Any insertions: three steps reach every state.
INSERTIONS = _times(_ONE, _times(_ONE, _ONE))
#: What it costs to end, for each state.
END: Vector = tuple(min(INSERTIONS[i][START], INSERTIONS[i][ASSISTANT]) for i in range(4))


@lru_cache(maxsize=None)  # nine symbols, one power a bit of a run's length
def power(sym: str, k: int):
    """The min-plus matrix of a run of 2**k equal symbols."""
    if k:
        return _times(power(sym, k - 1), power(sym, k - 1))
    row = [[INF] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in _edits(sym, i):
            row[i][j] = min(row[i][j], cost)
    return _times(INSERTIONS, row)


@lru_cache(maxsize=1 << 16)
def _advance(sym: str, length: int, v: Vector) -> Vector:
    for k in range(length.bit_length()):
        if length >> k & 1:
            v = _applied(power(sym, k), v)
    return v


def advance(sym: str, length: int, after: Vector) -> Vector:
    """Costs to come in front of a run, from those behind it."""
    least = min(after)  # only differences matter, so equal situations meet in the cache
    return tuple(least + x for x in _advance(sym, length, tuple(x - least for x in after)))


@lru_cache(maxsize=1 << 16)
def _first(sym: str, state: int, after: Vector) -> tuple[str, int]:
    """The least letters that pass one row on a cheapest way, and the state behind it."""
    letters = ""
    while True:
        here = _applied(power(sym, 0), after)[state]
        found = [(e, j) for e, cost, j in _edits(sym, state) if cost + after[j] == here]
        inserted = INSERT + _applied(power(sym, 0), after)[TURN[state]] == here
        if inserted and (not found or found[0][0] > "I"):
            letters, state = letters + "I", TURN[state]
        else:
            return letters + found[0][0], found[0][1]


def choices(sym: str, length: int, state: int, after: Vector) -> Iterator[tuple[str, int]]:
    """For each row of a run: its letters (insertions before it first) and the state behind it."""
    if length == 1:
        least = min(after)
        yield _first(sym, state, tuple(x - least for x in after))
        return
    half = 1 << (length - 1).bit_length() - 1
    for part, behind in ((length - half, advance(sym, half, after)), (half, after)):
        for letters, state in choices(sym, part, state, behind):
            yield letters, state


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def segment_matrix(symbols: str):
    """The min-plus matrix of a whole stretch of rows."""
    out = IDENTITY
    for sym, length in runs(symbols):
        for k in range(length.bit_length()):
            if length >> k & 1:
                out = _times(out, power(sym, k))
    return out


def unroll(symbols: str, state: int = START, after: Vector = END) -> Iterator[tuple[str, int]]:
    """Letters and state behind each row of a stretch that begins in ``state``; ``after``: costs to come behind it."""
    found, behind = runs(symbols), [after]
    for sym, length in reversed(found):
        behind.append(advance(sym, length, behind[-1]))
    for (sym, length), v in zip(found, behind[-2::-1], strict=True):
        for letters, state in choices(sym, length, state, v):
            yield letters, state


def closing(state: int) -> str:
    """Insertions that end a conversation."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


# --- rows in order -------------------------------------------------------------------------------------------

BLANK_CHARACTERS = " \t\n\x0b\f\r"
#: Rows go back to Spark in batches of about this size.
BATCH_BYTES = 4 << 20
_PLACED = "conv_id {kind}, block int, at bigint, turn bigint, role string, text string, fault string, digest string, again boolean"
_STEPS = "conv_id {kind}, block int, step bigint, edit string, turn bigint, was string, role string, text string, fault string"


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; ``text`` is the place of a long column."""
    held = []

    def made():
        return pa.record_batch([pa.array([r[j] for r in held], f.type) for j, f in enumerate(schema)], schema=schema)

    size = 0
    for r in rows:
        held.append(r)
        size += 64 + (len(r[text] or "") if text is not None else 0)
        if size > BATCH_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _schema(sql: str, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(sql.format(kind=kind)))


def placed_turns(turns: DataFrame) -> DataFrame:
    """All rows of (conv_id, turn, role, text) in order, each with its block, place in it, and fault.

    Rows are cut in blocks by ranges of (conv_id, turn, role, the text's first 100 characters and digest, and a
    number that differs for equal rows), so a conversation of any size, or of equal rows, is dealt to many tasks.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    end = F.rtrim(text, F.lit(BLANK_CHARACTERS))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    d = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.left(text, F.lit(100)).alias("start"), F.monotonically_increasing_id().alias("number"))
    order = ["conv_id", "turn", "role", "start", "digest", "number"]
    kind = dict(d.dtypes)["conv_id"]
    schema = _schema(_PLACED, kind)

    def place(batches):
        block = TaskContext.get().partitionId()

        def rows():
            now, seen = object(), set()
            for at, (conv, turn, role, text, fault, digest) in enumerate(_rows(batches)):
                if conv != now:
                    now, seen = conv, set()
                yield conv, block, at, turn, role, text, fault, digest, digest in seen
                seen.add(digest)

        yield from _batches(rows(), schema, text=5)

    sorted_rows = d.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault", "digest")
    return reliable_checkpoint(sorted_rows.mapInArrow(place, _PLACED.format(kind=kind)))


def _cut_conversations(placed: DataFrame) -> list:
    """The conversations that lie in more than one block: at most one for each place between two blocks."""
    ends = placed.groupBy("block").agg(F.min(F.struct("conv_id")).alias("first"), F.max(F.struct("conv_id")).alias("last")).collect()
    count = Counter(c for r in ends for c in {r.first.conv_id, r.last.conv_id})
    return [c for c, n in count.items() if n > 1]


def _stretches(batches) -> Iterator[tuple[object, int, list[tuple]]]:
    """(conversation, block, rows) of rows sorted by block and place."""
    for (block, conv), rows in groupby(_rows(batches), lambda r: (r[1], r[0])):
        yield conv, block, list(rows)


def _fault(row: tuple) -> str | None:
    return row[6] if row[6] == "blank" else "duplicate" if row[8] else row[6]


def _symbols(rows: list[tuple]) -> str:
    return "".join(symbol(r[4], _fault(r)) for r in rows)


def _with_earlier(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of cut conversations; ``again`` also says whether an earlier block has the row's role and text."""
    rows = placed.join(F.broadcast(cut), placed["conv_id"].eqNullSafe(cut["cut_id"])).drop("cut_id")
    # One entry a block and text: equal rows inside a block are marked already.
    first = rows.where("not again").groupBy("conv_id", "digest").agg(F.min("block").alias("first")).select(
        F.col("conv_id").alias("of"), F.col("digest").alias("same"), "first")
    fresh = rows.where("not again")
    marked = fresh.join(first, fresh["conv_id"].eqNullSafe(first["of"]) & (fresh["digest"] == first["same"]), "left")
    marked = marked.withColumn("again", F.coalesce(F.col("block") > F.col("first"), F.lit(False))).select(*placed.columns)
    whole = marked.unionByName(rows.where("again").select(*placed.columns))
    return reliable_checkpoint(whole.repartition("block").sortWithinPartitions("block", "at"))


def _chained(cut_rows: DataFrame) -> dict[tuple, tuple[int, Vector, bool]]:
    """(conversation, block) -> state in front of that stretch, costs to come behind it, whether it ends the conversation.

    The driver sees a matrix and four states a stretch, at most two stretches a block.
    """

    kind = dict(cut_rows.dtypes)["conv_id"]
    sql = "conv_id {kind}, block int, found array<bigint>"
    schema, sql = _schema(sql, kind), sql.format(kind=kind)

    def matrices(batches):
        yield from _batches(((conv, block, [x for row in segment_matrix(_symbols(rows)) for x in row]) for conv, block, rows in _stretches(batches)), schema)

    by_conv: dict[object, list] = {}
    for r in cut_rows.mapInArrow(matrices, sql).collect():
        by_conv.setdefault(r.conv_id, []).append((r.block, r.found))
    after: dict[tuple, Vector] = {}
    for conv, parts in by_conv.items():
        v = END
        for block, m in sorted(parts, reverse=True):
            after[conv, block] = v
            v = _applied([m[4 * i : 4 * i + 4] for i in range(4)], v)

    def leads_to(symbols: str, state: int, behind: Vector) -> int:
        for _, state in unroll(symbols, state, behind):  # noqa: B007  the last state counts
            pass
        return state

    def exits(batches):
        yield from _batches(((conv, block, [leads_to(_symbols(rows), s, after[conv, block]) for s in range(4)]) for conv, block, rows in _stretches(batches)), schema)

    leads = {(r.conv_id, r.block): r.found for r in cut_rows.mapInArrow(exits, sql).collect()}
    known = {}
    for conv, parts in by_conv.items():
        state, blocks = START, sorted(b for b, _ in parts)
        for block in blocks:
            known[conv, block] = state, after[conv, block], block == blocks[-1]
            state = leads[conv, block][state]
    return known


def _solver(known: dict[tuple, tuple[int, Vector, bool]], schema: pa.Schema) -> Callable:
    def solve(batches):
        def steps():
            for conv, block, rows in _stretches(batches):
                state, after, last = known.get((conv, block), (START, END, True))
                step = 0
                for row, (letters, new) in zip(rows, unroll(_symbols(rows), state, after), strict=True):
                    for _ in letters[:-1]:
                        state = TURN[state]
                        yield conv, block, step, "I", None, None, ROLE_OF[state], "", None
                        step += 1
                    edit = letters[-1]
                    role = None if edit == "D" else row[4] if edit == "K" else ROLE_OF[new]
                    yield conv, block, step, edit, row[3], row[4], role, row[5], _fault(row)
                    step, state = step + 1, new
                for _ in closing(state) if last else "":
                    state = TURN[state]
                    yield conv, block, step, "I", None, None, ROLE_OF[state], "", None
                    step += 1

        yield from _batches(steps(), schema, text=7)

    return solve


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The cheapest edits of all conversations in ``turns`` (conv_id, turn, role, text), in order of
    (conv_id, block, step): edit K (keep), R (reroled), D (deleted) or I (inserted); turn and role of the row (``was``)
    and the new ``role`` (NULL if deleted), text, and the row's fault (blank, duplicate, truncated or NULL).
    Of equally cheap edits the least string of letters counts.

    Rows go by turn, NULL first; ties by role, the text's first 100 characters and its digest, so equal rows stand side by
    side.  A NULL role or text is one space; an empty role is no known role; rows without conv_id are one conversation.
    An empty table gives no edit; other columns are not read.  A conversation
    larger than one task's share lies in several blocks: their min-plus matrices are chained, then each
    block is unrolled from the state its predecessor leaves.  Rows are checkpointed once, in order.
    """
    placed = placed_turns(turns)
    kind = dict(placed.dtypes)["conv_id"]
    schema, sql = _schema(_STEPS, kind), _STEPS.format(kind=kind)
    cut_ids = _cut_conversations(placed)
    if not cut_ids:
        return placed.mapInArrow(_solver({}, schema), sql)
    cut = turns.sparkSession.createDataFrame([(c,) for c in cut_ids], f"cut_id {kind}")
    cut_rows = _with_earlier(placed, cut)
    whole = placed.join(F.broadcast(cut), placed["conv_id"].eqNullSafe(cut["cut_id"]), "left_anti")
    return whole.mapInArrow(_solver({}, schema), sql).unionByName(cut_rows.mapInArrow(_solver(_chained(cut_rows), schema), sql))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: Initials of adjacent turns that may follow each other.
LEGAL = {"su", "ua", "au"}


def repair_summaries(edits: DataFrame) -> DataFrame:
    """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    One pass over each conversation in order, a batch at a time: the digest of a text has to read it from
    front to back, so one task reads one conversation, without holding it.
    """
    kind = dict(edits.dtypes)["conv_id"]
    schema = _schema("conv_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string", kind)

    def digest(batches):
        def conversations():
            for conv, steps in groupby(_rows(batches), lambda r: r[0]):
                n, audit, sha, before, turns, distinct, empty = Counter(), [], hashlib.sha256(), None, [], 0, True
                for _, _, _, edit, turn, was, role, text, fault in steps:
                    audit.append(edit)
                    n["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                    if edit != "I":
                        n[fault] += 1
                        n["illegal"] += before is not None and before + was[:1] not in LEGAL
                        before = was[:1]
                        if turn is not None and (not turns or turns[1] != turn):
                            turns, distinct = [turns[0] if turns else turn, turn], distinct + 1
                    if role is not None:
                        sha.update((("" if empty else "\n") + role + ":" + text).encode())
                        empty = False
                n["gaps"] = turns[1] - turns[0] + 1 - distinct if turns else 0
                yield conv, *[n[c] for c in _COUNTS], "".join(audit), sha.hexdigest()

        yield from _batches(conversations(), schema)

    d = edits.repartition("conv_id").sortWithinPartitions("conv_id", "block", "step")
    return d.mapInArrow(digest, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string")
