"""Exact repeats of a fixed length across all texts, by a distributed merge sort of suffixes.

Not every suffix is sorted.  In each window of ``length`` bytes the smallest hash of a short gram picks
one *anchor*; equal windows pick it at the same place, so it is enough to sort the suffixes at anchors.
An anchor's entry holds the bytes its windows can reach, to the right and, reversed, to the left.

1. Tasks collapse equal entries, sort the rest into runs, front-code them and cut them at splitters.
2. Each range of keys merges its runs with a loser tree that knows how many bytes a candidate shares
   with the last winner, and compares bytes only behind that.
3. Equal entries repeat in full.  Entries that share the gram only repeat where a window of one equals
   a window of the other at the same distance from the anchor; those few windows are compared.
   The windows of a gram so frequent that it spans ranges are compared by one more exchange.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .columns import fresh

LENGTH = 400
#: Bytes of the gram whose hash picks anchors.
GRAM = 32
#: Text in one sorted run, and in one step of anchor search, in bytes.
RUN_BYTES, STEP_BYTES = 32 << 20, 4 << 20
#: Text whose anchors give the splitters, in bytes, and splitter candidates a range; neither changes results.
SAMPLE_BYTES, CANDIDATES = 32 << 20, 20
#: Entries whose windows are compared at once.
ROWS_AT_ONCE = 2048

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NO_KEY = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram, the same wherever the gram stands: prefix sums of a polynomial, shifted back."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(int(_BASE), len(raw)), out=total[1:])
    return _mix((total[gram:] - total[:-gram]) * _powers(pow(int(_BASE), -1, 1 << 64), len(raw) - gram + 1))


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): the windows [first, last] of ``raw`` that pick each anchor."""
    n = len(raw) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    h = _gram_hashes(raw, gram)
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = length - gram + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return at[first], first, last


def entries_of(raw: bytes, length: int, gram: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, anchor, lo, hi) of a text: windows begin lo to hi bytes before the anchor.

    The key is what those windows hold from the anchor on, then, backwards, before it, then lo.
    """
    for start in range(0, max(1, len(raw) - length + 1), STEP_BYTES):
        part = np.frombuffer(raw, np.uint8)[start : start + STEP_BYTES + length - 1]
        for a, first, last in zip(*[x.tolist() for x in anchors(part, length, gram)], strict=True):
            at, lo, hi = start + a, a - last, a - first
            yield raw[at : at + length - lo] + raw[at - hi : at][::-1] + lo.to_bytes(2, "big"), at, lo, hi


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes ``a`` and ``b`` share, given that it is ``known`` or more."""
    n, h = min(len(a), len(b)), known
    while h < n:
        e = min(n, h + 64)
        x, y = a[h:e], b[h:e]
        if x != y:
            return e - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        h = e
    return n


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (key, bytes shared with the run's key before, payload).

    A loser tree in which each loser keeps how many bytes it shares with the winner that beat it.  The
    candidate that shares more with the last winner is the smaller one; only candidates that share the
    same number are compared, and only from there on.  Yields (key, bytes shared with the key before, payload).
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two candidates; the loser's shared count becomes that with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        k, m = x[0], y[0]
        h = common_prefix(k, m, p)
        if k[h:] <= m[h:]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    best = list(range(size)) * 2
    for node in range(size - 1, 0, -1):
        best[node], losers[node] = play(best[2 * node] if node < size // 2 else 2 * node - size, best[2 * node + 1] if node < size // 2 else 2 * node + 1 - size)
    winner = best[1] if size > 1 else 0
    while heads[winner] is not None:
        key, _, payload = heads[winner]
        yield key, shared[winner], payload
        heads[winner] = new = next(runs[winner], None)
        shared[winner] = new[1] if new else 0
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def front_code(rows: list[tuple[bytes, bool, int, int, int]]) -> bytes:
    """Sorted (key, repeated, doc key, text hash, anchor) rows, keys as shared length and rest."""
    cut, rests, before = np.zeros(len(rows), np.uint16), [], b""
    for i, r in enumerate(rows):
        cut[i] = h = common_prefix(before, r[0])
        rests.append(r[0][h:])
        before = r[0]
    table = pa.table({
        "shared": cut, "rest": pa.array(rests, pa.binary()), "repeated": pa.array([r[1] for r in rows]),
        "key": pa.array([r[2] for r in rows], pa.int64()), "text_hash": pa.array([r[3] for r in rows], pa.int64()), "at": pa.array([r[4] for r in rows], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=4).compress(sink.getvalue().to_pybytes())


def decoded(data: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    key = b""
    for batch in table.to_batches(max_chunksize=4096):
        for h, rest, *payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            key = key[:h] + rest
            yield key, h, tuple(payload)


class Windows:
    """Hashes of windows of entries, one distance from the anchor after another."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.most = length, length - gram
        self.weight = np.random.default_rng(20240301).integers(1, 1 << 63, self.most + length + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def each(self, keys: list[bytes], lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(distance, rows that have that window, their hashes) for each distance some row has."""
        n, most, length = len(keys), self.most, self.length
        m = np.zeros((n, most + length), np.uint8)
        for i, k in enumerate(keys):
            own_lo = int.from_bytes(k[-2:], "big")
            right, left = k[: length - own_lo], k[length - own_lo : -2][::-1]
            m[i, most - len(left) : most] = np.frombuffer(left, np.uint8)
            m[i, most : most + len(right)] = np.frombuffer(right, np.uint8)
        m = np.ascontiguousarray(m.T)
        term = lambda c: _BYTE[m[c]] * self.weight[c]
        first, last = int(lo.min()), int(hi.max())
        h = np.zeros(n, np.uint64)
        for c in range(most - first, most - first + length):
            h += term(c)
        for d in range(first, last + 1):
            rows = np.flatnonzero((lo <= d) & (d <= hi))
            if len(rows):
                yield d, rows, _mix(h[rows] ^ np.uint64(d))
            if d < last:
                h += term(most - d - 1) - term(most - d - 1 + length)


_FOUND = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("past", pa.int64()), ("window", pa.int64()), ("asks", pa.bool_())])
_FOUND_SQL = "key bigint, text_hash bigint, at bigint, start bigint, past bigint, window bigint, asks boolean"


class Resolver:
    """Turns a merged stream of entries into repeated spans and, for cut grams, questions about windows."""

    def __init__(self, length: int, gram: int, cut: frozenset[bytes]) -> None:
        self.length, self.gram, self.cut = length, gram, cut
        self.windows = Windows(length, gram)
        self.spans: list[tuple] = []
        self.asked: list[tuple] = []
        self.held: list[tuple] = []

    def span(self, who: tuple, near: int, far: int) -> None:
        key, text_hash, at = who
        self.spans.append((key, text_hash, at, at - far, at - near + self.length, None, None))

    def feed(self, merged: Iterable[tuple[bytes, int, tuple]]) -> Iterator[pa.RecordBatch]:
        """An entry is (key, repeated, members, most bytes shared with a neighbour)."""
        group: list[list] = []
        for key, shared, (repeated, *who) in merged:
            if group and shared == len(key) == len(group[-1][0]):
                group[-1][1] = True
                if not repeated:
                    group[-1][2].append(tuple(who))
                continue
            if shared < self.gram and group:
                self.close(group)
                group = []
                if len(self.held) >= ROWS_AT_ONCE:
                    self.compare()
                if len(self.spans) + len(self.asked) > 50_000:
                    yield from self.flush()
            if group:
                group[-1][3] = max(group[-1][3], shared)
            group.append([key, repeated, [] if repeated else [tuple(who)], shared if group else 0, shared])
        if group:
            self.close(group)
        self.compare()
        yield from self.flush()

    def reach(self, key: bytes) -> tuple[int, int]:
        lo = int.from_bytes(key[-2:], "big")
        return lo, len(key) - 2 - (self.length - lo)

    def close(self, group: list[list]) -> None:
        """All entries of one gram in this range: settle equal ones, keep those that may share windows."""
        cut = group[0][0][: self.gram] in self.cut
        rows = []
        # Keys of other ranges lie beyond the first or the last one here, so what an entry shares with the
        # farther keys on either side bounds what it shares with any entry elsewhere.
        outside = np.zeros(len(group), np.int64)
        if cut and len(group) > 1:
            steps = np.array([g[4] for g in group[1:]])
            outside = np.maximum(
                np.concatenate([[self.length], np.minimum.accumulate(steps)]), np.concatenate([np.minimum.accumulate(steps[::-1])[::-1], [self.length]]))
        elif cut:
            outside[:] = self.length
        for i, (key, repeated, members, shared, _) in enumerate(group):
            lo, hi = self.reach(key)
            if repeated:
                for who in members:
                    self.span(who, lo, hi)
            # A window d bytes before the anchor needs a neighbour that shares length - d bytes behind it.
            near = lo if cut and i in (0, len(group) - 1) else max(lo, self.length - shared)
            if near <= hi:
                rows.append((key, near, hi, repeated, members[0] if members and not repeated else None, max(near, self.length - int(outside[i]))))
        if cut:
            self.ask(rows)
        elif len(rows) > 1:
            self.held += rows

    def compare(self) -> None:
        rows, self.held = self.held, []
        if rows:
            self.settle(rows, ask=False)

    def ask(self, rows: list[tuple]) -> None:
        if rows:
            self.settle(rows, ask=True)

    def settle(self, rows: list[tuple], ask: bool) -> None:
        lo, hi = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        near, far = np.full(len(rows), 1 << 30), np.full(len(rows), -1)
        known, ask_from = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
        for d, at, h in self.windows.each([r[0] for r in rows], lo, hi):
            value, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            twice = at[count[inverse] > 1]
            near[twice] = np.minimum(near[twice], d)
            far[twice] = d
            if ask:
                told = np.zeros(len(value), bool)
                np.logical_or.at(told, inverse, d >= ask_from[at])
                for v, i, c in zip(value.view(np.int64)[told].tolist(), at[first][told].tolist(), count[told].tolist(), strict=True):
                    who = rows[i][4]
                    if c == 1 and not known[i]:
                        self.asked.append((*who, who[2] - d, who[2] - d + self.length, v, True))
                    else:
                        self.asked.append((None, None, None, None, None, v, False))
        for i in np.flatnonzero(far >= 0).tolist():
            if rows[i][4] is not None:
                self.span(rows[i][4], int(near[i]), int(far[i]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        found = self.spans + self.asked
        self.spans, self.asked = [], []
        if found:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))


def splitters(d: DataFrame, ranges: int, total: int, length: int, gram: int) -> tuple[list[bytes], frozenset[bytes]]:
    """Keys that cut the entries into about equal ranges, and the grams that span more than one.

    A splitter is shortened to its gram, so that a gram stays whole, unless three in a row hold the same
    gram: a gram of up to three ranges is left in one task, a larger one is cut.
    """
    part = min(1.0, SAMPLE_BYTES / max(1, total))
    step = max(1, int(total * part / 190) // (CANDIDATES * ranges))

    def candidates(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    # Which of a text's entries to take depends on the text alone.
                    seen = {e[0] for e in entries_of(t.encode("utf-8", "replace"), length, gram)}
                    keys = [k for k in seen if int.from_bytes(k[-18:-2], "big") % 1_000_003 % step == 0]
                    if keys:
                        yield pa.record_batch({"k": pa.array(keys, pa.binary())})

    sampled = d.select("text") if part >= 1 else d.select("text").sample(part, seed=17)
    # About CANDIDATES keys a range come to the driver: their number does not depend on the input.
    keys = sorted({bytes(r["k"]) for r in sampled.mapInArrow(candidates, "k binary").distinct().collect()})
    picked = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    grams = [k[:gram] for k in picked]
    cut = frozenset(g for g, _, again in zip(grams, grams[1:], grams[2:], strict=False) if g == again)
    return sorted({k if k[:gram] in cut else k[:gram] for k in picked}), cut


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, ranges: int | None = None) -> DataFrame:
    """(key, text_hash, spans): sorted (start, past) byte spans of each text that a ``length``-byte string
    covers which starts at another place too, in any row.

    Texts shorter than ``length``, NULL and empty ones have none.  ``key`` is a long column; a NULL key
    shows as the smallest long.  Rows equal in key and text share their spans: each repeats the others.
    """
    d = _keyed(docs, key, text)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20))
    cuts, cut = splitters(d, ranges, total, length, gram)

    def blocks(held: dict[bytes, list[tuple]], spans: list[tuple]) -> Iterator[pa.RecordBatch]:
        """One sorted run, cut at the splitters; entries that repeat inside the run are settled here."""
        rows = []
        for k in sorted(held):
            members = held[k]
            if len(members) > 1:
                lo = int.from_bytes(k[-2:], "big")
                hi = len(k) - 2 - (length - lo)
                spans += [(who[0], who[1], who[2] - hi, who[2] - lo + length) for who in members]
            rows.append((k, len(members) > 1, *members[0]))
        keys = [r[0] for r in rows]
        at = [0, *[bisect_left(keys, c) for c in cuts], len(keys)]
        parts = [(p, rows[a:z]) for p, (a, z) in enumerate(zip(at, at[1:], strict=False)) if z > a]
        # Spans already known ride along, dealt over the ranges.
        merged = _merged(spans)
        share = -(-len(merged) // (len(cuts) + 1)) or 1
        known = {p: merged[p * share : (p + 1) * share] for p in range(len(cuts) + 1) if merged[p * share : (p + 1) * share]}
        payload = {p: front_code(r) for p, r in parts}
        for p in sorted(payload.keys() | known.keys()):
            spans_here = np.array(known.get(p, []), np.int64).reshape(-1, 4)
            yield pa.record_batch({
                "part": pa.array([p], pa.int32()), "run": pa.array([payload.get(p)], pa.binary()), "spans": pa.array([spans_here.tobytes()], pa.binary())})

    def sort_runs(batches):
        held, spans, size = {}, [], 0
        for b in batches:
            for k, h, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = (t or "").encode("utf-8", "replace")
                if len(raw) < length:
                    continue
                for entry, at, _, _ in entries_of(raw, length, gram):
                    held.setdefault(entry, []).append((k, h, at))
                size += len(raw)
                if size >= RUN_BYTES:
                    yield from blocks(held, spans)
                    held, spans, size = {}, [], 0
        if held:
            yield from blocks(held, spans)

    def merge(batches):
        runs: list[bytes] = []
        for b in batches:
            for run, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if run is not None:
                    runs.append(run)
                s = np.frombuffer(spans, np.int64).reshape(-1, 4)
                if len(s):
                    none = pa.nulls(len(s), pa.int64())
                    yield pa.record_batch([pa.array(s[:, 0]), pa.array(s[:, 1]), none, pa.array(s[:, 2]), pa.array(s[:, 3]), none, pa.nulls(len(s), pa.bool_())], schema=_FOUND)
        if runs:
            yield from Resolver(length, gram, cut).feed(merge_runs([decoded(r) for r in runs]))

    runs = d.mapInArrow(sort_runs, "part int, run binary, spans binary").repartitionById(len(cuts) + 1, F.col("part"))
    found = reliable_checkpoint(runs.mapInArrow(merge, _FOUND_SQL))
    spans = found.where("window IS NULL").select("key", "text_hash", "start", "past")
    if cut:
        asked = found.where("window IS NOT NULL")
        again = asked.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        told = asked.where("asks").join(again, "window").groupBy("key", "text_hash", "at").agg(F.min("start").alias("start"), F.max("past").alias("past"))
        spans = spans.unionByName(told.select("key", "text_hash", "start", "past"))
    return spans.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "past"))).alias("spans"))


def _merged(spans: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of the same text joined where they touch."""
    out: list[tuple[int, int, int, int]] = []
    for k, h, a, z in sorted(set(spans)):
        if out and out[-1][:2] == (k, h) and a <= out[-1][3]:
            out[-1] = (k, h, out[-1][2], max(z, out[-1][3]))
        else:
            out.append((k, h, a, z))
    return out


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(a, z) for _, _, a, z in _merged((0, 0, a, z) for a, z in spans)]


def without(raw: bytes, spans: Iterable[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spans`` shrunk so that no character of UTF-8 is cut."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, z in spans:
        while inside(a):
            a += 1
        while z > a and inside(z):
            z -= 1
        if a < z:
            out.append((a, z))
    return out


def with_spans(docs: DataFrame, key: str, text: str, row: Callable[[bytes, list[tuple[int, int]]], tuple], fields: dict[str, pa.DataType], sql: str, **options) -> DataFrame:
    """Each row's ``key`` and ``row(text as bytes, joined spans)``; every row of ``docs`` comes back."""
    spans = repeated_spans(docs, key, text, **options)
    own = _keyed(docs, key, text).join(spans, ["key", "text_hash"], "left").select("key", "text", "spans")

    def compute(batches):
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "replace")
                out.append(row(raw, joined_spans((x["start"], x["past"]) for x in s or [])))
            yield pa.record_batch([b.column(0)] + [pa.array([r[j] for r in out], kind) for j, kind in enumerate(fields.values())], names=["key", *fields])

    d = own.mapInArrow(compute, f"key bigint, {sql}")
    return d.select(F.when(F.col("key") != _NO_KEY, F.col("key")).alias(key), *fields)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``, in whole characters; all rows and columns stay.

    A NULL text stays NULL; a text that repeats as a whole becomes empty.  Other columns may have any names.
    """
    own, digest, found = (fresh(docs, n) for n in ("own_key", "own_hash", "own_spans"))
    spans = repeated_spans(docs, key, text, **options).select(F.col("key").alias(own), F.col("text_hash").alias(digest), F.col("spans").alias(found))
    d = docs.join(spans, (F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)) == F.col(own)) & (F.xxhash64(F.col(text)) == F.col(digest)), "left")
    names, at = docs.columns, docs.columns.index(text)

    def cut(batches):
        for b in batches:
            texts = []
            for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if t and s:
                    raw = t.encode("utf-8", "replace")
                    t = without(raw, whole_characters(raw, joined_spans((x["start"], x["past"]) for x in s))).decode("utf-8")
                texts.append(t)
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=names)

    return d.select(*[F.col(f"`{c}`") for c in names], found).mapInArrow(cut, docs.schema)
