"""A small causal self-attention model over subword ids, in numpy, on top of counted transitions.

The stream of a text is BEGIN, the pieces of its words, END.  After each symbol the model says whether
the word goes on, then gives a distribution over the classes of pieces that can follow: counted
transitions of the whole corpus as prior logits, plus what one attention head reads from the symbols
before.  A class gives its pieces in proportion to their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Pieces with an input row of their own, shared rows for the others, width.
OWN_INPUTS, SHARED_INPUTS, WIDTH = 2048, 64, 32
#: Classes of one piece each and of many, for pieces that begin a word and for those that go on.
OWN_CLASSES, BUCKETS = 119, 8
#: A window is two strides long: the second half is scored, the first is read only.
STRIDE = 16
#: Strength of the class distribution behind counted transitions.
PRIOR_WEIGHT = 20.0
#: Windows in a training step.
BATCH = 64


@dataclass(frozen=True)
class Pieces:
    """How the pieces map to inputs and classes; the same for every text.

    Ids: 0 to n-1 are pieces, n is END, n + 1 is BEGIN.  Each piece either opens a word or goes on, and
    has a class among its kind; END opens, with class 0.
    """

    input_of: np.ndarray
    opens: np.ndarray
    class_of: np.ndarray
    log_inside: np.ndarray  # log P(piece | kind and class)
    n: int

    @property
    def inputs(self) -> int:
        return OWN_INPUTS + SHARED_INPUTS + 2

    @property
    def classes(self) -> int:
        return 1 + OWN_CLASSES + BUCKETS


def map_pieces(counts: np.ndarray, blank: np.ndarray) -> Pieces:
    """From counts of all pieces in the training texts, and which pieces begin with a blank."""
    n = len(counts)
    order = np.lexsort((np.arange(n), -counts))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    input_of = np.concatenate([np.where(rank < OWN_INPUTS, rank, OWN_INPUTS + np.arange(n) % SHARED_INPUTS), [OWN_INPUTS + SHARED_INPUTS, OWN_INPUTS + SHARED_INPUTS + 1]])
    class_of = np.zeros(n + 2, np.int64)
    for kind in (False, True):
        own = order[blank[order] == kind]
        place = np.arange(len(own))
        bucket = np.minimum(np.log2(1 + np.maximum(0, place - OWN_CLASSES) / 64).astype(np.int64), BUCKETS - 1)
        class_of[own] = 1 + np.where(place < OWN_CLASSES, place, OWN_CLASSES + bucket)
    opens = np.concatenate([blank, [True, True]])
    smooth = np.concatenate([counts + 0.5, [1.0, 1.0]])
    cell = class_of + opens * (1 + OWN_CLASSES + BUCKETS)
    total = np.bincount(cell[: n + 1], smooth[: n + 1], minlength=2 * (1 + OWN_CLASSES + BUCKETS))
    return Pieces(input_of.astype(np.int32), opens, class_of.astype(np.int32), np.concatenate([np.log(smooth[: n + 1] / total[cell[: n + 1]]), [0.0]]), n)


@dataclass(frozen=True)
class Prior:
    """Counted logits: ``start`` (classes) of words and END, ``stop`` (inputs) of a word's end, ``follow``
    (inputs x classes) of the next piece inside a word."""

    start: np.ndarray
    stop: np.ndarray
    follow: np.ndarray


def counted_prior(p: Pieces, first: np.ndarray, inner: np.ndarray, last: np.ndarray, ends: float) -> Prior:
    """``first``: words that begin with each class; ``inner`` (inputs x classes): steps inside words;
    ``last``: words that end with each input; ``ends``: texts.  Classes without pieces get nothing."""
    ids, c = np.arange(p.n + 1), p.classes
    start = (first + 0.1) * (np.bincount(p.class_of[ids[p.opens[: p.n + 1]]], minlength=c) > 0)
    start[0] = ends + 0.1
    goes_on = np.bincount(p.class_of[ids[~p.opens[: p.n + 1]]], minlength=c) > 0
    inner = inner * goes_on
    each = (inner.sum(axis=0) + 0.1) * goes_on
    steps = inner.sum(axis=1)
    follow = (inner + PRIOR_WEIGHT * each / each.sum()) / (steps + PRIOR_WEIGHT)[:, None]
    stop = np.log((last + 1) / (steps + 1))
    stop[-1] = 30.0  # after BEGIN only a word or END can come
    return Prior(*[np.log(np.maximum(x, 1e-30)).astype(np.float32) if x is not stop else x.astype(np.float32) for x in (start / start.sum(), stop, follow)])


def initial(p: Pieces, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before training; zero outputs leave the counted prior alone."""
    r = np.random.default_rng(seed)
    f = lambda *s: (r.normal(size=s) / np.sqrt(s[-1])).astype(np.float32)
    w = {"e": f(p.inputs, WIDTH), "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "bias": np.zeros(2 * STRIDE, np.float32)}
    return w | {"start": np.zeros((WIDTH, p.classes), np.float32), "follow": np.zeros((WIDTH, p.classes), np.float32), "stop": np.zeros((WIDTH, 1), np.float32)}


_BACK = np.arange(STRIDE, 2 * STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]  # how far back each key lies
_CAUSAL, _BACK = _BACK >= 0, np.maximum(_BACK, 0)
_SCALE = np.float32(WIDTH**-0.5)


def _attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, bias: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masked attention of the second half of each window over the whole; ``q`` is scaled; ``ok``: keys of the same text."""
    s = q @ k.transpose(0, 2, 1)
    s += np.where(_CAUSAL, bias[_BACK], np.float32(-1e4))  # exp makes it 0
    _bounded_exp(s)
    partly = np.flatnonzero(~ok.all(axis=1))  # few windows hold keys of another text
    s[partly] *= ok[partly, None, :]
    s *= (1 / np.maximum(_row_sums(_flat(s)), np.float32(1e-30))).reshape(s.shape[:2] + (1,))
    return s, s @ v


def _bounded_exp(z: np.ndarray) -> None:
    """``z`` becomes exp of it; a bound keeps it finite without a pass for each row's largest."""
    if z.size and z.max() > 60:
        np.minimum(z, np.float32(60), out=z)
    np.exp(z, out=z)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones((z.shape[1], 1), np.float32)


def shuffled_batches(n: int, batch: int, seed: int) -> Iterator[np.ndarray]:
    """Endless batches of the numbers below ``n``: all of them in a shuffled order, then all in another."""
    order, left = np.random.default_rng(seed), np.zeros(0, np.int64)
    while True:
        while len(left) < batch:
            left = np.concatenate([left, order.permutation(n)])
        yield left[:batch]
        left = left[batch:]


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def gradients(w: dict[str, np.ndarray], before: dict[str, np.ndarray], x: np.ndarray, ok: np.ndarray, code: np.ndarray, cells: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Into ``g``: the gradients, with respect to ``w``, of the mean loss of the next symbols of windows ``x``.

    ``before``: exp of the prior's ``start`` and ``follow``, and its ``stop``.  ``code``: what each symbol predicts, the class behind
    an opening, ``classes`` more behind a piece that goes on, -1 if unused.  ``cells``: numbers of the cells of ``w["e"]``.
    """
    n, classes = len(x), w["start"].shape[1]
    code = code.ravel()
    # Symbols before an opening come first, then those inside a word; unused ones are left out.
    start, follow = np.flatnonzero((code >= 0) & (code < classes)), np.flatnonzero(code >= classes)
    rows, cut = np.concatenate([start, follow]), len(start)
    # Each input of the batch is projected once, however often it stands there.
    there = np.zeros(len(w["e"]), bool)
    there[x] = True
    inputs = np.flatnonzero(there)
    at = np.empty(len(w["e"]), np.int64)
    at[inputs] = np.arange(len(inputs))
    at = at.take(x)
    kv, e = np.concatenate([w["k"], w["v"]], axis=1), w["e"].take(inputs, axis=0)
    q = (e @ (w["q"] * _SCALE)).take(at[:, STRIDE:], axis=0)
    both = (e @ kv).take(at, axis=0)
    k, v = both[..., :WIDTH], both[..., WIDTH:]
    a, o = _attend(q, k, v, w["bias"], ok)
    read, last, share = _flat(o)[rows], x[:, STRIDE:].ravel()[rows], np.float32(1 / max(1, len(rows)))
    ends = 1 / (1 + np.exp(-np.clip(read @ w["stop"][:, 0] + before["stop"][last], -30, 30)))
    ends[:cut] -= 1
    ends *= share
    g["stop"][:, 0] = ends @ read
    z = np.empty((len(rows), classes), np.float32)
    np.matmul(read[:cut], w["start"], out=z[:cut])
    np.matmul(read[cut:], w["follow"], out=z[cut:])
    _bounded_exp(z)
    z[:cut] *= before["start"]
    z[cut:] *= before["follow"].take(last[cut:], axis=0)
    # Rows are divided by their sums behind the products, where they are narrow.
    total = np.maximum(_row_sums(z), np.float32(1e-30))
    z.reshape(-1)[np.arange(0, z.size, classes) + code[rows] % classes] -= total[:, 0]
    total = share / total
    scaled = read * total
    np.matmul(scaled[:cut].T, z[:cut], out=g["start"])
    np.matmul(scaled[cut:].T, z[cut:], out=g["follow"])
    d_read = np.empty_like(read)
    np.matmul(z[:cut], w["start"].T, out=d_read[:cut])
    np.matmul(z[cut:], w["follow"].T, out=d_read[cut:])
    d_read *= total
    d_read += ends[:, None] * w["stop"].T
    do = np.zeros_like(o)
    _flat(do)[rows] = d_read
    ds = do @ v.transpose(0, 2, 1)
    ds -= _row_sums(_flat(do * o)).reshape(ds.shape[:2] + (1,))
    ds *= a
    g["bias"][:] = np.bincount(_BACK[_CAUSAL], ds.sum(axis=0)[_CAUSAL], minlength=2 * STRIDE)
    dkv = np.empty_like(both)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
    np.matmul(a.transpose(0, 2, 1), do, out=dkv[..., WIDTH:])
    # Added up by input first: pairs of columns as complex numbers, which halves the additions.
    by_input = np.zeros((len(inputs), 2 * WIDTH), np.float32)
    np.add.at(by_input.reshape(-1).view(np.complex64), cells.take(at.ravel(), axis=0).ravel(), dkv.reshape(-1).view(np.complex64))
    dq = np.zeros(e.shape, np.float32)
    np.add.at(dq.reshape(-1), cells.take(at[:, STRIDE:].ravel(), axis=0).ravel(), (ds @ k).ravel())
    dq *= _SCALE
    g["e"][:] = 0
    g["e"][inputs] = by_input @ kv.T + dq @ w["q"].T
    np.matmul(e.T, dq, out=g["q"])
    g["k"][:], g["v"][:] = np.hsplit(e.T @ by_input, 2)


def train(w: dict[str, np.ndarray], prior: Prior, x: np.ndarray, ok: np.ndarray, y: np.ndarray, opens: np.ndarray, use: np.ndarray, steps: int, rate: float = 0.01, batch: int = BATCH, seed: int = 0) -> dict[str, np.ndarray]:
    """``steps`` of Adam on windows ``x``; the next symbols open a word or not, with classes ``y``, where ``use``.

    No window comes again before all others have come: ``len(x) / batch`` steps, rounded up, use each.
    """
    # Parameters, gradients and moments lie in flat arrays: a step of Adam is a few passes in place.
    now = np.concatenate([v.ravel() for v in w.values()]).astype(np.float32)
    grad, m1, m2, move = (np.zeros_like(now) for _ in range(4))
    ends = np.cumsum([v.size for v in w.values()])[:-1]
    shaped = lambda a: {k: part.reshape(v.shape) for (k, v), part in zip(w.items(), np.split(a, ends), strict=True)}
    w, g = shaped(now), shaped(grad)
    before = {"start": np.exp(prior.start), "follow": np.exp(prior.follow), "stop": prior.stop}
    code = np.where(use, y + np.where(opens, 0, w["start"].shape[1]), -1).astype(np.int16)
    cells = np.arange(w["e"].size).reshape(w["e"].shape)
    batches = shuffled_batches(len(x), min(batch, len(x)), seed)
    for t in range(1, steps + 1):
        pick = next(batches)
        gradients(w, before, x.take(pick, axis=0), ok.take(pick, axis=0), code.take(pick, axis=0), cells, g)
        # Decays 0.9 and 0.99; the moments are kept without their factors 0.1 and 0.01.
        m1 *= np.float32(0.9)
        m1 += grad
        grad *= grad
        m2 *= np.float32(0.99)
        m2 += grad
        scale = 0.1 / math.sqrt(1 - 0.99**t)
        np.sqrt(m2, out=move)
        move += np.float32(1e-8 / scale)
        np.divide(m1, move, out=move)
        move *= np.float32(rate * (1 - t / (2 * steps)) * 0.1 / (1 - 0.9**t) / scale)
        now -= move
    return w


def _lay_out(p: Pieces, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every stream fills whole strides, behind one empty stride: (place of each symbol, symbols, owners)."""
    strides = -(-size // STRIDE)
    first = np.concatenate([[0], np.cumsum(strides)])
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = STRIDE + np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(first[:-1] * STRIDE, size)
    x = np.full((int(first[-1]) + 1) * STRIDE, p.n, np.int64)  # END is the filler
    owner = np.full(len(x), -1, np.int32)
    x[place], owner[place] = symbols, np.repeat(np.arange(len(size), dtype=np.int32), size)
    return place, x, owner.reshape(-1, STRIDE)


def _windows(strides: np.ndarray) -> np.ndarray:
    """Each stride but the first behind the one before it, as overlapping views."""
    n, _, width = strides.shape
    row = strides.itemsize * width
    return np.lib.stride_tricks.as_strided(strides, (n - 1, 2 * STRIDE, width), (STRIDE * row, row, strides.itemsize), writeable=False)


def score_streams(p: Pieces, w: dict[str, np.ndarray], prior: Prior, symbols: np.ndarray, size: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the streams laid end to end: (log P(next symbol | its kind), log P(next's kind)).

    Kinds are: opens a word (or is END), goes on.  Each stream starts with BEGIN and ends with END, whose
    own values are 0.  Every symbol is scored in exactly one window, cut by its own stream alone.
    """
    place, x, owner = _lay_out(p, symbols, size)
    inputs = p.input_of[x].reshape(-1, STRIDE)
    after = np.concatenate([x[1:], [p.n]]).reshape(-1, STRIDE)
    which, kind = np.zeros(after.shape, np.float32), np.zeros(after.shape, np.float32)
    q, kv = w["e"] @ (w["q"] * _SCALE), w["e"] @ np.concatenate([w["k"], w["v"]], axis=1)
    start, follow = np.exp(prior.start), np.exp(prior.follow)
    for a in range(1, len(inputs), at_once):
        z = min(len(inputs), a + at_once)
        same = np.concatenate([owner[a - 1 : z - 1], owner[a:z]], axis=1) == owner[a:z, :1]
        both = _windows(kv.take(inputs[a - 1 : z], axis=0))
        o = _attend(q.take(inputs[a:z], axis=0), both[..., :WIDTH], both[..., WIDTH:], w["bias"], same)[1].reshape(-1, WIDTH)
        last, nxt = inputs[a:z].ravel(), after[a:z].ravel()
        on = p.opens[nxt]
        sign = np.where(on, np.float32(-1), np.float32(1))
        other = np.exp(np.minimum(sign * (o @ w["stop"][:, 0] + prior.stop[last]), np.float32(80)))
        kind[a:z] = -np.log(1 + other).reshape(-1, STRIDE)
        got = np.empty(len(nxt), np.float32)
        for name, rows in (("start", np.flatnonzero(on)), ("follow", np.flatnonzero(~on))):
            m = o[rows] @ w[name]
            np.exp(m, out=m)
            own, after_last = p.class_of[nxt[rows]], last[rows]
            if name == "start":
                total, prior_of = m @ start, start[own]
            else:
                total, prior_of = np.einsum("ij,ij->i", m, follow.take(after_last, axis=0)), follow[after_last, own]
            got[rows] = m[np.arange(len(rows)), own] * prior_of / total
        which[a:z] = (np.log(np.maximum(got, 1e-30)) + p.log_inside[nxt]).reshape(-1, STRIDE)
    which, kind = which.ravel()[place].astype(np.float64), kind.ravel()[place].astype(np.float64)
    ends = np.cumsum(size) - 1
    which[ends] = kind[ends] = 0
    return which, kind


def training_windows(p: Pieces, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows that ``score_streams`` scores: (inputs, keys of the text, classes that follow, whether they open, which count)."""
    place, x, owner = _lay_out(p, symbols, size)
    after = np.concatenate([x[1:], [p.n]])
    counts = np.zeros(len(x), bool)
    counts[place] = True
    counts[place[np.cumsum(size) - 1]] = False
    inputs, cut = p.input_of[x].reshape(-1, STRIDE), lambda v: v.reshape(-1, STRIDE)[1:]
    keys = np.concatenate([inputs[:-1], inputs[1:]], axis=1)
    same = np.concatenate([owner[:-1], owner[1:]], axis=1) == owner[1:, :1]
    return keys, same, cut(p.class_of[after]), cut(p.opens[after]), cut(counts)
