"""Language-model scores of whole texts: counted words of all training texts mixed with attention.

P(word | before) = SHARE * count / all  +  (1 - SHARE) * P(its pieces, then the word's end | before).
Both parts are distributions over words and END, so a score is the log probability of the text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from . import attention as A
from .bpe import Ragged, _blocks, _dealt, _joined, codec

#: Weight of counted words.
SHARE = 0.2
#: Rounds of training on disjoint parts of the training texts, with parameters averaged after each, and
#: the steps a trainer makes in a round at least.
ROUNDS, LEAST_STEPS = 3, 150
#: Training text for one trainer, in bytes, and distinct words for one task that adds up transitions:
#: both kinds of tasks grow in number with the corpus and each sends a table of fixed size.
TRAINER_BYTES, WORDS_A_TASK = 2 << 20, 100_000
BLOCK_BYTES = 4 << 20

_ROWS = pa.schema([("target", pa.int64()), ("source", pa.int64()), ("payload", pa.binary())])
_ROWS_SQL = "target bigint, source bigint, payload binary"
_DOCS, _STATS, _WORDS = -1, -2, -3


def _pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _words_out(words: pa.LargeStringArray) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.large_string())])) as s:
        s.write_batch(pa.record_batch([words], names=["word"]))
    return sink.getvalue().to_pybytes()


def _words_in(b: bytes) -> pa.LargeStringArray:
    return pa.ipc.open_stream(b).read_next_batch().column(0)


def split_words(texts: pa.ChunkedArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Lower-cased (A to Z) words between blanks and the controls from tab to carriage return: (distinct
    ones, the number of each word of all texts end to end, how many each text has)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, n_words = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word
    if not full.all():
        n_words = np.bincount(np.repeat(np.arange(len(n_words)), n_words)[full], minlength=len(n_words))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), n_words


@dataclass(frozen=True)
class Block:
    """A block of documents: their keys, which teach, their sizes in bytes, and their words as numbers among ``words``."""

    key: pa.Array
    train: np.ndarray
    size: np.ndarray
    words: pa.LargeStringArray
    numbers: np.ndarray
    n_words: np.ndarray

    def pack(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("key", self.key.type)])) as s:
            s.write_batch(pa.record_batch([self.key], names=["key"]))
        return _pack((sink.getvalue().to_pybytes(), self.train, self.size, _words_out(self.words), self.numbers, self.n_words))

    @staticmethod
    def unpack(b: bytes) -> Block:
        key, train, size, words, numbers, n_words = _unpack(b)
        return Block(pa.ipc.open_stream(key).read_next_batch().column(0), train, size, _words_in(words), numbers, n_words)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def prepare(docs: DataFrame, key: str, text: str, train: Column, targets: int) -> DataFrame:
    """Blocks of documents, compressed, and what each asks: its distinct words with training counts.

    A block's words are numbered in the order of the targets it asks, so answers laid end to end fit the numbers.
    """
    def compute(batches):
        for block, table in _blocks(batches, BLOCK_BYTES):
            words, numbers, n_words = split_words(table["text"])
            learn = table["train"].to_numpy()
            counts = np.bincount(numbers[np.repeat(learn, n_words)], minlength=len(words))
            to = _dealt(words, targets) if len(words) else np.zeros(0, np.int64)
            order = np.argsort(to, kind="stable")
            words, counts, place = words.take(pa.array(order)), counts[order], np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            ends = np.cumsum(np.bincount(to, minlength=targets))
            rows = [(t, block, _pack((_words_out(words.slice(a, z - a)), counts[a:z]))) for t, (a, z) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)) if z > a]
            size = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy().astype(np.int64)
            yield _rows([*rows, (_DOCS, block, Block(table["key"].combine_chunks(), learn, size, words, place[numbers], n_words).pack())])

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return d.mapInArrow(compute, _ROWS_SQL)


def _encoded(words: pa.LargeStringArray, path: str) -> Ragged:
    """Ids of each word behind a blank."""
    return codec(path).encode_words(_joined(words).split(" ") if len(words) else [])


def count_words(asks: DataFrame, path: str, targets: int) -> DataFrame:
    """Each target sums its words over all blocks, splits each into pieces once and answers every block:
    counts and pieces in the order of the words asked, with the target's number as source."""
    def compute(batches):
        asked = [(t, s, *_unpack(p)) for b in batches for t, s, p in zip(*[x.to_pylist() for x in b.columns], strict=True)]
        if not asked:
            return
        coded = pa.chunked_array([_words_in(w) for _, _, w, _ in asked]).combine_chunks().dictionary_encode()
        number, counts = coded.indices.to_numpy(), np.concatenate([c for *_, c in asked])
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, number, counts)
        ids = _encoded(coded.dictionary, path)
        begin = 0
        for target, source, _, c in asked:
            at = number[begin : begin + len(c)]
            begin += len(c)
            flat, size = ids.take(at)
            yield _rows([(source, target, _pack((total[at], flat.astype(np.uint32), size.astype(np.int32))))])
        known = np.flatnonzero(total)
        flat, size = ids.take(known)
        yield _rows([(_STATS, 0, _pack((int(total.sum()), len(known)))), (_WORDS, 0, _pack((total[known], flat, size)))])

    return asks.repartition(targets, "target").mapInArrow(compute, _ROWS_SQL)


def _summed(rows: DataFrame, fn, size: int) -> np.ndarray:
    """``fn`` of every payload (an array of ``size`` numbers), added up cell by cell in Spark."""
    def compute(batches):
        acc = np.zeros(size)
        for b in batches:
            for p in b.column(0).to_pylist():
                acc += fn(_unpack(p))
        at = np.flatnonzero(acc)
        yield pa.record_batch({"cell": pa.array(at, pa.int64()), "v": pa.array(acc[at], pa.float64())})

    out = np.zeros(size)
    for r in rows.select("payload").mapInArrow(compute, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out


def count_transitions(words: DataFrame, path: str, texts: int) -> tuple[A.Pieces, A.Prior]:
    """The piece classes and the counted prior, from the table of distinct training words.

    What reaches the driver is one number a piece, then one a pair of input and class: bounded by the
    vocabulary, whatever the corpus.
    """
    n = len(codec(path).pieces)

    def piece_counts(payload):
        count, flat, size = payload
        return np.bincount(flat, np.repeat(count.astype(float), size), minlength=n)

    p = A.map_pieces(_summed(words, piece_counts, n), codec(path).blank)
    c, i = p.classes, p.inputs

    def steps(payload):
        """Steps inside words, words by first class, words by last input, end to end."""
        count, flat, size = payload
        inner, first, last = np.zeros((i, c)), np.zeros(c), np.zeros(i)
        if len(flat):
            count, flat = count.astype(float), flat.astype(np.int64)
            ends = np.cumsum(size) - 1
            goes_on = np.ones(len(flat), bool)
            goes_on[ends] = False
            at = np.flatnonzero(goes_on)
            np.add.at(inner, (p.input_of[flat[at]], p.class_of[flat[at + 1]]), np.repeat(count, size)[at])
            first = np.bincount(p.class_of[flat[ends - size + 1]], count, minlength=c)
            last = np.bincount(p.input_of[flat[ends]], count, minlength=i)
        return np.concatenate([inner.ravel(), first, last])

    total = _summed(words, steps, i * c + c + i)
    return p, A.counted_prior(p, total[i * c : i * c + c], total[: i * c].reshape(i, c), total[i * c + c :], float(texts))


def _streams(p: A.Pieces, ids: Ragged, words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BEGIN, pieces and END of each text end to end, the streams' sizes and each word's.

    ``words`` are the numbers of all texts' words in a row, ``n_words`` of them in each.
    """
    flat, size = ids.take(words)
    ends = np.cumsum(n_words)
    at = np.concatenate([[0], np.cumsum(size)])
    first, past = at[ends - n_words], at[ends]
    streams = past - first + 2
    out = np.full(int(streams.sum()), p.n, np.int64)
    begin = np.cumsum(streams) - streams
    out[begin] = p.n + 1
    out[np.arange(len(flat)) + np.repeat(1 + 2 * np.arange(len(n_words)), past - first)] = flat
    return out, streams, size


def least_steps(windows: int) -> int:
    """Steps of a trainer: each of its windows comes at least once."""
    return max(LEAST_STEPS, -(-windows // A.BATCH))


def dealt_texts(block: int, table: pa.Table, turn: int) -> list:
    """The training texts of a block for round ``turn``: each is dealt to one of the ``ROUNDS`` rounds."""
    texts = table["text"].filter(table["train"]).to_pylist()
    rounds = np.random.default_rng(block).permutation(len(texts)) % ROUNDS
    return [t for t, r in zip(texts, rounds.tolist(), strict=True) if r == turn]


def _texts_of(held: list[tuple[Block, int]], path: str) -> tuple[Ragged, np.ndarray, np.ndarray]:
    """Texts, given as blocks and places in them: (ids of their distinct words, numbers of all their words, how many each has)."""
    parts, wanted = [], []
    for _, group in groupby(held, key=lambda x: id(x[0])):
        group = list(group)
        block = group[0][0]
        numbers, n_words = Ragged(block.numbers, block.n_words).take(np.array([i for _, i in group]))
        used = np.zeros(len(block.words), bool)
        used[numbers] = True
        own = np.flatnonzero(used)
        wanted.append(block.words.take(pa.array(own)))
        place = np.empty(len(used), np.int64)
        place[own] = np.arange(len(own))
        parts.append((place[numbers], n_words))
    coded = pa.chunked_array(wanted, pa.large_string()).combine_chunks().dictionary_encode()
    at, begins = coded.indices.to_numpy(), np.cumsum([0, *map(len, wanted)])
    return _encoded(coded.dictionary, path), np.concatenate([at[b : b + len(w)][n] for b, w, (n, _) in zip(begins, wanted, parts, strict=False)]), np.concatenate([n for _, n in parts])


def fit_attention(blocks: DataFrame, path: str, p: A.Pieces, prior: A.Prior, tasks: int) -> dict[str, np.ndarray]:
    """Train on all training texts of ``blocks`` (source, payload), a part of each block in each round.

    A task cuts its texts into trainers of ``TRAINER_BYTES``; each makes steps on its own from the round's
    parameters.  The mean over all trainers, weighted by windows, starts the next round; a task adds up
    its own trainers, so it sends one table.
    """
    blocks = blocks.select("source", "payload").coalesce(tasks)
    w = A.initial(p)
    names, sizes = list(w), [v.size for v in w.values()]
    for turn in range(ROUNDS):
        start = w

        def trained(held, start=start, turn=turn):
            """Parameters after one trainer's steps, times its windows, and these."""
            symbols, size, _ = _streams(p, *_texts_of(held, path))
            x, *rest = A.training_windows(p, symbols, size)
            got = A.train(start, prior, x, *rest, steps=least_steps(len(x)), rate=0.01 / (1 + turn), seed=turn)
            return len(x) * np.concatenate([got[k].ravel() for k in names]).astype(np.float64), len(x)

        def compute(batches, turn=turn, trained=trained):
            total, windows, held, size = np.zeros(sum(sizes)), 0, [], 0
            for b in batches:
                for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    d = Block.unpack(payload)
                    for i in dealt_texts(block, pa.table({"text": np.arange(len(d.size)), "train": d.train}), turn):
                        held.append((d, i))
                        size += int(d.size[i])
                        if size >= TRAINER_BYTES:
                            flat, n = trained(held)
                            total, windows, held, size = total + flat, windows + n, [], 0
            if held:
                flat, n = trained(held)
                total, windows = total + flat, windows + n
            if windows:
                yield pa.record_batch({"cell": pa.array(np.arange(len(total)), pa.int64()), "v": pa.array(total), "n": pa.array(np.full(len(total), float(windows)))})

        mean = blocks.mapInArrow(compute, "cell bigint, v double, n double").groupBy("cell").agg((F.sum("v") / F.sum("n")).alias("v"))
        rows = mean.collect()
        if rows:
            flat = np.zeros(sum(sizes), np.float32)
            flat[[r["cell"] for r in rows]] = [r["v"] for r in rows]
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            w = {k: x.reshape(w[k].shape) for k, x in zip(names, parts, strict=True)}
    return w


class Scorer:
    """Scores of texts, given each word's total count and pieces."""

    def __init__(self, p: A.Pieces, w: dict[str, np.ndarray], prior: A.Prior, tokens: int, types: int, texts: int) -> None:
        self.p, self.w, self.prior, self.tokens, self.types, self.texts = p, w, prior, tokens, types, texts

    def score(self, word: np.ndarray, n_words: np.ndarray, counts: np.ndarray, ids: Ragged) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base, score) of texts given as numbers of words, end to end, ``n_words`` in each."""
        begin = np.concatenate([[0], np.cumsum(n_words)])
        parts = [self._score(word[begin[a] : begin[z]], n_words[a:z], counts, ids) for a, z in _groups(n_words.tolist(), 200_000)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _score(self, word: np.ndarray, n_words: np.ndarray, counts: np.ndarray, ids: Ragged):
        p = self.p
        symbols, size, pieces = _streams(p, ids, word, n_words)
        which, kind = A.score_streams(p, self.w, self.prior, symbols, size)
        # Tokens are words, then END; a token's symbols end where the next token begins.
        n_tokens = n_words + 1
        is_end = np.cumsum(n_tokens) - 1
        total = int(n_tokens.sum())
        c = np.full(total, self.texts, np.int64)
        inner = np.ones(total, bool)
        inner[is_end] = False
        c[inner] = counts[word] if len(word) else 0
        length = np.ones(total, np.int64)
        length[inner] = pieces
        # A token's first piece is predicted, as one that opens a word, by the symbol before it; each piece
        # of a word predicts that the word goes on and with what, its last piece that it ends.
        text_of = np.repeat(np.arange(len(n_words)), n_tokens)
        past = np.cumsum(length) + text_of + 1
        before = past - length - 1
        all_which, all_kind = np.concatenate([[0], np.cumsum(which)]), np.concatenate([[0], np.cumsum(kind)])
        word_log = all_which[past - 1] - all_which[before] + np.where(inner, all_kind[past] - all_kind[before + 1], 0.0)
        counted = SHARE * c / self.tokens if self.tokens else np.zeros(total)
        mixed = np.log10(counted + (1 - SHARE if self.tokens else 1.0) * np.exp(np.minimum(word_log, 0.0)) + 1e-300)
        starts = is_end - n_words
        base = np.add.reduceat(np.log10(c + 1.0), starts) - n_tokens * np.log10(self.tokens + self.types + 1.0)
        known = np.add.reduceat((c > 0).astype(np.int64), starts)
        return n_tokens, known, base, np.add.reduceat(mixed, starts)


def _groups(sizes: list[int], most: int):
    a, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > most:
            yield a, i
            a, held = i, 0
        held += s + 1
    if held:
        yield a, len(sizes)


def lm_scores(docs: DataFrame, train: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows teach (NULL: not); counts and the attention model learn from all of
    them.  Tokens are the words and one END; a NULL or empty text is END alone.  Scores
    are in log10.  Repeated rows count and come back as often as they stand there.
    """
    spark = docs.sparkSession
    targets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    prepared = reliable_checkpoint(prepare(d, "key", "text", F.col("train"), targets))
    answered = reliable_checkpoint(count_words(prepared.where("target >= 0"), path, targets))
    texts, taught = d.where("train").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    stats = [_unpack(r["payload"]) for r in answered.where(F.col("target") == _STATS).collect()]
    tokens, types = sum(s[0] for s in stats) + texts, sum(s[1] for s in stats) + (texts > 0)
    p, prior = count_transitions(answered.where(F.col("target") == _WORDS).coalesce(-(-types // WORDS_A_TASK) or 1), path, texts)
    blocks = prepared.where(F.col("target") == _DOCS)
    w = fit_attention(blocks, path, p, prior, -(-(taught or 0) // (ROUNDS * TRAINER_BYTES)) or 1)
    scorer = Scorer(p, w, prior, tokens, types, texts)

    def compute(batches):
        # A block comes first, then the answers to it in the order of its words.
        now, block, parts = None, None, []
        for b in batches:
            for target, source, payload in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if target != now:
                    if block is not None:
                        yield scored(block, parts)
                    now, block, parts = target, None, []
                if source == _DOCS:
                    block = Block.unpack(payload)
                else:
                    parts.append(_unpack(payload))
        if block is not None:
            yield scored(block, parts)

    def scored(block, parts):
        counts = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in parts]])
        ids = Ragged.join([Ragged(np.zeros(0, np.uint32), np.zeros(0)), *[Ragged(x[1], x[2]) for x in parts]])
        got = scorer.score(block.numbers, block.n_words, counts, ids)
        return pa.record_batch([block.key, *map(pa.array, got)], names=["key", "n_tokens", "n_known", "base_score", "score"])

    asking = blocks.select(F.col("source").alias("target"), F.col("target").alias("source"), "payload")
    met = asking.unionByName(answered.where("target >= 0")).repartition(targets, "target").sortWithinPartitions("target", "source")
    kind = dict(docs.dtypes)[key]
    out = met.mapInArrow(compute, f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
