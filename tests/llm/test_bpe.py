"""The distinct-word table, token files and wavelet matrix against the tokenizer itself and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidalgrid.llm import token_files
from tidalgrid.llm.bpe import BlockWords, codec
from tidalgrid.llm.merge_ranks import _OTHER, merge_ranks, rank_encoder
from tidalgrid.llm.queries.op04_token_files import END_ID, op4_token_files
from tidalgrid.llm.queries.op07_bpe_round_trip import bpe_digests, op7_bpe_round_trip, tokenizer_path
from tidalgrid.llm.token_files import read_token_files, write_token_files
from tidalgrid.llm.wavelet import _STRETCH, WaveletMatrix, _halves

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "tab\tand   nbsp", "<|endoftext|>", "one <|endoftext|> two", "a<|endoftext|>b c",
    "é ñ ß", "日本 語", "it's we'll they 've", "12 3.5 $%", "\x00 nul \x1c sep \x85 x", "😀 👍🏽 zz", " line 　wide", "long" * 3000 + " tail", "the the the", "the the the",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts_and_whole_table(spark, small_dir, tokenizer):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, "", "x"), (None, "null id", "y")], "doc_id long, text string, __words string").repartition(3)
    got = sorted((tuple(r) for r in bpe_digests(df, PATH).collect()), key=str)
    want = sorted(((i, *expected(tokenizer, t)) for i, t in [*enumerate(ODD), (0, ""), (None, "null id")]), key=str)
    assert got == want
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in op7_bpe_round_trip(spark, small_dir).collect():
        assert tuple(r)[1:] == expected(tokenizer, docs[r.doc_id])


def test_pieces_decode_like_the_tokenizer(tokenizer):
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, tokenizer.get_vocab_size(), rng.integers(0, 30)).astype("<u4")
        assert codec(PATH).decode(ids, np.array([len(ids)])) == [tokenizer.decode(ids.tolist(), skip_special_tokens=False)]


def test_token_files(spark, small_dir, tmp_path, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect())
    check_files(op4_token_files(spark, small_dir), docs, tokenizer)
    odd = [(i // 2, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_files(op4_token_files(spark, str(tmp_path)), sorted(((i, t or "") for i, t in odd)), tokenizer)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op4_token_files(spark, f"{tmp_path}/none").collect() == []


def test_hot_keys_and_small_files(spark, tmp_path, tokenizer, monkeypatch):
    """Half of the rows without key, some equal, in many ranges and files of a few ids."""
    monkeypatch.setattr(token_files, "_BATCH", 200)
    rows = [(None if i % 2 else i, f"text {i % 7} é.") for i in range(300)] + [(5, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, key int").repartition(4)
    write_token_files(df, "doc_id", "text", PATH, f"{tmp_path}/f", END_ID, shards=6, ids_a_file=50)
    files = spark.read.parquet(f"{tmp_path}/f")
    assert files.count() > 12 and files.agg({"n_ids": "max"}).first()[0] >= 50
    got = [tuple(r) for r in read_token_files(spark, f"{tmp_path}/f", lambda ids: (ids.tolist(),), {"ids": pa.list_(pa.int64())}, "ids array<bigint>").collect()]
    want = sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID]) for i, t in rows), key=str)
    assert sorted(((k, ids) for k, _, ids in got), key=str) == want
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.concatenate([[0], np.cumsum([len(r[2]) for r in by_start])[:-1]]).tolist()
    keys = [r[0] for r in by_start]
    assert keys[:150] == [None] * 150 and keys[150:] == sorted(keys[150:])
    with pytest.raises(Exception, match="more than 12 bits"):
        write_token_files(df, "doc_id", "text", PATH, f"{tmp_path}/g", END_ID, bits=12)


@given(st.text(st.sampled_from([chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250), 0x2014, 0x2019, 0x2026, 0x2030, 0x20AC]]) | st.characters(codec="utf-8"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_ranks_give_the_tokenizers_ids(text):
    assert rank_encoder(PATH).fast is not None
    assert rank_encoder(PATH).ids(text).tolist() == codec(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def test_ranks_of_every_plain_character_and_of_the_given_texts(spark, small_dir):
    plain = [chr(c) for c in range(0x2100) if not _OTHER.match(chr(c))]
    texts = [a + c + b for c in plain for a, b in (("", ""), ("a ", " b"), ("1", "x"), ("\n", "."), (" ", "  "))] + ODD
    texts += [r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    flat, size = rank_encoder(PATH).encode([t or "" for t in texts])
    want = [e.ids for e in codec(PATH).tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert size.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_other_files_have_no_ranks():
    assert merge_ranks(tokenizer_path("word_bpe_49k.json")) is None and rank_encoder(tokenizer_path("word_bpe_49k.json")).fast is None


def check_files(df, docs, tokenizer):
    want, start = [], 0
    for i, t in docs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).integers(0, 9, n).astype(np.uint32)
    w, extra = WaveletMatrix.from_bytes(WaveletMatrix.build(x).to_bytes(c=np.arange(3)))
    assert extra["c"].tolist() == [0, 1, 2] and (w.to_array() == x).all()
    assert [w.access(i) for i in range(n)] == x.tolist()
    for v in range(-1, 20):
        assert w.rank(v) == (x == v).sum() and w.rank(v, n // 2) == (x[: n // 2] == v).sum()
        assert w.locate(v) == np.flatnonzero(x == v).tolist()


@pytest.mark.parametrize("bits", [1, 7, 8, 9, 16, 17, 20])
def test_wavelet_matrix_beyond_one_stretch(bits):
    """Planes of every width against a naive partition, in which narrow ids keep only the bits still to come."""
    x = np.random.default_rng(bits).integers(0, 1 << bits, 2 * _STRETCH + 77).astype(np.uint32)
    kept, w, a = x.copy(), WaveletMatrix.build(x, bits), x
    for k in range(bits):
        ones = (a >> (bits - 1 - k) & 1).astype(bool)
        assert (np.unpackbits(w.planes[k], count=len(x), bitorder="little") == ones).all() and w.zeros[k] == (~ones).sum()
        a = np.concatenate([a[~ones], a[ones]])
    back = WaveletMatrix.from_bytes(w.to_bytes())[0].to_array()
    assert back.dtype == np.uint32 and (back == x).all() and (x == kept).all()


def test_halves_of_a_partition_stay_in_order_and_in_bounded_stretches():
    ones = np.random.default_rng(0).random(3 * _STRETCH + 5) < 0.3
    out = np.empty(len(ones), np.int64)
    for part, at, to in _halves(ones, int((~ones).sum())):
        assert part.stop - part.start <= _STRETCH
        out[to] = part.start + at
    assert (out == np.argsort(ones, kind="stable")).all()


def test_words_of_plain_characters_go_by_ranks(tokenizer, monkeypatch):
    """No plain word needs the tokenizers library; others go there, and all keep their places and ids."""
    own, odd = codec(PATH), ["", "日本", "naïve.", "x\n\ny", "\x1c", "<|endoftext|>", "a b", "end\n", "　wide", "word,", "don't.", "x\x00y"]
    for words in ([f"w{i}x{'.,'[i % 2]}" for i in range(3000)], [w for i in range(1500) for w in (f"p{i}", odd[i % len(odd)])], odd, []):
        ids = own.encode_words(words)
        assert [x.tolist() for x in np.split(ids.flat, np.cumsum(ids.size)[:-1])][: len(words)] == [tokenizer.encode(" " + w, add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(own, "tokenizer", None)
    assert len(own.encode_words([f"w{i}," for i in range(3000)])) == 3000


def test_blocks_with_and_without_answers(tokenizer):
    """Texts of a block by the words' numbers, whichever of its words the targets have answered."""
    texts = [*ODD, "one two three two one", "three  two", "one", "\nsix seven", "seven \x85 one", "two words\t", "end\n", "x" + "\n" * 1_500_000 + "y z"]
    for answered in (0, 1, 2):
        words = BlockWords(pa.chunked_array([texts[:5], texts[5:]], pa.string()))
        number = np.full(len(words.words), -1, np.int64)
        which = words.asked[::answered] if answered else words.asked[:0]
        number[which] = np.arange(len(which))
        table, numbers, begin = words.encoded(codec(PATH), number, [codec(PATH).encode_words(words.joined(which).split(" ")) if len(which) else codec(PATH).encode_words([])])
        got = [table.take(numbers[a:z]).flat.tolist() for a, z in zip(begin, begin[1:], strict=False)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    asked = words.asked_of(7)
    assert sorted(np.concatenate(asked).tolist()) == words.asked.tolist() and len(words.asked) == len(set(words.joined(words.asked).split(" ")))
    empty = BlockWords(pa.chunked_array([[]], pa.string()))
    assert [len(x) for x in empty.asked_of(3)] == [0, 0, 0] and len(empty.encoded(codec(PATH), np.zeros(0, np.int64), [codec(PATH).encode_words([])])[1]) == 0
