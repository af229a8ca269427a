"""Sentencepiece encoding against the library, whatever the normaliser, with spans, and odd rows."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidalgrid.llm.piece_codec import encode_pieces
from tidalgrid.llm.piece_model import PieceModel, _fields, _message
from tidalgrid.llm.queries.op07_bpe_round_trip import tokenizer_path
from tidalgrid.llm.queries.op13_sentencepiece import op13_sentencepiece

PATH = tokenizer_path("piece_bpe_32k.model")
BITS = ["a", "é", "é", "́", " ", "  ", "▁", "\n", "\t", "\x00", "ﬁ", "①", "日本", "😀", "ｶﾞ", "the ", "ing", "</s>", "<unk>", "<0x41>", "　", "´", "​", "ẞ", "\r\n", "½"]


def _sized(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def variant(mapped, prefix, squeeze):
    """The given model behind another normaliser; the character map is the library's own for NFKC."""
    with open(PATH, "rb") as f:
        data = f.read()
    rest = b"".join(raw for k, _, raw in _fields(data) if k != 3)
    table = _message(_message(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())[3])[2]
    spec = (b"\x12" + _sized(len(table)) + table if mapped else b"") + bytes([0x18, prefix, 0x20, squeeze, 0x28, 1])
    return rest + b"\x1a" + _sized(len(spec)) + spec


@pytest.mark.parametrize("setting", [(m, p, q) for m in (0, 1) for p in (0, 1) for q in (0, 1)])
def test_ids_spans_and_text_are_the_librarys(setting):
    data = variant(*setting)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=data), PieceModel("", data)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from(BITS), max_size=14).map("".join) | st.text(st.characters(codec="utf-8"), max_size=20))
    def check(text):
        want = library.encode(text, return_type="proto").pieces
        ((ids, begin, end),) = model.encode([text])
        assert ids.tolist() == [p.id for p in want]
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [(p.begin, p.end) for p in want]
        assert model.decode(ids) == library.decode(ids.tolist())

    check()


def test_spans_cover_the_source():
    model = PieceModel(PATH)
    text = "Ünïcode 😀 and  two blanks\nand ﬁne"
    ((_, begin, end),) = model.encode([text])
    assert begin[0] == 0 and end[-1] == len(text.encode()) and (begin[1:] == end[:-1]).all()


def test_ids_no_text_has_decode_as_the_library_does():
    model, library = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = np.array([library.piece_to_id("<0xE2>"), library.piece_to_id("<0x82>"), library.piece_to_id("a")])
    assert model.decode(ids) == library.decode(ids.tolist())


def test_models_of_other_kinds_are_refused():
    with open(PATH, "rb") as f:
        data = f.read()
    with pytest.raises(ValueError):
        PieceModel("", data + b"\x0a" + bytes([2 + 3 + 2]) + b"\x0a\x03abc\x18\x04")


def test_odd_rows(spark):
    long = "wörd " * 40_000
    rows = [(1, "a b", 0), (1, "a b", 0), (2, None, 0), (None, "", 0), (3, long, 0), (4, "x" * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_to_encode int")
    got = sorted(((r.doc_id, r.ids, r.begin, r.end, r.decoded) for r in encode_pieces(docs, PATH).collect()), key=str)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, ids, begin, end, decoded in got:
        text = next(t or "" for k, t, _ in rows if k == i)
        assert ids == library.encode(text, add_eos=True) and decoded == text == library.decode(ids)
        assert end[-1] == begin[-1] == len(text.encode()) and sum(end) - sum(begin) == len(text.encode())
    assert len(got) == 6 and encode_pieces(docs.limit(0), PATH).collect() == []


def test_query_equals_the_library(spark, small_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = op13_sentencepiece(spark, small_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert r[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(docs[r.doc_id].encode()))
