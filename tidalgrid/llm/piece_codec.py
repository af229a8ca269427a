"""Sentencepiece encoding with source spans, and decoding, of whole texts in Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_model import piece_model

#: Bytes of text encoded at once.
BATCH_BYTES = 2 << 20


def map_encoded(
    df: DataFrame, path: str, text: str, row: Callable[[np.ndarray, np.ndarray, np.ndarray, str], tuple], fields: dict[str, pa.DataType], sql: str,
    keys: list[str],
) -> DataFrame:
    """``keys`` of each row and ``row(ids, begin, end, decoded)`` of its whole text, closed by the end id.

    Piece i covers source bytes begin[i] to end[i]; the end id covers none.  A character written as
    several byte ids belongs to the last of them.  No shuffle; memory is bounded by one batch of
    rows, cut at BATCH_BYTES, or its longest text.
    NULL text: as empty, which has the end id only.  Repeated rows each give a row, an empty table none.  Only ``keys`` and
    ``text`` are read, so other columns may have any names; ``fields`` must not repeat one of ``keys``.
    """

    def encode(batches):
        model = piece_model(path)
        last = np.array([model.end_id], np.int32)
        for b in batches:
            step = max(1, BATCH_BYTES * b.num_rows // max(1, b.nbytes))
            for i in range(0, b.num_rows, step):
                piece = b.slice(i, step)
                texts = [t or "" for t in piece.column(len(keys)).to_pylist()]
                out = []
                for t, (ids, begin, end) in zip(texts, model.encode(texts), strict=True):
                    size = np.array([len(t) if t.isascii() else len(t.encode())], np.int64)
                    ids = np.concatenate([ids, last])
                    out.append(row(ids, np.concatenate([begin, size]), np.concatenate([end, size]), model.decode(ids)))
                made = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(fields.values())]
                yield pa.record_batch([piece.column(j) for j in range(len(keys))] + made, names=[*keys, *fields])

    types = dict(df.select(*keys).dtypes)
    return df.select(*keys, F.col(text).alias("text_to_encode")).mapInArrow(encode, ", ".join([f"`{k}` {types[k]}" for k in keys] + [sql]))


def encode_pieces(df: DataFrame, path: str, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys`` (default: doc_id), ids, begin and end (byte offsets in the source) as arrays, and the decoded text."""
    integers, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    return map_encoded(
        df, path, text, lambda ids, begin, end, decoded: (ids, begin, end, decoded),
        {"ids": integers, "begin": longs, "end": longs, "decoded": pa.string()}, "ids array<int>, `begin` array<bigint>, `end` array<bigint>, decoded string", keys or ["doc_id"])
