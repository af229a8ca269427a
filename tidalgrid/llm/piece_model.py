"""A sentencepiece model file as tables: character map and pieces, and its texts as ids with source spans.

Normalisation walks the compiled character map for the longest prefix at each place of the source and
notes, for each character it writes, where in the source that prefix began.  Pieces of the normalised
text are thereby spans of source bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .bpe import Ragged

SPACE = "▁"
#: Fixed values of the model format: kinds of pieces, and the field numbers used below.
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD, DENORMALIZER_FIELD = 1, 2, 3, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        start = at
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            value = data[at : at + size]
            at += size
        yield key >> 3, value, data[start:at]


def _message(data: bytes) -> dict[int, int | bytes]:
    return {k: v for k, v, _ in _fields(data)}


class CharacterMap:
    """The compiled character map: a double-array trie over bytes, and the strings its leaves name."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.root = self._offset(self.units[0])
        #: Bytes that begin some entry.
        self.begins = [self.units[self.root ^ c] & 0x800000FF == c if self.root ^ c < len(self.units) else False for c in range(256)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest entry that ``data`` has at ``at``."""
        if not self.begins[data[at]]:
            return None
        node, found, units = self.root, None, self.units
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])].decode()


class Normalized:
    """A normalised text.  Character i was written from source bytes ``begin[i]`` to ``begin[i + 1]``."""

    def __init__(self, text: str, begin: np.ndarray) -> None:
        self.text, self.begin = text, begin


def _utf8_sizes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


class PieceModel:
    """One model file: normalisation, ids with source spans, and the text of ids."""

    def __init__(self, path: str, data: bytes | None = None) -> None:
        import sentencepiece

        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        pieces, rest, spec, trainer = [], [], {}, {}
        for number, value, raw in _fields(data):
            if number == NORMALIZER_FIELD:
                spec = _message(value)
                continue
            rest.append(raw)
            if number == PIECE_FIELD:
                m = _message(value)
                pieces.append((m[1].decode(), m.get(3, NORMAL)))
            elif number == TRAINER_FIELD:
                trainer = _message(value)
            elif number == DENORMALIZER_FIELD and _message(value).get(2):
                raise ValueError("models that rewrite decoded text are not supported")
        if trainer.get(24, 0) or any(kind == OWN for _, kind in pieces):
            raise ValueError("models with white space as suffix or user-defined pieces are not supported")
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if not escape:
            raise ValueError("models that do not escape blanks are not supported")
        #: The same pieces behind a normaliser that changes nothing: it cuts text that is normalised already.
        plain = bytes([NORMALIZER_FIELD << 3 | 2, 6, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + plain)
        self.end_id = self.cutter.eos_id()
        unknown = trainer.get(44, " ⁇ ".encode())
        #: For each id, the bytes it decodes to, and the characters of normalised text it covers.
        decoded = {CONTROL: lambda p: b"", UNKNOWN: lambda p: unknown, BYTE: lambda p: bytes([int(p[3:5], 16)])}
        raw = [decoded.get(kind, lambda p: p.replace(SPACE, " ").encode())(p) for p, kind in pieces]
        self.pieces = Ragged(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw]))
        self.is_byte = np.array([kind == BYTE for _, kind in pieces])
        self.is_unknown = np.array([kind == UNKNOWN for _, kind in pieces])
        self.continues = np.array([kind == BYTE and 0x80 <= int(p[3:5], 16) < 0xC0 for p, kind in pieces])
        self.size = np.array([0 if kind == CONTROL else len(p) for p, kind in pieces], np.int64)

    def normalize(self, text: str) -> Normalized:
        if self.map is None and not self.squeeze:
            if not text:
                return Normalized("", np.zeros(1, np.int64))
            begin = np.concatenate([[0], np.cumsum(np.ones(len(text), np.int64) if text.isascii() else _utf8_sizes(text))])
            text = text.replace(" ", SPACE)
            return Normalized(SPACE + text, np.concatenate([[0], begin])) if self.prefix else Normalized(text, begin)
        return self._mapped(text)

    def _mapped(self, text: str) -> Normalized:
        """Longest entries of the character map from left to right; where none begins, one character as it is."""
        data = text.encode()
        out: list[str] = []
        begin: list[int] = []
        at, blank_before = 0, self.squeeze
        while at < len(data):
            entry = self.map.longest(data, at) if self.map else None
            if entry is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                entry = size, data[at : at + size].decode()
            size, new = entry
            if blank_before:
                new = new.lstrip(" ")
            if new:
                out.append(new)
                begin += [at] * len(new)
                blank_before = self.squeeze and new[-1] == " "
            at += size
        written, begin = "".join(out).replace(" ", SPACE), [*begin, len(data)]
        if self.prefix and written:
            written, begin = SPACE + written, [begin[0], *begin]
        if self.squeeze:
            written = written.rstrip(SPACE)
        return Normalized(written, np.array(begin[: len(written) + 1], np.int64))

    def _covered(self, text: str, ids: np.ndarray) -> np.ndarray:
        """How many characters of the normalised ``text`` each piece covers."""
        size = self.size[ids]
        if self.is_unknown[ids].any():  # covers what its neighbours leave
            data = text.encode()
            return np.array([len(data[p.begin : p.end].decode()) for p in self.cutter.encode(text, return_type="proto").pieces], np.int64)
        if self.is_byte[ids].any():  # the last byte of a character covers it
            size[self.is_byte[ids]] = 1
            size[np.flatnonzero(self.continues[ids]) - 1] = 0
        return size

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text: piece i covers source bytes begin[i] to end[i]."""
        normal = [self.normalize(t) for t in texts]
        for n, own in zip(normal, self.cutter.encode([n.text for n in normal]), strict=True):
            ids = np.array(own, np.int32)
            places = np.concatenate([[0], np.cumsum(self._covered(n.text, ids))])
            yield ids, n.begin[places[:-1]], n.begin[places[1:]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: each piece looked up, the blank that normalisation put in front taken off."""
        flat, size = self.pieces.take(ids)
        raw, front = flat.tobytes(), 0
        if (self.prefix or self.squeeze) and raw[:1] == b" ":
            # One blank of the first piece goes; where blanks are squeezed, one of each piece until something is left.
            for i, n in zip(ids.tolist(), size.tolist(), strict=True):
                if self.is_unknown[i] or self.is_byte[i] or raw[front : front + 1] != b" ":
                    break
                front += 1
                if n > 1 or not self.squeeze:
                    break
        raw = raw[front:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # ids that no text encodes to
            return self.cutter.decode(ids.tolist())


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model of this Python worker."""
    return PieceModel(path)
