"""Byte-level BPE ids straight from the ranks of a tokenizer file's merges.

The tokenizers library tracks offsets and alignment that a token file has no use for.  Where a file is
plain byte-level BPE whose ids follow its merges, tiktoken's merge loop over the same ranks gives the same
ids at a fraction of the time.  Texts that hold a special token's string, or characters whose class two
versions of Unicode may see differently, go to the tokenizers library itself, as do files of any other kind.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

from .bpe import Ragged, _byte_alphabet, codec

#: Fixed value: how byte-level BPE files with ``use_regex`` cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Any other character sends its text to the tokenizers library.
_PLAIN = "\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-›€"
_OTHER = re.compile(f"[^{_PLAIN}]")
#: So much white space in a row is left to the library too: tiktoken's pattern steps back over it one by one.
_WIDE = re.compile(r"\s{4096}")


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The rank of each piece as bytes, if ``path`` is plain byte-level BPE and ids follow the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
        and not model.get("unk_token") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
    if not plain:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab, first = model["vocab"], 256
    byte_of = _byte_alphabet()
    in_order = len(vocab) == first + len(pairs) and all(vocab.get(a + b) == first + k for k, (a, b) in enumerate(pairs))
    if not in_order or any(vocab.get(c, first) >= first for c in byte_of):
        return None
    return {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items()}


class RankEncoder:
    def __init__(self, path: str) -> None:
        self.codec = codec(path)
        ranks = merge_ranks(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def covers(self, text: str) -> bool:
        """Whether ranks give the ids of ``text``, which holds no special token."""
        return self.fast is not None and (text.isascii() and text.isprintable() or not _OTHER.search(text)) and (len(text) < 100_000 or not _WIDE.search(text))

    def ids(self, text: str) -> np.ndarray:
        if not self.covers(text) or any(s in text for s in self.codec.special):
            return self.codec.encode_text(text)
        return self.by_ranks(text)

    def by_ranks(self, text: str) -> np.ndarray:
        """Ids of a text that ranks cover and that holds no special token."""
        return np.asarray(array("I", self.fast.encode_ordinary(text)), np.uint32)  # a third of the time numpy takes for a list

    def encode(self, texts: list[str]) -> Ragged:
        """Ids of each text."""
        found = [self.ids(t) for t in texts]
        return Ragged(np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64))


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """The encoder of this Python worker."""
    return RankEncoder(path)
