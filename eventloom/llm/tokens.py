"""Token ids of a public word-level BPE file, from a cache of words.

The file's normaliser and pre-tokeniser never join text across blanks, so a text's ids
are its blank-separated words' ids in a row.  Words of plain letters, digits and marks
(ASCII and the accented Latin letters of two bytes) are cut by the file's own pattern and
encoded with its merges by ``tiktoken``; every other word, and each that has one of the
file's special tokens in it, goes through ``tokenizers``.  Both give the ids that
``tokenizers`` gives for the whole text at its defaults (the tests compare them), so a
special token's string in a text is that token.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Cached words; beyond, the cache starts anew.
CACHE = 300_000

_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-`{-~]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 or (0x80 <= b <= 0x9E and b != 0x97) else b for b in range(256))
#: Stands for the end of a word; no UTF-8 text has this byte.
_END = b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts given as UTF-8 bytes, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        special = [re.escape(t["content"].encode()) for t in file.get("added_tokens", [])]
        self.has_special = re.compile(b"|".join(special)).search if special else lambda word: None
        letters = _letters()
        ranks = {}
        for symbol, i in vocabulary.items():
            ends = symbol.endswith("</w>")
            ranks[bytes(letters[c] for c in (symbol[:-4] if ends else symbol)) + (_END if ends else b"")] = i
        self.bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        if _PLAIN.fullmatch(word) and not self.has_special(word):
            ids = [i for piece in _PIECES.findall(word.translate(_LOWER)) for i in self.bpe(piece + _END)]
        else:
            ids = self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHE:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = self._word(word)
                    found[i] = ids
        return b"".join(found)


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a process and file."""
    return WordTokenizer(path)
