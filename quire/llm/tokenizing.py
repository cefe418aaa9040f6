"""Encoding texts with a public tokenizer, with a memo of pieces already encoded.

Some tokenizers split at white space and encode every piece alone, so the ids of
a text are those of its pieces, one after another. ``parts_at_spaces`` tells
them by their files' settings; all others get whole texts. The memo keeps the
ids of pieces between ASCII white space; those of a word with punctuation after
it are put together from both. Whatever is not plainly letters of Latin-1, with
or without such punctuation, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers

#: Bytes that each of a memo's two generations may hold, keys, values and tables together.
MEMO_BYTES = 40 << 20
#: What an entry takes beside the bytes of its key and value: two objects' heads and a slot.
ENTRY = 130
TAIL = ".,;:!?"
#: How the file of a tokenizer that drops white space describes its parts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def parts_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer's pieces between white space are encoded apart, as lower-case words with an end mark."""
    steps = [s["type"] for s in (settings.get("normalizer") or {}).get("normalizers", [])]
    cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = cuts[0] if cuts else {}
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and split.get("pattern") == {"Regex": SPLIT}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and not cuts[1].get("add_prefix_space")
        and not cuts[1].get("use_regex")
        and settings["model"]["type"] == "BPE"
        and settings["model"].get("end_of_word_suffix") == "</w>"
    )


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = [b for b in range(256) if b not in kept]
    return {b: b if b in kept else 256 + moved.index(b) for b in range(256)}


class Memo(dict):
    """Values that ``make`` gives for keys, in two generations of bounded bytes.

    A full generation displaces the one before it; an entry found in the older
    one moves to the younger, so what is in use stays.
    """

    def __init__(self, make: Callable, most: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.size, self.older = make, most, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.size += len(key) + len(value) + ENTRY
        if self.size > self.most:
            self.older = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        return value


class MemoTokenizer:
    """Ids of texts as bytes: one little-endian number of ``dtype`` for each."""

    def __init__(self, path: str, dtype: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.apart = parts_at_spaces(settings)
        del settings
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.letters = byte_letters()
        self.pieces = Memo(self._piece)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _library(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        word = text.rstrip(TAIL)
        if not word.isalpha() or max(word) > "\xff":
            return self._library(text)
        if len(word) < len(text) or not word.islower():
            tail = text[len(word) :]
            ids = self.pieces[word.lower().encode()]
            return ids + self.pieces[tail.encode()] if tail else ids
        letters = piece.decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(letters)])

    def encode(self, text: bytes) -> bytes:
        """The ids of a text given in UTF-8."""
        if self.apart:
            return b"".join(map(self.pieces.__getitem__, text.split()))
        return self._library(text.decode())


@lru_cache(maxsize=1)
def memo_tokenizer(path: str, dtype: str, plain_specials: bool = False) -> MemoTokenizer:
    """One for each worker process; later tasks find its memo filled."""
    return MemoTokenizer(path, dtype, plain_specials)


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """The narrowest type that holds all ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
