"""Ids of texts as the tokenizers library gives them, with a cache of words where that is the same."""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

from reqsieve.llm.common import worker_memo

TOKENIZER = "word_bpe_49k.json"
# Entries of the word cache of a worker.
CACHE_WORDS = 600_000

# The normaliser and pre-tokeniser whose ids of a text are those of its words.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_width(path: str, *ids: int) -> str:
    """The numpy type that holds every id of the tokenizer and the given ones."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), *(i + 1 for i in ids), 1) <= 1 << 16 else "<u4"


class WordCache(dict):
    """Ids of words between white space, for texts of Latin letters.

    Up to U+024F composition changes nothing and lower-casing goes letter by letter, so the
    library's ids of a text are those of its words, put together. Each new word is cut into
    the library's pieces, and the library's model encodes each piece. A piece is a word of one
    piece, so both are kept together. Other texts, and those that may hold a special token, go
    to the library whole.

    This holds for tokenizers of :data:`RULES`; :func:`encoder` uses no cache for others.
    """

    def __init__(self, tokenizer, dtype, limit: int = CACHE_WORDS):
        super().__init__()
        # Some capitals of this range have their small letter beyond it.
        low = sorted({c for i in range(0x250) if i != 0x130 for c in chr(i).lower()})
        letters, numbers = ("".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k) for k in "LN")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
        self.other = re.compile("[^\\x00-\\x1b\\x20-\\u012f\\u0131-\\u024f]").search
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        # The byte-level alphabet: printable Latin-1 stands for itself, the rest follows U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.bytes = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def piece(self, text: str) -> bytes:
        plain = text.isascii() and text.isprintable()
        coded = text if plain else "".join(self.bytes[b] for b in text.encode())
        return self.packed([t.id for t in self.model.tokenize(coded)])

    def __missing__(self, word: str) -> bytes:
        parts = self.pieces(word)
        if len(parts) == 1:
            found = self.piece(parts[0])
        else:
            found = b"".join([self[p] for p in parts])
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if "<|" in text or self.other(text):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


class Whole:
    """Every text by the library's own encode."""

    def __init__(self, tokenizer, dtype):
        self.tokenizer, self.dtype = tokenizer, dtype

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def follows_rules(tokenizer) -> bool:
    """Whether words are encoded each for itself, as :class:`WordCache` does it."""
    told = json.loads(tokenizer.to_str())
    return (
        all(told[k] == v for k, v in RULES.items())
        and told["model"]["type"] == "BPE"
        and not told["model"].get("dropout")
        and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in told["added_tokens"])
    )


def encoder(path: str, dtype: str):
    """An object whose ``ids(text)`` are the library's, little-endian, and its ``tokenizer``.

    Without truncation and padding, whatever the file says. A worker runs many tasks; the
    tokenizer and its cache stay in it for the next one.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept = worker_memo()
    key = ("encoder", path, dtype)
    if key not in kept:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        kept[key] = (WordCache if follows_rules(tokenizer) else Whole)(tokenizer, dtype)
    return kept[key]
