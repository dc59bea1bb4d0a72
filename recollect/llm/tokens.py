"""Encoding whole texts with a public byte-level tokenizer, remembering the ids of frequent chunks.

The byte-level pre-tokenizer always starts a new piece at a space that stands between two characters other than white
space, whatever the context, so a text may be cut there and its chunks encoded apart. Texts without runs of white space
around a space are cut by str.split, all others by a regular expression. Special tokens hold no space.
"""

from __future__ import annotations

import array
import json
import re

import numpy as np

#: Chunks remembered by a worker (the first to come), and the longest such chunk in characters.
MEMO, LONGEST = 250_000, 48
#: How a byte-level tokenizer cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s | \s|^ | $")
_encoders: dict = {}


class Memo(dict):
    """chunk -> what compute gives for it; keeps the first MEMO chunks."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, chunk: str):
        value = self.compute(chunk)
        if len(chunk) <= LONGEST and len(self) < MEMO:
            self[chunk] = value
        return value


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest, in order, for U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str):
    """The tokenizer in a JSON file, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """ids of whole texts, as tokenizers' encode(text, add_special_tokens=False) with the byte-level BPE file in path.

    Chunks that are not remembered are encoded with the file's own vocabulary as ranks where its ids follow the order
    of its merges, else (and where they hold the text of an added token) by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, vocab = byte_of_char(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if i not in added.values()} | {i: t.encode() for t, i in added.items()}
        self.lengths = np.zeros(max(as_bytes) + 1, np.int64)
        for i, b in as_bytes.items():
            self.lengths[i] = len(b)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            ranks = {b: i for i, b in as_bytes.items() if i not in added.values()}
            self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.inner = Memo(lambda chunk: self._ids(" " + chunk))

    def _ids(self, text: str) -> bytes:
        if self.fast and not (self.special and self.special.search(text)):
            return array.array("I", self.fast(text)).tobytes()
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        first, *rest = _CUT.split(text) if _WIDE.search(text) else text.split(" ")
        return self._ids(first) + b"".join(map(self.inner.__getitem__, rest))

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last character of which each token holds a byte, by the table of token lengths in bytes."""
        ends = np.cumsum(self.lengths[np.frombuffer(self.ids(text), "<u4")])
        starts = np.r_[0, ends[:-1]][: len(ends)]
        if text.isascii() or not len(ends):
            return starts, ends - 1
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1]


def encoder(path: str) -> Encoder:
    """The worker's encoder for path, made once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
