"""BPE encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import array
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts, slices, texts_of
from .tokens import Memo, byte_of_char, load

_made: dict = {}


class Bpe:
    """Exact BPE for the vocabulary in a tokenizers JSON file with a splitting pattern, byte-level symbols and </w> endings.

    A piece of text is a string of symbols: its bytes, the last as a symbol of its own kind if the vocabulary marks
    word ends. An Aho-Corasick automaton over the tokens finds the longest token that starts at each place. The encoder
    takes the longest, checks it against the token before it in the pair table, falls back on the next shorter token
    that starts there, and steps back where none fits; every (place) is given up at most once, so it takes linear time.
    Two tokens can stand side by side in BPE's result just if the merges that made them would not have joined symbols
    across their border; compatible() decides that from the merges alone and its answers are kept.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        to_byte = byte_of_char()
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        def symbols(token: str) -> str:
            if self.suffix and token.endswith(self.suffix) and token != self.suffix:
                body = token[: -len(self.suffix)]
                return "".join(chr(to_byte[c]) for c in body[:-1]) + chr(256 + to_byte[body[-1]])
            return "".join(chr(to_byte[c]) for c in token)

        self.symbols = {i: symbols(t) for t, i in self.vocab.items() if i not in self.added.values()}
        by_symbols = {s: i for i, s in self.symbols.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # (left, right) -> (rank, merged)
        for r, (a, b) in enumerate(merges):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pairs[left, right] = (r, whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), r
        # tokens that BPE itself never makes can't be in its result
        self.tokens = {s: i for s, i in by_symbols.items() if len(s) == 1 or i in self.parts}
        automaton = ahocorasick.Automaton()
        for s, i in self.tokens.items():
            automaton.add_word(s, (len(s), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: dict[int, int] = {}
        for s, i in self.tokens.items():
            for n in range(len(s) - 1, 0, -1):
                if (p := self.tokens.get(s[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        # decoding: one string of all token texts, and where each starts
        size = max(self.strings) + 1
        texts = [self.strings.get(i, "") for i in range(size)]
        self.blob = "".join(texts)
        self.at = np.cumsum([0, *map(len, texts)])
        self.joiner = "" if spec.get("decoder") else " "
        self.byte_decoder = bool(spec.get("decoder")) and spec["decoder"]["type"] == "ByteLevel"
        self.to_byte = to_byte
        self._pieces_of(path, spec)

    def _pieces_of(self, path: str, spec: dict) -> None:
        """How text becomes pieces: the library's own normaliser and splitter, so that both know the same Unicode; text of
        ASCII alone, of which Unicode says nothing, by plain patterns."""
        self.tokenizer = load(path)
        parts = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = parts["normalizers"] if parts["type"] == "Sequence" else [parts]
        if unknown := {n["type"] for n in steps} - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizer {unknown} is not supported")
        pre = spec["pre_tokenizer"]
        splits = [(i, p) for i, p in enumerate(pre.get("pretokenizers", [pre])) if p["type"] == "Split"]
        if len(splits) != 1 or not splits[0][1]["invert"] or splits[0][1]["behavior"] != "Removed":
            raise ValueError("only a splitting pattern whose matches are the pieces is supported")
        at, split = splits[0]
        whole = self.tokenizer.pre_tokenizer
        self.split = (whole[at] if pre["type"] == "Sequence" else whole).pre_tokenize_str
        plain = split["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", r"\x09-\x0d\x20")
        self.lowers = any(n["type"] == "Lowercase" for n in steps)
        self.ascii = None if "\\p" in plain else re.compile(plain).findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: undo the last merges on either side of their border, latest first, and see that no merge across it would have come sooner."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        x, y, limit, ok = a, b, float("inf"), True
        while True:
            rank, _ = self.pairs.get((x, y), (float("inf"), -1))
            # across the border this pair would be joined before the merge undone last; equal ranks go to the left
            if rank < limit:
                ok = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                x, limit = self.parts[x][1], rx
            else:
                # a merge on the right of the border with the same rank comes after the pair across it
                y, limit = self.parts[y][0], ry + 0.5
        if len(self.fits) < 1 << 20:
            self.fits[a, b] = ok
        return ok

    def piece(self, symbols: str) -> list[int]:
        """Ids of one piece, given as symbols."""
        if (whole := self.tokens.get(symbols)) is not None:
            return [whole]
        n = len(symbols)
        longest = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(symbols):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        out: list[int] = []
        open_at = [True] * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + len(self.symbols[token])
                if open_at[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if (token := self.shorter.get(token, -1)) < 0:
                    open_at[at] = False
                    token = out.pop()
                    at -= len(self.symbols[token])
                    token_shorter = self.shorter.get(token, -1)
                    if token_shorter < 0 and not out and at == 0:
                        raise ValueError("a piece can't be encoded")
                    break
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text that is cut at spaces only, normalised; added tokens are pieces of their own."""
        if self.ascii and text.isascii() and not (self.special and self.special.search(text)):
            return self.ascii(text.lower() if self.lowers else text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
                continue
            if self.tokenizer.normalizer:
                part = self.tokenizer.normalizer.normalize_str(part)
            out += [piece for piece, _ in self.split(part)]
        return out

    def word(self, piece: str) -> list[int]:
        """Ids of one piece."""
        if (added := self.added.get(piece)) is not None:
            return [added]
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        return self.piece(raw[:-1] + chr(256 + ord(raw[-1])) if self.suffix else raw)

    def chunk(self, text: str) -> list[int]:
        """Ids of a text that is cut at spaces only."""
        return [i for p in self.pieces(text) for i in self.word(p)]

    def token_texts(self, ids) -> str:
        """The decoder: each id's slice of the blob by the offset table, joined as the file says."""
        at = self.at
        return self.joiner.join([self.blob[at[i] : at[i + 1]] for i in ids])

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        text = self.token_texts(ids)
        return bytes(self.to_byte[c] for c in text).decode("utf-8", "replace") if self.byte_decoder else text


def bpe(path: str) -> Bpe:
    """The worker's encoder for path, with memos of chunk -> (ids as bytes, ids as text, decoded text)."""
    if path not in _made:
        made = Bpe(path)

        def of_word(piece: str) -> tuple[bytes, str, str]:
            ids = made.word(piece)
            return array.array("I", ids).tobytes(), " ".join(map(str, ids)), made.token_texts(ids)

        def of_chunk(chunk: str) -> tuple[bytes, str, str]:
            found = [words[p] for p in made.pieces(chunk)]
            if len(found) == 1:
                return found[0]
            return b"".join([x[0] for x in found]), " ".join([x[1] for x in found]), made.joiner.join([x[2] for x in found])

        words, made.memo = Memo(of_word), Memo(of_chunk)
        _made[path] = made
    return _made[path]


def encode_documents(docs: DataFrame, tokenizer: str, ids: bool = True, decoded: bool = True, digests: bool = False, column: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, then ids (array<int>), decoded (string), or the
    SHA-256 digests ids_sha256 (decimal ids joined by one space) and decoded_sha256, as asked for.

    Null and empty texts have no tokens. Very long texts are taken whole; they are cut at spaces, over which no token
    and no normalisation reaches. Repeated rows are encoded each; an empty table gives no rows; other columns are
    ignored. There is no shuffle.
    """
    fields = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long")] + [("ids", pa.list_(pa.int32()), "array<int>")] * ids + [("decoded", pa.string(), "string")] * decoded + [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] * digests
    schema = pa.schema([(n, t) for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        get = coder.memo.__getitem__
        for batch in slices(batches):
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, column), strict=True):
                found = [x for x in map(get, text.split(" ")) if x[0]]
                raw = b"".join([x[0] for x in found])
                row: list = [doc, len(raw) // 4]
                if ids:
                    row.append(np.frombuffer(raw, "<u4").astype(np.int32))
                if decoded or digests:
                    back = coder.joiner.join([x[2] for x in found])
                    if coder.byte_decoder:
                        back = bytes(map(coder.to_byte.__getitem__, back)).decode("utf-8", "replace")
                if decoded:
                    row.append(back)
                if digests:
                    row += [hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return long_texts(docs).select("doc_id", column).mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in fields))


def decode_ids(df: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """Add `decoded` to a table with an array column of ids; a null array gives null, an empty one the empty string."""

    @F.pandas_udf("string")
    def decoded(ids):
        coder = bpe(tokenizer)
        return ids.map(lambda x: None if x is None else coder.decode(x))

    return df.withColumn("decoded", decoded(F.col(column)))
