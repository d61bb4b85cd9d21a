"""Byte-level BPE by backtracking, and decoding by an offset table.

A word's Aho-Corasick matches give the longest token at each place. The encoder takes it, shortens it to its longest
prefix token while it doesn't go with the token before (a table of compatible pairs), and steps back where no prefix
goes. The result is the one that merging by rank gives, in time linear in the word.

Defined cases: null counts as empty and gives no ids; texts of any length are encoded whole; the special token's string
in a text becomes its one id, as in the library; an empty table gives an empty result; other columns stay out of the way.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import ragged, small_batches

#: Code points (first, last) that are letters or numbers in a newer Unicode than that of the library, for
#: which they are like punctuation.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEW = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NEWER)
#: The pattern that splits text before merges, in the syntax of the regex module; ASCII needs no exceptions.
ENDINGS, REST = "'s|'t|'re|'ve|'m|'ll|'d", r"\s+(?!\S)|\s+"
ASCII_PATTERN = rf"{ENDINGS}| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|{REST}"
PATTERN = rf"(?V1){ENDINGS}| ?[\p{{L}}--[{NEW}]]+| ?[\p{{N}}--[{NEW}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{NEW}]]+|{REST}"
#: Words whose ids a worker keeps at most; at the bound it starts again.
KEPT_WORDS = 900_000
SPACE_THEN_SPACE = re.compile(r" \s").search


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kept(dict):
    """Bytes of ids by key; what isn't there yet is made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = raw(token)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key, new = (vocab[left], vocab[right]), vocab[left + right]
            self.rank.setdefault(key, (n, new))
            self.made_by.setdefault(new, (n, *key))
        by_bytes = {self.tokens[i]: i for i in vocab.values()}
        self.shorter = {i: next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1) for t, i in by_bytes.items()}
        self.length = [len(t) for t in self.tokens]
        self.search = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.search.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.search.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept = Kept(lambda word: np.array(self.encode_word(word.encode()), "<u4").tobytes())
        self.spaced = Kept(self._encode_spaced)
        self.ascii_split, self.any_split = regex.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        digits = [b"%d," % i for i in range(size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_at = np.concatenate([[0], np.cumsum([len(x) for x in digits])])

    def split(self, text: str) -> list[str]:
        return (self.ascii_split if text.isascii() else self.any_split)(text)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side: no merge across their border comes first."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Takes the later-made of the two border tokens apart, until both are bytes. Of equal merges the left one is made
        first. A merge across the border that comes before the one just undone shows that the two would not stay."""
        before = 1 << 60
        while True:
            across = self.rank.get((left, right))
            if across and across[0] < before:
                return False
            a, b = self.made_by.get(left), self.made_by.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        best = [0] * n
        for end, (back, i) in self.search.iter(word.decode("latin-1")):
            best[end - back] = i  # of one start, longer matches end later
        if n and self.length[best[0]] == n:
            return [best[0]]
        length, shorter, pairs, fits = self.length, self.shorter, self.pairs, self.fits
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, best[0] if n else -1, -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    ok = pairs.get((last, token))
                    if fits(last, token) if ok is None else ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = best[at] if at < n else -1
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> np.ndarray:
        for kept, most in ((self.kept, KEPT_WORDS // 2), (self.spaced, KEPT_WORDS)):
            if len(kept) > most:
                kept.clear()
        parts = []
        for piece in self.cut(text) if self.special else [text]:
            if piece in self.special:
                parts.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                parts.append(self._encode_plain(piece))
        return np.frombuffer(b"".join(parts), "<u4")

    def _encode_spaced(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return np.array(self.encode_word(b" " + word.encode()), "<u4").tobytes()
        return b"".join(map(self.kept.__getitem__, self.split(" " + word)))

    def _encode_plain(self, text: str) -> bytes:
        """A space before other than white space starts a new match of the pattern whatever stands before it, so texts
        with no other kind of space before white space are cut there, and what follows a space is looked up whole."""
        if text[-1] == " " or SPACE_THEN_SPACE(text):
            return b"".join(map(self.kept.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.kept.__getitem__, self.split(first)), *map(self.spaced.__getitem__, rest)])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        starts = self.at[ids]
        return self.blob[ragged(starts, self.at[ids + 1] - starts)].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        ids = np.asarray(ids, np.int64)
        starts = self.digits_at[ids]
        return self.digits[ragged(starts, self.digits_at[ids + 1] - starts)].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves of every row's whole text.

    vocabulary: a file that every executor can open; by default the installed one.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary or default_vocabulary())
        for part in parts:
            n, hashed, decoded, ids = [], [], [], []
            for text in part.column(1).to_pylist():
                got = bpe.encode(text or "")
                n.append(len(got))
                hashed.append(hashlib.sha256(bpe.decimal(got)).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_bytes(got).decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    ids.append(got.view(np.int32))
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, vocabulary: str | None = None, id_col: str = "id", ids_col: str = "token_ids") -> DataFrame:
    """id and text, from lists of ids; a null list gives an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary or default_vocabulary())
        for part in parts:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, with_ids=False).withColumnRenamed("id", "doc_id")
