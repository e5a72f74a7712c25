"""Byte-level BPE with a public vocabulary: a backtracking encoder in linear time, and its decoder.

A text is cut into pieces by the vocabulary's pattern. A piece is encoded from left to right: the longest token that matches at a
position is looked up in an Aho-Corasick automaton of all tokens; it may follow the token before it only if the pair is compatible,
which means that merging by rank would not have crossed their border. Compatibility is read off the merge table: the two tokens are
taken apart along the merges that made them, last merge first, and no merge of two parts that meet at the border may rank earlier
than the merges already undone. Where no token fits, the last one is taken back and its next shorter prefix tried; ends of positions
that turned out dead are remembered, so every position is given up at most once. The result equals merging by rank.

Decoding copies slices of one byte string that holds all tokens, found by an offset table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces whose ids one worker keeps; beyond it the store starts afresh. It bounds memory and has no effect on results.
KEPT_PIECES = 200_000
KEPT_PIECE_LENGTH = 40

# The pattern that cuts texts for this family of vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, as byte by character.

    Bytes that print in Latin-1 stand for themselves, the others follow from code point 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as bytes by id, and the pair each merged token was made of (None for single bytes and special tokens)."""

    tokens: tuple[bytes, ...]
    parts: tuple[tuple[int, int] | None, ...]

    @staticmethod
    def load(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary at {path}")
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        to_byte = byte_alphabet()
        ids = model["vocab"]
        tokens = [b""] * len(ids)
        for text, i in ids.items():
            if all(c in to_byte for c in text):
                tokens[i] = bytes(to_byte[c] for c in text)
        parts: list[tuple[int, int] | None] = [None] * len(ids)
        last = -1
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            i = ids[left + right]
            if i <= last:
                raise ValueError("ids of merged tokens must rise in the order of the merges")
            last = i
            parts[i] = (ids[left], ids[right])
        for i, token in enumerate(tokens):
            if len(token) > 1 and parts[i] is None:
                tokens[i] = b""  # nothing makes it: a special token, which plain text never gives
        return Vocabulary(tuple(tokens), tuple(parts))


class BacktrackingEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.parts = vocabulary.tokens, vocabulary.parts
        self._made = {pair: i for i, pair in enumerate(self.parts) if pair}
        self._longest = ahocorasick.Automaton()
        by_bytes = {t: i for i, t in enumerate(self.tokens) if t}
        for token, i in by_bytes.items():
            self._longest.add_word(token.decode("latin-1"), i)
        self._longest.make_automaton()
        self._shorter = [-1] * len(self.tokens)
        for token, i in by_bytes.items():
            self._shorter[i] = next((by_bytes[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in by_bytes), -1)
        self._lengths = [len(t) for t in self.tokens]
        self._ranks = [i if self.parts[i] else -1 for i in range(len(self.tokens))]
        self._whole = {t: i for t, i in by_bytes.items() if self.parts[i] is None or self._compatible(*self.parts[i], below=i)}
        self._pieces = regex.compile(PIECES)
        self._kept: dict[str, tuple[int, ...]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def _compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge crosses the border of two tokens before the merges that made them are complete.

        ``limit`` is the rank of the last merge undone: only a crossing merge of lower rank would have come first. The later-made
        token is taken apart first, on equal rank the right one (its merge, further right, was the later of the two).
        """
        limit = len(self.tokens) if below is None else below
        while True:
            crossing = self._made.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            rank_left, rank_right = self._ranks[left], self._ranks[right]
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                limit = rank_left
                left = self.parts[left][1]
            else:
                # a crossing merge of this very rank would have been done first, as it lies further left
                limit = rank_right + 1
                right = self.parts[right][0]

    def _fit(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= KEPT_PIECES:
                self._fits.clear()
            found = self._fits[key] = self._compatible(left, right)
        return found

    def _match(self, text: str, at: int) -> int:
        """The longest token at a position. Single bytes are tokens, so the leftmost longest match begins there."""
        return next(self._longest.iter_long(text, at))[1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self._whole.get(piece)
        if whole is not None:
            return (whole,)
        text, end = piece.decode("latin-1"), len(piece)
        alive = bytearray(b"\x01") * (end + 1)
        lengths, shorter = self._lengths, self._shorter
        found: list[int] = []
        at, token = 0, self._match(text, 0)
        while at < end:
            last = found[-1] if found else -1
            while token >= 0 and not (alive[at + lengths[token]] and (last < 0 or self._fit(last, token))):
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at += lengths[token]
                if at < end:
                    token = self._match(text, at)
            else:
                alive[at] = 0
                token = found.pop()
                at -= lengths[token]
                token = shorter[token]
        return tuple(found)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for an empty text and for None. Strings of special tokens are plain text."""
        ids: list[int] = []
        if not text:
            return ids
        kept = self._kept
        for piece in self._pieces.findall(text):
            got = kept.get(piece)
            if got is None:
                got = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= KEPT_PIECE_LENGTH:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = got
            ids.extend(got)
        return ids

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        return map(self.encode, texts)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self._bytes = b"".join(vocabulary.tokens)
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in vocabulary.tokens])])

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        at = self._offsets
        return b"".join(self._bytes[at[i] : at[i + 1]] for i in ids)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_encoders: dict[str, BacktrackingEncoder] = {}


def encoder_of(key: str, vocabulary: Vocabulary) -> BacktrackingEncoder:
    """This worker's encoder of a vocabulary, built once."""
    if key not in _encoders:
        _encoders[key] = BacktrackingEncoder(vocabulary)
    return _encoders[key]


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary as a broadcast (some 50,000 tokens, under 3 MB), so executors need no file."""
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def encode_column(df: DataFrame, text: str, ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the token ids of the column ``text`` as ``ids`` (array of int).

    Null and empty texts both give an empty list; texts of any length are encoded whole; repeated rows are encoded alike. The column
    ``ids`` must not exist yet.
    """
    if ids in df.columns:
        raise ValueError(f"there is a column {ids} already")
    words, key = shared_vocabulary(df.sparkSession, path), os.path.abspath(path)

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(key, words.value)
        for texts in batches:
            yield pd.Series([np.array(x, dtype=np.int32) for x in encoder.encode_all(texts)], index=texts.index, dtype=object)

    return df.withColumn(ids, encoded(F.col(f"`{text}`")))


def token_counts(df: DataFrame, text: str, n_tokens: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text``; 0 for null and empty texts."""
    if n_tokens in df.columns:
        raise ValueError(f"there is a column {n_tokens} already")
    words, key = shared_vocabulary(df.sparkSession, path), os.path.abspath(path)

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(key, words.value)
        for texts in batches:
            yield pd.Series([len(x) for x in encoder.encode_all(texts)], index=texts.index, dtype="int64")

    return df.withColumn(n_tokens, counted(F.col(f"`{text}`")))
