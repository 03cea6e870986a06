"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that its encoding can end with.
An automaton reports all vocabulary entries that end at a position; the longest one whose
neighbour, the stored last token of the prefix before it, is compatible with it is stored.
Following the stored tokens back from the end gives the exact ids.

Two neighbouring tokens are compatible if merging their bytes never joins across the border.
Only the right edge of the left token and the left edge of the right token can take part in
such a join, so the test walks these two edges in the order in which merges replace them.

Defined results: a null text counts as empty (no ids); special strings in a text become their
ids, as in the library; repeated rows are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import document_columns, map_rows

#: How byte-level vocabularies cut text before merging (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of the characters below U+0300 that both engines class alike, where the
#: standard library's engine is faster.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = "[^\t-\r\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff]"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of pre-tokens, worked out on first sight; forgets when full."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.make(piece)
        return ids


class PrefixBPE:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = printable_bytes()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        # Per token: the rank at which it is made, and its two halves.  Single bytes have none.
        self.made: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.join: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            self.join.setdefault((left, right), rank)
            if out not in self.made:
                self.made[out], self.halves[out] = rank, (left, right)
        self.top = len(spec["model"]["merges"])
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self._stands(i):
                raw = self.bytes_of[i]
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT).findall
        self.plain_split = re.compile(PLAIN_SPLIT).findall
        self.not_plain = re.compile(NOT_PLAIN).search
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = _Known(self._piece, most)
        size = max(self.bytes_of) + 1
        self.raw = [self.bytes_of.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one border while ``token`` is made: (token, rank at which it goes)."""
        memo = self.left_edge if side == 0 else self.right_edge
        edge = memo.get(token)
        if edge is None:
            if token in self.halves:
                inner = self._edge(self.halves[token][side], side)
                edge = [*inner[:-1], (inner[-1][0], self.made[token]), (token, self.top)]
            else:
                edge = [(token, self.top)]
            memo[token] = edge
        return edge

    def _first_join(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair that merges across the border of ``a`` and ``b``, if any does."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            x, x_goes = left[i]
            y, y_goes = right[j]
            rank = self.join.get((x, y))
            # Among equal ranks the leftmost merge goes first: that is x's own, then this one, then y's own.
            if rank is not None and rank < x_goes and rank <= y_goes:
                return x, y
            if x_goes == self.top and y_goes == self.top:
                return None
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def _stands(self, token: int) -> bool:
        """Whether the bytes of ``token`` alone encode to it."""
        if token not in self.halves:
            return len(self.bytes_of[token]) == 1
        a, b = self.halves[token]
        return self._stands(a) and self._stands(b) and self._first_join(a, b) == (a, b)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        size = len(data) + 1
        last, start_of = [-1] * size, [0] * size
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(data):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= 2_000_000:
                        pairs.clear()
                    fits = pairs[key] = self._first_join(before, token) is None
                if not fits:
                    continue
            last[end] = token
            start_of[end] = start
        ids, at = [], size - 1
        while at:
            ids.append(last[at])
            at = start_of[at]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if self.special_split is not None and any(s in text for s in self.special):
            parts = self.special_split.split(text)
            return list(chain.from_iterable([self.special[p]] if p in self.special else self.encode(p) for p in parts if p))
        split = self.split if self.not_plain(text) else self.plain_split
        return list(chain.from_iterable(map(self.known.__getitem__, split(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary).encode
        ids = [encode(t) if t else [] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_rows(document_columns(docs), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = encoder(vocabulary).decode
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded in one pass, digests only."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(vocabulary)
        n, of_ids, of_text = [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text) if text else []
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(document_columns(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
