"""Exact token ids of the public vocabulary files, with known words looked up.

A text is cut into pre-tokens; the ids of each distinct one are worked out once per worker and
kept as little-endian bytes, so that a text's ids are one join.  The merge loop for new ones runs in
tiktoken, whose merges go by the rank of the joined bytes - for these vocabularies the order of the
merge list.  Texts outside the characters for which the splitting and folding rules are simple
go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm.bpe_dp import NOT_PLAIN, PLAIN_SPLIT, SPLIT, printable_bytes

#: Ends a word in the merge loop; a text that holds it goes through the library.
_END = b"\x01"
#: Words of the end-marking vocabulary, for texts without the characters below.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: Anything for which normalisation, lower case or classes need more than a table of single characters.
_HARD = r"[^\t-\r -\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{12f}\x{131}-\x{2ff}]|<\|"


class _Kept(dict):
    """Ids of words as bytes; forgets when full."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.make(word)
        return ids


class Ids:
    """``encode`` gives the ids of each text of an Arrow array; nulls count as empty."""

    def __init__(self, path: str, most: int) -> None:
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab, merges, mark = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.type = np.dtype("<u2" if max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) < 2**16 else "<u4")
        byte_of = printable_bytes()
        if mark:
            raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(mark)) + (_END if t.endswith(mark) else b"")
        else:
            raw = lambda t: bytes(byte_of[c] for c in t)
        # Marking a word's last byte comes before every merge of the list.
        ranks = {bytes([b]): b for b in range(256)}
        ids = np.zeros(512 + len(merges), self.type)
        for c, b in byte_of.items():
            ids[b] = vocab[c]
            if mark and b != _END[0]:
                ranks[bytes([b]) + _END] = 256 + b
                ids[256 + b] = vocab[c + mark]
        for i, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(a) + raw(b), 512 + i)
            ids[512 + i] = vocab[a + b]
        self.lower = bool(mark)
        self.split = re.compile(_WORD if mark else PLAIN_SPLIT).findall
        self.hard = _HARD if mark else NOT_PLAIN.replace("\\x20", " ").replace("\\u02ff", "\\x{2ff}") + r"|<\|"
        loop = tiktoken.Encoding("merge", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        end = _END if mark else b""
        self.kept = _Kept(lambda word: ids[loop(word.encode() + end)].tobytes(), most)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, self.hard).to_pylist()
        split, get = self.split, self.kept.__getitem__
        out = []
        for text, slow in zip(texts.to_pylist(), hard, strict=True):
            if slow:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, self.type))
            else:
                out.append(np.frombuffer(b"".join(map(get, split(text.lower() if self.lower else text))), self.type))
        return out


@lru_cache(2)
def ids_of(path: str, most: int = 600_000) -> Ids:
    """The encoder for a vocabulary file, kept per worker; it remembers the ids of ``most`` words (about 200 bytes each)."""
    return Ids(path, most)
