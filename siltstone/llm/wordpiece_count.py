"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

A trie holds the pieces; every node knows its failure node - where matching goes on once the
longest pieces of the current string have been taken off its front - and how many pieces that
takes.  A word is read once, character by character, and only counts are added up; no piece
string is ever built.  The counts equal greedy longest-match-first segmentation.

Defined results: null and empty texts have no words and no tokens; a word that the
vocabulary cannot spell is one unknown token, as is one of more than ``max_chars`` characters
where that is given (None: words of any length are spelled); repeated rows are counted one by one; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import document_columns, map_rows

#: Marks a word's start in the vocabulary.
START = "▁"


class CountAutomaton:
    """Children, failure node and popped-token count of every trie node."""

    def __init__(self, pieces: list[str], max_chars: int | None = None) -> None:
        self.max_chars = max_chars
        self.children: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for ch in piece:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                node = nxt
            whole[node] = True
        whole[0] = False
        self.fail = [-1] * len(whole)
        self.popped = [0] * len(whole)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for ch, node in self.children[parent].items():
                    deeper.append(node)
                    if whole[node]:
                        # The string is itself a piece: take it whole and begin again at the root.
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    back, count = self.fail[parent], self.popped[parent]
                    while back >= 0 and ch not in self.children[back]:
                        count += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[node], self.popped[node] = self.children[back][ch], count
            level = deeper

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 where it cannot be spelled."""
        if self.max_chars is not None and len(word) > self.max_chars:
            return 0
        node, total = 0, 0
        children, fail, popped = self.children, self.fail, self.popped
        for ch in START + word:
            nxt = children[node].get(ch)
            while nxt is None:
                if fail[node] < 0:
                    return 0
                total += popped[node]
                node = fail[node]
                nxt = children[node].get(ch)
            node = nxt
        while node:
            if fail[node] < 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total


class _Counts(dict):
    """Counts of words by their UTF-8 bytes, worked out on first sight; forgets when full, never keeps long words."""

    LONG = 400

    def __init__(self, automaton: CountAutomaton, most: int = 300_000) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= self.LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@lru_cache(2)
def _counts(vocabulary: str, max_chars: int | None) -> _Counts:
    return _Counts(CountAutomaton(load_pieces(vocabulary), max_chars))


def load_pieces(vocabulary: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, without control, unknown and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(docs: DataFrame, vocabulary: str, max_chars: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text.

    vocabulary: path of a sentencepiece model, present on every executor.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = _counts(vocabulary, max_chars).__getitem__
        words, tokens, unknown = [], [], []
        for text in batch.column(1).to_pylist():
            # bytes.split() parts at exactly the six ASCII separators.
            each = list(map(get, text.encode("utf-8", "surrogatepass").split())) if text else []
            missing = each.count(0)
            words.append(len(each))
            tokens.append(sum(each) + missing)
            unknown.append(missing)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_rows(document_columns(docs), run, "doc_id long, n_words long, n_tokens long, n_unknown long")
