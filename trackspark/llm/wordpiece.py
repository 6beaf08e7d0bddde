"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building pieces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocabulary
from .bpe import VOCABULARY_LIMIT
from .records import by_pieces, checked_broadcast, id_and_text, resident

DEAD = -1


class Counter:
    """Vocabulary trie whose failure links skip whole tokens.

    At a node the longest tokens that must be cut from the front before the read symbols can
    go on are known beforehand; ``popped[node]`` is their number and ``fail[node]`` the node of
    what remains, so each symbol is read once and only counts are added.
    """

    def __init__(self, entries):
        self.go: list[dict[int, int]] = [{}]
        token = [False]
        for symbols in entries:
            node = 0
            for s in symbols:
                nxt = self.go[node].get(s)
                if nxt is None:
                    nxt = self.go[node][s] = len(self.go)
                    self.go.append({})
                    token.append(False)
                node = nxt
            token[node] = True
        self.fail, self.popped = [DEAD] * len(self.go), [0] * len(self.go)
        level = [0]
        while level:
            below = []
            for node in level:
                for s, child in self.go[node].items():
                    below.append(child)
                    if token[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    back, cut = self.fail[node], self.popped[node]
                    while back != DEAD and s not in self.go[back]:
                        cut += self.popped[back]
                        back = self.fail[back]
                    if back != DEAD:
                        self.fail[child], self.popped[child] = self.go[back][s], cut
            level = below

    def count(self, symbols) -> int:
        """Number of greedy longest pieces; a word that no pieces cover is one unknown piece."""
        node, total = 0, 0
        for s in symbols:
            while s not in self.go[node]:
                total += self.popped[node]
                node = self.fail[node]
                if node == DEAD:
                    return 1
            node = self.go[node][s]
        while node:
            total += self.popped[node]
            node = self.fail[node]
            if node == DEAD:
                return 1
        return total


class NoteCounter:
    def __init__(self, voc: vocabulary.Vocabulary):
        self.voc = voc
        self.automaton = Counter([s for s in voc.symbols if s])
        self.counts = vocabulary.WordCache(lambda w: self.automaton.count(vocabulary.word_symbols(w)))

    def sizes(self, text: str) -> tuple[int, int]:
        words = tokens = 0
        for part, special in self.voc.segments(text):
            found = self.voc.words(part)
            words += len(found)
            tokens += sum(map(self.counts.__getitem__, found)) + (special is not None)
        return words, tokens


def counter(raw: bytes) -> NoteCounter:
    return resident("word pieces", raw, lambda r: NoteCounter(vocabulary.Vocabulary(r)))


def count_tokens(notes: DataFrame, vocabulary_path: str, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_tokens``: pre-tokens of every whole note and their greedy longest-match pieces.

    ``notes(id, text)`` are the workbench's notes.  Pieces are the vocabulary's tokens matched
    longest first from the left inside each pre-token (its last symbol carries the word end).
    Null and empty texts count 0; a special string counts one token and no word; repeated rows
    are answered one by one; other columns are not read.
    """
    with open(vocabulary_path, "rb") as f:
        raw = checked_broadcast(notes.sparkSession, f.read(), VOCABULARY_LIMIT, "the vocabulary")
    kind = notes.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [counter(raw.value).sizes(t or "") for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in sizes], pa.int64()), pa.array([b for _, b in sizes], pa.int64())], ["id", "n_words", "n_tokens"])

    return by_pieces(id_and_text(notes, id_col, text_col), work, f"id {kind}, n_words long, n_tokens long")
