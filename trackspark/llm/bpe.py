"""Exact BPE encoding by backtracking over longest matches, and decoding through an offset table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocabulary
from .records import by_pieces, checked_broadcast, id_and_text, resident

VOCABULARY_LIMIT = 64 << 20


class Matcher:
    """Aho-Corasick automaton over reversed tokens: one pass gives the longest token starting at each symbol."""

    def __init__(self, entries: list[tuple[tuple[int, ...], int]]):
        self.go: list[dict[int, int]] = [{}]
        best: list[int | None] = [None]
        for symbols, token in entries:
            node = 0
            for s in reversed(symbols):
                nxt = self.go[node].get(s)
                if nxt is None:
                    nxt = self.go[node][s] = len(self.go)
                    self.go.append({})
                    best.append(None)
                node = nxt
            best[node] = token
        self.fail = [0] * len(self.go)
        level = list(self.go[0].values())
        while level:
            below = []
            for node in level:
                if best[node] is None:
                    best[node] = best[self.fail[node]]
                for s, child in self.go[node].items():
                    back = self.fail[node]
                    while back and s not in self.go[back]:
                        back = self.fail[back]
                    self.fail[child] = self.go[back].get(s, 0)
                    below.append(child)
            level = below
        self.best = best

    def longest(self, symbols: list[int]) -> list[int | None]:
        out: list[int | None] = [None] * len(symbols)
        node, go, fail, best = 0, self.go, self.fail, self.best
        for i in range(len(symbols) - 1, -1, -1):
            s = symbols[i]
            while node and s not in go[node]:
                node = fail[node]
            node = go[node].get(s, 0)
            out[i] = best[node]
        return out


class Encoder:
    """Exact merges of a word in time linear in its length.

    Greedy longest tokens are accepted while each neighbour pair is compatible, that is while
    no merge across their border would have come before the merges inside them; otherwise the
    last token gives way to its longest proper prefix token.  Positions once left are dead.
    """

    def __init__(self, voc: vocabulary.Vocabulary):
        self.voc = voc
        self.compatible: dict[tuple[int, int], bool] = {}
        alive = [bool(s) for s in voc.symbols]
        for t, (l, r) in enumerate(voc.parts):
            if l != t:
                alive[t] = alive[l] and alive[r] and self._unmerged(l, r, t)
        entries = [(s, t) for t, s in enumerate(voc.symbols) if alive[t]]
        self.matcher = Matcher(entries)
        known = dict(entries)
        self.size = [len(s) for s in voc.symbols]
        self.shorter: list[int | None] = [None] * len(voc.symbols)
        for s, t in entries:
            self.shorter[t] = next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), None)
        self.pieces = vocabulary.WordCache(self._packed)
        self.offsets, self.blob = _table(voc.shown)

    def _unmerged(self, left: int, right: int, before: int) -> bool:
        """True if no merge older than ``before`` joins the end of ``left`` to the start of ``right``.

        The two tokens are taken apart along their border, youngest merge first; a join that
        is older than the part just undone would have happened instead of it.
        """
        parts, merged = self.voc.parts, self.voc.merged
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < before:
                return False
            can_left, can_right = parts[left][0] != left, parts[right][0] != right
            if can_left and (left > right or not can_right):
                before, left = left, parts[left][1]
            elif can_right:
                before, right = right + 1, parts[right][0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self.compatible.get(key)
        if ok is None:
            if len(self.compatible) >= 100_000:
                self.compatible.clear()
            ok = self.compatible[key] = self._unmerged(left, right, 1 << 60)
        return ok

    def encode_word(self, word: str) -> list[int]:
        symbols = vocabulary.word_symbols(word)
        longest = self.matcher.longest(symbols)
        open_at = bytearray(b"\x01") * (len(symbols) + 1)
        out: list[int] = []
        pos, token, n = 0, longest[0], len(symbols)
        while pos < n:
            last = out[-1] if out else None
            while token is not None and not (open_at[pos + self.size[token]] and (last is None or self.fits(last, token))):
                token = self.shorter[token]
            if token is None:
                if last is None:
                    raise ValueError(f"no encoding of {word!r}")
                open_at[pos] = 0
                out.pop()
                pos -= self.size[last]
                token = self.shorter[last]
            else:
                out.append(token)
                pos += self.size[token]
                token = longest[pos] if pos < n else None
        return out

    def _packed(self, word: str) -> bytes:
        return np.array(self.encode_word(word), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        packed = []
        for part, special in self.voc.segments(text):
            packed.extend(map(self.pieces.__getitem__, self.voc.words(part)))
            if special is not None:
                packed.append(special.to_bytes(4, "little"))
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by one space: the slices of one table that the ids' offsets name."""
        return _gather(ids, self.offsets, self.blob)


def _table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() + b" " for t in texts]
    return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def _gather(ids: np.ndarray, offsets: np.ndarray, blob: np.ndarray, step: int = 1 << 17) -> bytes:
    out = []
    for at in range(0, len(ids), step):
        some = ids[at: at + step]
        start = offsets[some]
        size = offsets[some + 1] - start
        ends = np.cumsum(size)
        out.append(blob[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes())
    return b"".join(out)[:-1]


def encoder(raw: bytes) -> Encoder:
    return resident("bpe", raw, lambda r: Encoder(vocabulary.Vocabulary(r)))


def encode_notes(notes: DataFrame, vocabulary_path: str, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole note and the text they decode to.

    ``notes(id, text)`` are the workbench's notes; ``vocabulary_path`` names a tokenizers file
    with word ends, read on the driver and broadcast (64 MB at most).  Returns ``id``,
    ``token_ids array<int>``, ``decoded string`` (token texts joined by one space, as a file
    without decoder gives them).  Null and empty texts have no tokens and decode to "".
    Special strings inside a text become their ids.  Repeated rows are answered one by one;
    other columns are not read.  One row needs its own text and ids in memory, no more.
    """
    with open(vocabulary_path, "rb") as f:
        raw = checked_broadcast(notes.sparkSession, f.read(), VOCABULARY_LIMIT, "the vocabulary")
    kind = notes.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(raw.value)
        ids, decoded = [], []
        for text in part.column(1).to_pylist():
            tokens = enc.encode(text or "")
            ids.append(tokens)
            decoded.append(enc.decode(tokens).decode())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "token_ids", "decoded"])

    return by_pieces(id_and_text(notes, id_col, text_col), work, f"id {kind}, token_ids array<int>, decoded string")
