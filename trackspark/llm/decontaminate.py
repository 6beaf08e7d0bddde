"""Benchmark decontamination: notes streamed through a generalised suffix automaton of test items."""

from __future__ import annotations

import pickle
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import by_pieces, checked_broadcast, resident, staged

# Lower-cased ASCII letters, digits and everything beyond ASCII make words; on UTF-8 bytes these are:
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PART_BYTES = 1 << 20    # item text behind one automaton
CELLS = 32              # hash cells of item text per part
CHUNK_BYTES = 1 << 17   # a longer item is cut into chunks that overlap by a window less one word


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several word sequences with longest-match streaming.

    A state stands for substrings of lengths ``size[link]+1 .. size``; links lead to shorter
    suffixes, so the window-long suffix of a match and the whole short items that end at it
    are found by precomputed jumps.
    """

    def __init__(self, items: list[tuple[str, bool, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(item, whole, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, whole, words in items if words]
        for _, _, seq in coded:
            at = 0
            for w in seq:
                at = self._extend(at, w)
        n = len(self.size)
        order = sorted(range(1, n), key=self.size.__getitem__)
        self.cut = [0] * n
        for v in order:
            self.cut[v] = v if self.size[self.link[v]] < window <= self.size[v] else self.cut[self.link[v]]
        self.window_items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        self.need = window
        for item, whole, seq in coded:
            at = 0
            if whole and len(seq) < window:
                for w in seq:
                    at = self.next[at][w]
                self.short.setdefault(at, {}).setdefault(len(seq), set()).add(item)
                self.need = min(self.need, len(seq))
                continue
            for k, w in enumerate(seq, 1):
                at = self.next[at][w]
                if k >= window:
                    self.window_items.setdefault(self.cut[at], set()).add(item)
        self.above = [0] * n
        for v in order:
            u = self.link[v]
            self.above[v] = u if u in self.short else self.above[u] if u > 0 else 0

    def _extend(self, last: int, w: int) -> int:
        """State of (sequence so far) + w; existing states are reused or split, never doubled."""
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._split(last, w, q)
        new = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        twin = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def match(self, words: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """Mask of hit words (None: none) and the items with occurring windows."""
        items: set[str] = set()
        n = len(words)
        if n < self.need or not self.vocabulary:
            return None, items
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
        hit = None
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.need:  # only known words can continue a match
                hit = self._stream(codes[a:b].tolist(), a, n, hit, items)
        return hit, items

    def _stream(self, codes, start, n, hit, items):
        nxt, link, size, window = self.next, self.link, self.size, self.window
        at = length = 0
        for k, w in enumerate(codes, start + 1):
            to = nxt[at].get(w)
            while to is None and at:
                at = link[at]
                length = size[at]
                to = nxt[at].get(w)
            if to is None:
                continue
            at, length = to, length + 1
            if length >= window:
                hit = hit or bytearray(n)
                hit[k - window: k] = b"\x01" * window
                items |= self.window_items.get(self.cut[at], ())
            if self.short:
                u = at if at in self.short else self.above[at]
                while u:
                    for m, names in self.short[u].items():
                        if m <= length:
                            hit = hit or bytearray(n)
                            hit[k - m: k] = b"\x01" * m
                            items |= names
                    u = self.above[u]
        return hit


def _automaton(packed: bytes, window: int) -> Automaton:
    return resident(f"test items, {window}", packed, lambda p: Automaton(pickle.loads(p), window))


def _chunks(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            words = words_of(text)
            at = no = 0
            while at < len(words):
                size, to = 0, at
                while to < len(words) and (size < CHUNK_BYTES or to - at < window):
                    size += len(words[to]) + 1
                    to += 1
                rows.append((item, no, at == 0 and to == len(words), b" ".join(words[at:to]), size))
                if to == len(words):
                    break
                at, no = to - window + 1, no + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()))], ["item", "no", "whole", "words", "size"])

    named = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return by_pieces(named, work, "item string, no int, whole boolean, words binary, size long")


def _packed_parts(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Cells in order, packed until a part would exceed ``PART_BYTES``."""
    parts, held = [], 0
    for cell, size in sizes:
        if not parts or held + size > PART_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(cell)
        held += size
    return parts


def find_contamination(notes: DataFrame, items: DataFrame, *, window: int = 13, one_in: int = 20, id_col: str = "id", text_col: str = "text",
                       item_id_col: str = "id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Where the notes repeat the test items, and what is left without those spans.

    ``notes(id, text)`` against held-out ``items(id, text)``, both normalised to lower-case words.
    A window is ``window`` consecutive words of an item, or a whole shorter item; a note word
    inside any occurrence of a window is hit.  Returns ``id, text, n_words, n_hit`` (long),
    ``items array<string>`` (sorted ids with occurring windows), ``spans array<struct<start,end>>``
    (hit runs in code points, end exclusive), ``cleaned`` (the text without its spans when they
    do not exceed the coverage limit, null when the note goes as a whole), ``contaminated``
    (n_hit > 0 and one_in * n_hit >= n_words) and a struct ``carry`` of the named note columns.

    Null or wordless texts have no words and are clean; null or wordless items match nothing; an
    empty item table leaves all notes clean; repeated rows are answered one by one.

    Items are cut into parts of about 1 MB of words (long items into overlapping chunks; chunks
    that repeat under one id count once; many small cells of a hash are packed by size, so the parts
    never depend on how ids repeat), each part is one automaton that is sent to the tasks, and notes pass the parts one
    after the other, so neither the driver nor a task holds a large item table.
    """
    spark = notes.sparkSession
    chunks = staged(_chunks(items, window, item_id_col, item_text_col).dropDuplicates(["item", "whole", "words"]), "test-items")
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cells = max(1, -(-total * CELLS // PART_BYTES))
    cell = F.pmod(F.xxhash64("item", "no", "words"), F.lit(cells))
    sizes = chunks.groupBy(cell.alias("cell")).agg(F.sum("size").alias("s")).collect()  # CELLS a part at most
    parts = _packed_parts(sorted((r.cell, r.s) for r in sizes)) or [[0]]
    columns = [F.col(f"`{c}`") for c in carry]
    out = notes.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*columns, F.lit(True).alias("_")).alias("carry"),
                       F.lit(None).cast("binary").alias("mask"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for p, own in enumerate(parts):
        rows = chunks.filter(cell.isin(own)).select("item", "whole", "words").collect()  # about PART_BYTES, or one cell
        packed = checked_broadcast(spark, pickle.dumps(sorted((r.item, r.whole, bytes(r.words).split(b" ")) for r in rows)), 64 << 20, "a part of the test items")
        if p + 1 < len(parts):
            out = staged(_pass(out, packed, window), "contamination")
    return _judged(out, packed, window, one_in)


def _hits(part: pa.RecordBatch, auto: Automaton):
    """Mask of hit words, items and number of words per note, added to what earlier parts found."""
    for text, mask, items in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()):
        words = words_of(text)
        hit, names = auto.match(words)
        if hit is not None and mask is not None:
            hit = (np.frombuffer(hit, np.uint8) | np.frombuffer(mask, np.uint8)).tobytes()
        yield text, mask if hit is None else bytes(hit), sorted({*items, *names}), len(words)


def _pass(notes: DataFrame, packed, window: int) -> DataFrame:
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        _, masks, items, sizes = zip(*_hits(part, _automaton(packed.value, window)))
        return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(sizes, pa.int64())], part.schema.names)

    return by_pieces(notes, work, notes.schema)


def _judged(notes: DataFrame, packed, window: int, one_in: int) -> DataFrame:
    """The last part, and what all parts together say: spans of the text, counts and the text without the spans."""
    made = StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, cleaned string, contaminated boolean")
    schema = StructType([*(notes.schema[c] for c in ("id", "text")), *made, notes.schema["carry"]])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.bool_())

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, mask, items, n in _hits(part, _automaton(packed.value, window)):
            k = sum(mask) if mask else 0
            gone = k > 0 and one_in * k >= n
            own = _runs(text, mask) if k else []
            rows.append((n, k, items, [{"start": a, "end": b} for a, b in own], None if gone else _without(text, own) if own else text, gone))
        return pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), part.column(2)], schema.names)

    return by_pieces(notes, work, schema)


def _runs(text: str, mask: bytes) -> list[tuple[int, int]]:
    raw = text.encode()
    out: list[list[int]] = []
    before = False
    for m, hit in zip(WORD.finditer(raw.lower()), mask):
        if hit and before:
            out[-1][1] = m.end()
        elif hit:
            out.append([m.start(), m.end()])
        before = bool(hit)
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    return [(int(starts[a]) - 1, int(starts[b - 1])) for a, b in out]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])
