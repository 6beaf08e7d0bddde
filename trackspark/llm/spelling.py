"""Spelling variants: words of all notes that one edit separates, found by dense prefix-suffix tiles."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .records import id_and_text, pieces, staged, tidy

# A-Z, a-z and U+00C0..U+00FF, on lower-cased UTF-8 bytes (bytes.lower touches A-Z alone).
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
SLIP = 199              # one run in so many loses a letter
SHORTEST, LEAST = 6, 5  # code points and occurrences of a word
RATIO = 5               # a form occurs so many times as often
HELD = 1 << 17          # distinct words a task counts before it hands them on
TILE_ROWS = 512         # words of a tile side
TILE_CELLS = 1 << 22    # letters compared at once


def slipped(run: bytes, h: int) -> bytes:
    """A run without its code point ``h % length``."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def count_words(notes: DataFrame, *, slip: int = SLIP, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``word, n``: occurrences of every run of letters in whole notes, after the slips that ids and runs decide."""
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in pieces(batch):
                for note_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    base = crc32(f"{'' if note_id is None else note_id}:".encode())
                    for word, times in Counter(RUN.findall((text or "").encode().lower())).items():
                        h = crc32(word, base)
                        held[word if h % slip else slipped(word, h)] += times
                if len(held) >= HELD:
                    yield _counted(held)
                    held.clear()
        if held:
            yield _counted(held)

    ship_package(notes.sparkSession)
    made = id_and_text(notes, id_col, text_col).mapInArrow(tidy(run), "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _tiles(words: DataFrame) -> DataFrame:
    """Words dealt to tiles: ``size, side`` and lists of words, counts and blocks.

    Two words of which the longer has L letters are one edit apart if their common prefix and
    suffix together reach L - 1, so the prefix reaches k = (L - 1) // 2 or the suffix L - 1 - k.
    A word stands in the groups of its prefix and suffix for L = its length and, as the shorter
    one, its length + 1.  A large group is dealt into blocks, and every two blocks are a tile.
    """
    length = F.char_length("word")
    keys = []
    for longer in (length, length + 1):
        k = F.floor((longer - 1) / 2).cast("int")
        keys += [F.struct(longer.alias("size"), F.lit(0).alias("side"), F.xxhash64(F.substring(F.col("word"), F.lit(1), k)).alias("h")),
                 F.struct(longer.alias("size"), F.lit(1).alias("side"), F.xxhash64(F.right(F.col("word"), longer - 1 - k)).alias("h"))]
    key = ["size", "side", "h"]
    placed = words.select("word", "n", length.alias("len"), F.explode(F.array(*keys)).alias("k")).select("word", "n", "len", "k.*")
    rows = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(TILE_CELLS) / F.col("size"))))
    groups = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("len").alias("_long"))
    groups = groups.filter((F.col("_n") > 1) & (F.col("_long") == F.col("size"))).select(*key, F.ceil(F.col("_n") / rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = placed.join(groups, key).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = F.struct("word", "n", "len", (F.col("block") > F.col("other")).cast("int").alias("second"))
    return dealt.groupBy(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(row).alias("m"))


def _matrix(words: list[str], size: int, right: bool) -> np.ndarray:
    """Code points of words padded with zeros to ``size``, at the left if they are aligned at the right."""
    pad = str.rjust if right else str.ljust
    return np.frombuffer("".join(pad(w, size, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), size)


def _pairs_of(starts: np.ndarray, first: np.ndarray, second: np.ndarray, alone: np.ndarray):
    """Index pairs of several tiles: block by block, or each pair once where a tile has one block.  Yields bounded arrays."""
    for s, a, b, one in zip(starts.tolist(), first.tolist(), second.tolist(), alone.tolist()):
        if one:
            x, y = np.triu_indices(a, 1)
        else:
            x, y = np.repeat(np.arange(a), b), np.tile(np.arange(a, a + b), a)
        if len(x):
            yield x + s, y + s


def single_edits(words: list[str], size: int, side: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index ``pairs`` (x, y) that are one edit apart, ``size`` the longer length, and belong to this side's tile."""
    left, right = _matrix(words, size, False), _matrix(words, size, True)
    length = np.array([len(w) for w in words])
    k = (size - 1) // 2
    found_x, found_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, TILE_CELLS // size)
    for x, y in pairs:
        for at in range(0, len(x), step):
            a, b = x[at: at + step], y[at: at + step]
            least = np.minimum(length[a], length[b])
            keep = np.maximum(length[a], length[b]) == size
            a, b, least = a[keep], b[keep], least[keep]
            prefix = np.minimum(_agreeing(left[a] != left[b], size), least)
            suffix = np.minimum(_agreeing((right[a] != right[b])[:, ::-1], size), least)
            near = (prefix + suffix >= size - 1) & (prefix < size) & ((prefix >= k) if side == 0 else (prefix < k))
            found_x.append(a[near])
            found_y.append(b[near])
    return np.concatenate(found_x), np.concatenate(found_y)


def _agreeing(differs: np.ndarray, size: int) -> np.ndarray:
    return np.where(differs.any(1), differs.argmax(1), size)


def _compared(batches):
    """Per tile and word: how many near words it holds, and the best of them."""
    for batch in batches:
        size, side, i, j, m = (batch.column(c) for c in range(5))
        size, side, i, j = (c.to_numpy() for c in (size, side, i, j))
        for s, d in sorted(set(zip(size.tolist(), side.tolist()))):
            tiles = np.flatnonzero((size == s) & (side == d))
            rows = [sorted(m[int(t)].as_py(), key=lambda r: r["second"]) for t in tiles]
            flat = [r for tile in rows for r in tile]
            words, n = [r["word"] for r in flat], np.array([r["n"] for r in flat])
            count = np.array([len(t) for t in rows])
            second = np.array([sum(r["second"] for r in t) for t in rows])
            x, y = single_edits(words, s, d, _pairs_of(np.cumsum(count) - count, count - second, second, i[tiles] == j[tiles]))
            if not len(x):
                continue
            x, y = np.concatenate((x, y)), np.concatenate((y, x))
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=lambda r: (-n[r], words[r]))] = np.arange(len(words))
            order = np.lexsort((rank[y], x))
            x, y = x[order], y[order]
            begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[w] for w in x[begin]], pa.string()), pa.array(np.diff(np.append(begin, len(x))), pa.int64()),
                 pa.array([words[w] for w in y[begin]], pa.string()), pa.array(n[y[begin]], pa.int64())], ["word", "near", "best", "best_n"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words (``word, n``, distinct) that have a near word; ties of ``best_n`` go to the smallest."""
    ship_package(words.sparkSession)
    tiles = _tiles(words).select("size", "side", "i", "j", "m")
    parts = tiles.mapInArrow(tidy(_compared), "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words that have a form: links are doubled until none leads on.

    A form occurs ``RATIO`` times as often as its word, so a chain is as long as the logarithm
    of a count and the rounds as many as the logarithm of that.
    """
    links = staged(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = staged(moved, "spelling-roots")
        if moved.filter("_moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def group_variants(notes: DataFrame, *, slip: int = SLIP, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root``: spelling variants among the words of all notes.

    ``notes(id, text)`` are the workbench's notes.  Words are runs of A-Z, a-z and U+00C0..U+00FF
    (A-Z lower-cased) of ``shortest`` code points or more that occur ``least`` times or more over
    all notes; one run in ``slip``, by the checksum of id and run, loses a letter before.  Two
    words are near if one code point inserted, deleted or replaced makes them equal.  A word's
    form is its commonest near word (ties: the smallest) if that occurs ``ratio`` times as often;
    ``root`` follows forms to the last one and is the word itself where there is none.

    Counts are summed inside tasks before they are shuffled, so neither a frequent word nor a
    hot note weighs more.  Near words meet in groups of a common half, dealt into tiles of
    bounded size that are compared as padded code-point matrices inside tasks; a tile hands on
    one row per word, never its pairs.  Null and empty texts have no words, a null id counts as
    empty, rows that repeat count each time, an empty table gives no rows, other columns are not read.
    """
    words = staged(count_words(notes, slip=slip, id_col=id_col, text_col=text_col).filter((F.col("n") >= least) & (F.char_length("word") >= shortest)), "spelling-words")
    joined = words.join(near_words(words), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    judged = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"),
                                  F.when(fits, F.col("best_n")).alias("form_n")), "spelling-judged")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
