"""Fill-in-middle: notes cut at line borders into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import by_pieces, id_and_text

# One match of a whole text keeps the end of every line it passed; a line once taken is never given back.
LINES = regex.compile(r"((?>[^\n]*\n|[^\n]+))*")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
ALWAYS = 100            # so many notes in 100 are rearranged ...
SUFFIX_FIRST = 50       # ... and so many of them begin with the suffix


def draws(note_id, salt: str = "7") -> list[int]:
    """Four unsigned 32-bit numbers that depend on the note's id alone (a null id counts as empty)."""
    digest = hashlib.sha256(f"{salt}:{'' if note_id is None else note_id}".encode()).hexdigest()
    return [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]


def rearrange(text: str | None, h: list[int], always: int = ALWAYS, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, prefix code points, middle code points, output) of one text."""
    text = text or ""
    ends = LINES.fullmatch(text).ends(1)
    n = len(ends)
    if not text or h[2] % 100 >= always or any(m in text for m in MARKS):
        return n, PLAIN, None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The note's own text again, from what was made of it; each mark occurs once in a rearranged text."""
    def after_first(mark):
        return F.substring(F.substring_index(output, mark, 1), len(mark) + 1, (1 << 31) - 1)

    def between(left, right):
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(after_first(SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, after_first(PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def rearrange_notes(notes: DataFrame, *, salt: str = "7", always: int = ALWAYS, suffix_first: int = SUFFIX_FIRST, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: each whole note as a fill-in-middle example.

    ``notes(id, text)`` are the workbench's notes.  One full match of (line)* against the text
    keeps the end of every repetition; ``n`` is their number, and the two cuts, drawn from the
    note's id, are looked up among them.  ``output`` is prefix, suffix, middle (``psm``) or
    suffix, prefix, middle (``spm``), each behind its mark; ``restored`` undoes it.

    ``plain`` notes stay as they are (both counts null): null (as "") and empty texts, texts that
    hold one of the marks, and those beyond ``always`` in 100.  A null id is drawn as an empty
    one; repeated rows are answered one by one; an empty table gives no rows; other columns are
    not read.  One row needs its own text in memory, no more.
    """
    kind = notes.schema[id_col].dataType.simpleString()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [rearrange(t, draws(i, salt), always, suffix_first) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*made), kinds)], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return by_pieces(id_and_text(notes, id_col, text_col), work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
