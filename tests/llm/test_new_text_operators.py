"""Fingerprints, fill-in-middle and spelling variants against brute force: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import infill, shingles, simhash, spelling

ODD = [None, "", " \n ", "one", "\n", "\n\n", "no end", "a\nb\n", "x <P> y\nz", "tail\n<M>", "漢字 🎱🎱\n한글\r\nΑΣ", "<P\n<S\n>M>\n", "\x00\x01\t\r a\x0b\x1cb c\x85d", "ab" * 40_000, "long\n" * 30_000]


def words(rng, n, letters="etaoin", longest=6):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n))


# -- op11 -------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    """Votes term by term and bit by bit."""
    value, _ = simhash._terms(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    votes = [0] * simhash.BITS
    for h, times in Counter(value.tolist()).items():
        weight = round(simhash.WEIGHT * (1 + math.log(times)))
        bits = np.unpackbits(np.array([shingles.mix(np.array([h], np.uint64) + np.uint64(j + 1))[0] for j in range(simhash.BITS // 64)], np.uint64).view(np.uint8))
        votes = [v + (weight if b else -weight) for v, b in zip(votes, bits)]
    return np.packbits(np.array(votes) > 0).tobytes()


def test_terms_are_words_pairs_and_windows_of_long_words():
    def count(text):
        return len(simhash._terms(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0])
    assert [count(t) for t in ("", " ", "a", "a b", " a  b c ", "a" * 32, "a" * 33, "b " + "a" * 40 + " c")] == [0, 0, 1, 3, 5, 1, 1 + 22, 5 + 29]


def test_fingerprints_equal_votes_counted_one_by_one():
    rng = random.Random(3)
    texts = ["", "a", "漢字" * 30, "x" * 90, words(rng, 5), words(rng, 300), "to be or not to be"]
    assert [x.tobytes() for x in simhash.of_texts(texts)] == [slow_fingerprint(t) for t in texts]
    again = simhash.of_texts(texts[::-1])[::-1]
    assert (again == simhash.of_texts(texts)).all()


def test_notes_meet_the_notes_that_follow(spark, notes, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 5)
    rng = random.Random(4)
    texts = [*ODD, *[words(rng, rng.randint(1, 60)) for _ in range(150)]]
    rng.shuffle(texts)
    got = {r.id: r for r in simhash.fingerprint_notes(notes(texts)).collect()}
    whole = [t or "" for t in texts]
    assert len(got) == len(texts)
    prints = [x.tobytes() for x in simhash.of_texts(whole)]
    for i, text in enumerate(whole):
        follower = whole[(i + 1) % len(whole)]
        edited = text[: len(text) - len(text) // 2] + follower[: len(text) // 2]
        r = got[i + 1]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == prints[i] and r.edited_fingerprint == simhash.of_texts([edited])[0].tobytes()
        away = [sum((a ^ b).bit_count() for a, b in zip(r.fingerprint, other)) for other in (r.edited_fingerprint, prints[(i + 1) % len(whole)])]
        assert [r.near_edited, r.near_next] == pytest.approx([max(0.0, math.cos(math.pi * d / 256)) for d in away])
    classes = {f: min(i + 1 for i, g in enumerate(prints) if g == f) for f in set(prints)}
    assert all(got[i + 1].class_id == classes[f] for i, f in enumerate(prints))


def test_half_of_a_note_is_more_alike_than_another_note(spark, notes):
    rng = random.Random(5)
    texts = [words(rng, 200, "etaoinshrdlu", 9) for _ in range(100)]
    got = simhash.compare_with_next(notes(texts)).collect()
    assert all(r.near_edited > r.near_next for r in got)


def test_repeated_rows_null_ids_and_lone_notes(spark, notes, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 2)
    rows = [(None, "z z"), (None, "z z"), (3, "b"), (3, "a"), *[(5, "same text")] * 40, (9, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got = simhash.fingerprint_notes(df).collect()
    assert Counter(r.id for r in got) == {None: 2, 3: 2, 5: 40, 9: 1}
    assert len({(r.edited_sha256, r.near_next) for r in got if r.id == 5}) == 1
    after_last = next(r for r in got if r.id == 9)
    assert after_last.n_chars == 0 and after_last.near_next < 0.3
    first = next(r for r in got if r.id is None)
    assert first.n_chars == 3 and first.class_id is None
    lone = simhash.fingerprint_notes(notes(["only one note"])).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"only ononly o").hexdigest()
    assert simhash.fingerprint_notes(notes([])).count() == 0


@pytest.mark.parametrize("radius, corpus", [(11, 300), (3, 300), (7, 1 << 36)])
def test_tables_find_all_within_the_radius(spark, monkeypatch, radius, corpus):
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    real = simhash.block_tables  # the tables of a corpus of so many fingerprints: several blocks a key in the last case
    monkeypatch.setattr(simhash, "block_tables", lambda n, bits=simhash.BITS, radius=radius: real(corpus, bits, radius))
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (6, 32), np.uint8)
    rows = []
    for i in range(220):
        bits = np.unpackbits(base[i % 6])
        bits[rng.choice(256, rng.integers(0, 9), replace=False)] ^= 1
        rows.append((i, bytearray(np.packbits(bits).tobytes())))
    rows += [(1000 + i, r[1]) for i, r in enumerate(rows[:50])] + [(2000, None)]
    got = {r.id: (r.class_id, r.n_links) for r in simhash.count_links(spark.createDataFrame(rows, "id long, fingerprint binary"), radius=radius).collect()}
    distinct = {}
    for i, f in rows[:-1]:
        distinct[bytes(f)] = min(i, distinct.get(bytes(f), i))
    links = Counter()
    for a, b in combinations(distinct, 2):
        if sum((x ^ y).bit_count() for x, y in zip(a, b)) <= radius:
            links[a] += 1
            links[b] += 1
    assert got == {i: (distinct[bytes(f)], links[bytes(f)]) for i, f in rows[:-1]} | {2000: (None, None)}
    assert sum(links.values()) > 100


def test_table_keys_cover_every_choice_of_blocks():
    for n, radius in ((100, 7), (1 << 20, 7), (1 << 36, 7), (1 << 20, 3)):
        tables = simhash.block_tables(n, 256, radius)
        assert len(tables[0][0]) * len(tables[0]) >= min(48, n.bit_length() - 3) - len(tables[0])
        rng = random.Random(n)
        for _ in range(200):
            changed = set(rng.sample(range(256), radius))
            assert any(not changed & {int(b) for block in t for b in block} for t in tables)


# -- op12 -------------------------------------------------------------------------------------------


def slow_rearranged(note_id, text, always, suffix_first):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{note_id}".encode()).hexdigest()[8 * i: 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= always:
        return len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("always, suffix_first", [(100, 50), (60, 0), (100, 100)])
def test_notes_are_cut_at_line_borders_and_restored(spark, notes, always, suffix_first):
    rng = random.Random(7)
    texts = [*ODD, *["\n".join(words(rng, rng.randint(0, 6)) for _ in range(rng.randint(1, 30))) + rng.choice(["", "\n"]) for _ in range(120)]]
    made = infill.rearrange_notes(notes(texts), always=always, suffix_first=suffix_first).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = {r.id: r for r in made.collect()}
    assert {r.form for r in got.values()} >= ({"plain", "psm", "spm"} if suffix_first == 50 else {"plain"})
    for i, text in enumerate(texts, 1):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_rearranged(i, text, always, suffix_first)
        assert r.back == (text or "")


def test_rearranging_nothing_repeats_and_null_ids(spark, notes):
    assert infill.rearrange_notes(notes([])).count() == 0
    df = spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (1, "a\nb")], "id long, text string")
    got = infill.rearrange_notes(df).collect()
    assert len(got) == 3 and sorted(r.output for r in got)[0] and len({r.output for r in got if r.id == 1}) == 1


# -- op13 -------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def slow_variants(rows, slip, shortest, least, ratio):
    counts = Counter()
    for note_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{note_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % slip == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def variants(df, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(df, **options).collect()}


@pytest.mark.parametrize("tile", [512, 3])
def test_variants_equal_brute_force(spark, notes, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE_ROWS", tile)
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["Straße", "Äpfelmus", "ÄPFELMUS", "naïveté×÷x", "q" * 90]

    def word():
        w = rng.choice(stems)
        at = rng.randrange(len(w))
        return w if rng.random() < 0.6 else rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:], w.upper()])
    texts = [*ODD, "q" * 89 + " " + "q" * 91] + [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(200)]
    for options in (dict(slip=7, shortest=4, least=2, ratio=2), dict(slip=199, shortest=6, least=5, ratio=5)):
        want = slow_variants(list(enumerate(texts, 1)), **options)
        assert variants(notes(texts), **options) == want
        assert options["slip"] == 199 or any(v[4] != v[2] for v in want.values() if v[2])  # some chains are longer than one link


def test_a_crowded_half_and_no_words(spark, notes):
    same = [f"prefix{a}{b}{c}" for a in "abcd" for b in "abcd" for c in "abcd"]
    texts = [" ".join(same)] * 6
    want = slow_variants(list(enumerate(texts, 1)), 199, 6, 5, 5)
    assert variants(notes(texts)) == want and want["prefixaaa"][1] >= 9
    assert variants(notes([None, "", "12 34 ., \n"])) == {} and variants(notes([])) == {}
    df = spark.createDataFrame([(None, "repeated")] * 5 + [(1, "repeated")] * 2, "id long, text string")
    assert variants(df) == slow_variants([("", "repeated")] * 5 + [(1, "repeated")] * 2, 199, 6, 5, 5)
