"""Vectors, archives, links and the pipeline against brute force on small tables."""

import gzip
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from trackspark.llm import topk, urltree, warc
from trackspark.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


# -- op1 --------------------------------------------------------------------------------------------


def best_by_brute_force(rows, asked, k):
    clean = {(i, tuple(v)) for i, v in rows if i is not None and v is not None}
    first = {}
    for i, v in sorted(clean):
        first.setdefault(i, v)
    out = []
    for q in sorted(i for i in first if i in asked):
        scored = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(first[q], v)))), i) for i, v in clean if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("block, shard, probes", [(128, 4096, 2048), (4, 16, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, shard, probes):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("PROBES", probes)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(8)]) for i in range(150)] + [(i, [1, 1, 1, 1, 0, 0, 0, 0]) for i in range(150, 190)]
    rows += [(200, None), (None, [1] * 8), (201, []), (202, [5, 5]), (20, rows[20][1]), (203, [3_000_000_000] * 8), (204, [-(1 << 40)] * 8), (205, [(1 << 62)] * 8)]
    gallery = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, embedding array<long>, score string")
    asked = {i for i, _ in rows if i is not None and i % 20 == 0} | {205}
    got = topk.search(gallery, gallery.filter(F.col("id").isin(*asked)), 7)
    assert sorted(map(tuple, got.select("query_id", "rank", "id", "score").collect())) == best_by_brute_force(rows, asked, 7)


def test_top_k_of_small_and_empty_galleries(spark):
    one = spark.createDataFrame([(20, [1, 2]), (3, [1, 1])], "id long, embedding array<long>")
    assert [tuple(r) for r in topk.search(one, one.filter("id = 20")).select("query_id", "rank", "id", "score").collect()] == [(20, 1, 3, 3)]
    assert topk.search(one.limit(0), one.limit(0)).count() == 0


def test_blocks_below_the_bound_are_skipped():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.integers(-2, 3, (1280, 4)), rng.integers(90, 99, (128, 4))))
    q = np.full((5, 4), 3)
    best = topk.Best(5, 20)
    assert topk.score_shard(np.arange(5) - 9, q, np.arange(len(x)), x, best) == 5  # the last block alone
    assert (np.sort((q @ x.T)[0])[-20:][::-1] == best.score[0]).all()


def test_quantised_drops_what_is_not_finite(spark):
    rows = [(1, [0.5, -0.001, 1e-9]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    assert [r.v for r in df.orderBy("id").select(topk.quantised(F.col("e")).alias("v")).collect()] == [[32, -1, 0], None, None, None, None, []]


# -- op5 --------------------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("<p>é漢 abc\r\n") for _ in range(n))
    rows = [(i, f"http://x.org/{i}\nß", body(rng.randint(0, 400))) for i in range(60)]
    rows += [(100 + i, "http://same.org/", "same body") for i in range(40)] + [(200, None, None), (201, "u", ""), (202, "u", ""), (None, "n", "same body"), (139, "again", "same body"), (300, "long", "z" * 300_000)]
    return rows


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, shard string")
    folder = f"file://{tmp_path}/out"
    manifest = warc.write_archives(pages, folder, least_bytes=least, shard_records=25, file_bytes=2000).collect()
    assert sum(m.records for m in manifest) == len(rows) and len({m.file for m in manifest}) == len(manifest)
    got = warc.read_archives(spark, folder).collect()
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(i, top.get(html or "", i))
    want = []
    for i, _, html in rows:
        h = html or ""
        again = len(h.encode()) >= least and h in top and (i is None or i < top[h])
        want.append((i or -1, len(h.encode()), warc.sha1_base32(h.encode()), "revisit" if again else "response", top[h] if again else None))
    shown = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    fix = [(-1 if r[0] is None else r[0], *w[1:]) for r, w in zip(rows, want)]
    assert sorted(map(str, shown)) == sorted(map(str, fix))
    assert all(bytes(r.payload).decode() == dict((i, h or "") for i, _, h in rows)[r.page_id] for r in got if r.payload is not None and r.page_id != 139)


def test_archives_are_the_same_bytes_each_time(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    a, b = (warc.write_archives(p, f"file://{tmp_path}/{n}", shard_records=20).orderBy("file").collect() for n, p in (("a", pages), ("b", pages.repartition(7))))
    assert a == b
    name = os.listdir(tmp_path / "a")
    assert not any(n.endswith(".gz") and not gzip.open(tmp_path / "a" / n).read().startswith(b"WARC/1.1\r\n") for n in name)


def test_damaged_and_unlisted_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    listed = warc.write_archives(spark.createDataFrame(page_rows(), "page_id long, url string, html string"), folder).first().file
    (tmp_path / "out" / "shard-99999999-0000.warc.gz").write_bytes(gzip.compress(b"left by a lost task"))
    assert warc.read_archives(spark, folder).count() == len(page_rows())
    (tmp_path / "out" / listed).write_bytes(gzip.compress(warc.record(1, 7, 0, "u", "h", None, "2025-01-01T00:00:00Z")))
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_archives(spark, folder).count()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(empty, f"file://{tmp_path}/none").count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("ids", ["outlier", "one id"])
def test_shards_follow_rows_not_ids(spark, tmp_path, ids):
    rows = [(7 if ids == "one id" else i if i else 10**15, f"http://a/{i}", f"body {i % 150}") for i in range(400)]
    folder = f"file://{tmp_path}/out"
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shard_records=20).collect()
    assert len({m.shard for m in manifest}) > 10 and max(m.records for m in manifest) < 150
    read = warc.read_archives(spark, folder)
    assert read.rdd.getNumPartitions() > 8
    got = read.collect()
    assert sorted(r.url for r in got) == sorted(u for _, u, _ in rows)
    top = {h: max(i for i, _, g in rows if g == h) for _, _, h in rows}
    want = {u: (i, top[h] if i < top[h] else None) for i, u, h in rows}
    assert all((r.page_id, r.refers_to) == want[r.url] for r in got)
    names = [gzip.open(tmp_path / "out" / m.file).read() for m in manifest]
    own = [line for raw in names for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    named = [line.split(b": ")[1] for raw in names for line in raw.split(b"\r\n") if line.startswith(b"WARC-Refers-To:")]
    assert len(set(own)) == 400 and {b"WARC-Record-ID: " + x for x in named} <= set(own)


# -- op10 -------------------------------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def rule_for(host, path):
    fits = [(len(r), r, v) for v, r in URL_RULES for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_parts_of_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "HTTP://Www.Example.com/en/1?x#y", "http://example.com/en", "http://xexample.com/en/", "http://m.example.com/en/é",
            "http://n.net/es/1", "http://n.net/ES/1", "http://net/fr/", "http://a.com?x/y", "http://a.org#f/://b.com/", "x://y://z/", "http://n.net\n/fr/a\nb", "http://ÄB.net/fr/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "id long, url string, host string, n string")
    got = {r.id: r for r in urltree.judge_sources(df, URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = split_url(u)
        rule, verdict = rule_for(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict)
    assert urltree.judge_sources(df.limit(0), URL_RULES).count() == 0


def test_templates_judge_what_rules_leave_open(spark):
    rules = [("block", "a.org/shop/item1"), ("allow", "a.org/news/")]
    rows = [f"http://a.org/shop/item1{i}" for i in range(40)] + [f"http://a.org/shop/item2{i}" for i in range(5)] + [f"http://a.org/news/{i}" for i in range(9)] + ["http://a.org/other/1", "http://b.org/shop/item9"]
    rows += [f"http://c.org/{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)}/x" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, url string")
    got = {rows[r.id]: r for r in urltree.judge_sources(df, rules).collect()}
    assert got["http://a.org/shop/item23"].verdict == "block" and got["http://a.org/shop/item23"].rule is None  # item* is one template
    assert got["http://a.org/other/1"].verdict == "allow" and got["http://b.org/shop/item9"].verdict == "allow"
    assert {got[r].template for r in rows if "c.org" in r} == {"c.org/*/x"}


def slow_judgements(rows, rules, tree):
    """Templates and judgements branch by branch, each from its own list of links."""
    def generalised(links, depth):  # links: (index, segments); returns index -> template
        out = {i: () for i, seg in links if len(seg) == depth}
        more = [(i, seg) for i, seg in links if len(seg) > depth]
        kinds = {seg[depth] for _, seg in more}
        wild = len(kinds) > tree.wide and len(more) < tree.thin * len(kinds)
        for kind in {"*"} if wild else kinds:
            below = generalised([(i, seg) for i, seg in more if wild or seg[depth] == kind], depth + 1)
            out |= {i: (kind, *t) for i, t in below.items()}
        return out

    split = [split_url(u) for u in rows]
    stated = []
    for host, path in split:
        fits = [(len(r), r, v) for v, r in rules for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        stated.append(max(fits)[2] if fits else None)
    out = {}
    for host in {h for h, _ in split}:
        links = [(i, [re.sub(r".*[0-9].*", "*", s, flags=re.S) for s in p.split("/") if s]) for i, (h, p) in enumerate(split) if h == host]
        shape = generalised(links, 0)
        for i, t in shape.items():
            judged = above = None
            for k in range(len(t) + 1):
                marks = [stated[j] for j, o in shape.items() if o[:k] == t[:k] and stated[j]]
                l, b = len(marks), marks.count("block")
                if k == 0:
                    judged = (l, b)
                elif l:
                    s = above[1] / above[0]
                    if abs(b / l - s) > tree.z * (s * (1 - s) / l) ** 0.5:
                        judged = (l, b)
                above = (l, b)
            purity = (judged[1] + tree.weight * tree.prior) / (judged[0] + tree.weight)
            out[i] = stated[i] or ("block" if purity >= tree.reject else "allow")
    return out


def test_tree_equals_branch_by_branch(spark):
    rng = random.Random(21)
    rules = [("block", "bad.org/"), ("allow", "bad.org/good/"), ("block", "mix.org/a/"), ("allow", "mix.org/b/"), ("block", "deep.org/a/b/c/d/e/bad")]
    names = ["a", "b", "c", "good", "list", "item7", "item8"]
    rows = [f"https://{rng.choice(['bad', 'mix', 'x.mix', 'none'])}.org/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 7))) for _ in range(500)]
    rows += ["https://mix.org/b/" + "".join(rng.choice("abcdef") for _ in range(5)) + rng.choice(["/x/y", "/x/z", ""]) for _ in range(120)]
    rows += [f"https://deep.org/a/b/c/d/e/{rng.choice(['bad', 'good'])}{c}" for c in "pqrstuvwxyz"] + ["https://deep.org/a/b/c/d/f/other", None, "no scheme", "x://", "x:///", "https://mix.org" + "/long" * 300]
    got = {r.id: r.verdict for r in urltree.judge_sources(spark.createDataFrame(list(enumerate(rows)), "id long, url string"), rules).collect()}
    want = slow_judgements(rows, rules, urltree.Tree())
    assert got == want
    unruled = [v for u, v in zip(rows, (want[i] for i in range(len(rows)))) if u and "mix.org/c" in u]
    assert {"block", "allow"} <= set(want.values()) and unruled


def test_unlabelled_paths_take_their_nearest_labelled_branch(spark):
    rules = [("block", "a.org/x/y/bad"), ("allow", "a.org/ok/")]
    rows = [f"http://a.org/x/y/bad/{c}/d/e/f" for c in "abcdefghijklmno"] * 3 + [f"http://a.org/ok/{c}" for c in "abcdefghijkl"] * 3 + ["http://a.org/x/y/new/p/q/r", "http://a.org/ok2/p", "http://b.org/x/y/new"]
    got = {rows[r.id]: r.verdict for r in urltree.judge_sources(spark.createDataFrame(list(enumerate(rows)), "id long, url string"), rules).collect()}
    assert [got[u] for u in rows[-3:]] == ["block", "allow", "allow"]


# -- queries and pipeline ---------------------------------------------------------------------------


def test_each_operator_has_one_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("id", F.lit("clash"))
    base = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        left = {r.doc_id: r for r in out.collect()}
        assert set(left) <= set(base)
        changed = [i for i in left if left[i].text != base[i].text]
        assert name == "secret_scan" or not changed
        assert all(left[i].n_chars == len(left[i].text) for i in changed)
    nothing = stage(spark, docs.limit(0), SF)
    assert nothing.count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(base) and all(len(r.token_ids) == r.n_tokens for r in last)
