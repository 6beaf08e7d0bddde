"""Stamped documents: written and read back, refused rows, failed writes and torn lists."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trackspark.sources import documents as D
from trackspark.sources import stamped as T

ROW = "doc string, event_id long, t double, type string, note string, stamp struct<version:long,producer:string>"


def rows(spark, data):
    return spark.createDataFrame(data, ROW)


def back(spark, path, *producers):
    return sorted((r.doc, r.position, json.loads(r.body)["event_id"], r.refusal) for r in T.numbered(T.read_documents(spark, path, producers)).collect())


def test_a_document_split_over_tasks_comes_back_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "docs")
    data = [("hot" if i % 4 else f"d{i % 12}", i, float(i), "pot", 'a "quoted",\n[line] é' if i % 3 else None, None) for i in range(4000)]
    T.write_documents(rows(spark, data).repartition(5), path, "scan", ["event_id"], tasks=6)
    want = {}
    for doc, i, *_ in data:
        want.setdefault(doc, []).append(i)
    assert back(spark, path, "scan") == sorted((d, k, i, None) for d, ids in want.items() for k, i in enumerate(ids))
    got = T.read_documents(spark, path, ["scan"])
    assert got.filter("doc = 'hot'").select("part").distinct().count() > 1
    assert {json.loads(r.body)["note"] for r in got.collect()} == {'a "quoted",\n[line] é', None}
    lists = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".json") and not f.startswith("_")]
    assert sum(len(json.load(open(f))) for f in lists) == 4000
    status = D.document_status(got, "doc", ["scan"]).collect()
    assert {r.status for r in status} == {"STAMPED"} and {r.producer for r in status} == {"scan"}


@pytest.mark.parametrize("bad", [
    ("a", 9, None, "pot", None, None), ("a", 9, 1.0, None, None, None), ("a", 9, 1.0, "pot", None, (1, "probe")), ("a", 9, 1.0, "pot", None, (2, "scan"))])
def test_a_refused_row_publishes_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "docs")
    good = [("a", i, float(i), "pot", None, (1, "scan") if i % 2 else None) for i in range(6)]
    T.write_documents(rows(spark, good), path, "scan", ["event_id"])
    before = back(spark, path, "scan")
    with pytest.raises(Exception, match="named by its time|stamped"):
        T.write_documents(rows(spark, [*good, bad]), path, "scan", ["event_id"])
    assert back(spark, path, "scan") == before == [("a", i, i, None) for i in range(6)]


def test_append_overwrite_empty_and_missing(spark, tmp_path):
    path = str(tmp_path / "docs")
    assert back(spark, path) == []
    T.write_documents(rows(spark, [("a", 1, 1.0, "pot", None, None)]), path, "scan", ["event_id"])
    T.write_documents(rows(spark, [("a", 2, 1.0, "pot", None, None), (None, 3, 1.0, "pot", None, None)]), path, "probe", ["event_id"], overwrite=False)
    got = T.read_documents(spark, path, ["scan"])
    assert sorted((json.loads(r.body)["event_id"], r.refusal) for r in got.collect()) == [(1, None), (2, "stamped by another producer"), (3, "stamped by another producer")]
    assert D.document_status(got.filter("doc = 'a'"), "doc", ["scan", "probe"]).collect()[0].status == "MIXED"
    T.write_documents(rows(spark, []), path, "scan", ["event_id"])
    assert back(spark, path) == []


def test_newer_and_unstamped_rows_and_torn_lists_are_told(spark, tmp_path):
    path = tmp_path / "docs"
    T.write_documents(rows(spark, [("a", 1, 1.0, "pot", None, None)]), str(path), "scan", ["event_id"])
    at = next(f for f in path.rglob("*.json") if not f.name.startswith("_"))
    at.write_text('[\n {"doc": "a", "event_id": 1, "t": 1, "type": "pot", "document": {"version": 2, "producer": "scan"}},\n {"doc": "a", "event_id": 2, "t": 1, "type": "pot"},\n {"event_id": 3}]\n')
    got = sorted((json.loads(r.body)["event_id"], r.refusal, r.stamp is None) for r in T.read_documents(spark, str(path), ["scan"]).collect())
    assert got == [(1, "newer version", False), (2, None, True), (3, "missing time or type", True)]
    at.write_text('[\n {"doc": "a", "event_id": 1, "t": 1, "type": "pot"},\n {"doc": "a", "ev')
    with pytest.raises(Exception, match="closing bracket"):
        T.read_documents(spark, str(path)).agg(F.count("*")).collect()
