"""STR1: incremental ingest is complete and idempotent."""
from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexframe.sinks.buckets import BucketTable
from lexframe.sinks.schema import ensure_buckets
from lexframe.streaming.ingest import stream_ingest

from .fixtures import F1, F2, page


def _write(d, name, items):
    with open(os.path.join(d, name), "w") as f:
        for it in items:
            f.write(json.dumps(it) + "\n")


def _item(name, year, num, rows):
    return {"name": name, "year": str(year), "url": f"https://s.example/eli/{year}/act/{num}/enacted/en/print.html",
            "full_text": page(rows), "plain_text": None}


def test_stream_ingest_twice(spark):
    src = tempfile.mkdtemp(prefix="lexframe-src-")
    root = tempfile.mkdtemp(prefix="lexframe-tables-")
    ckpt = os.path.join(tempfile.mkdtemp(prefix="lexframe-stream-"), "c")
    _write(src, "a.jsonl", [_item("", 2004, 11, F1), {"name": "bad", "url": "", "full_text": "x"}])
    _write(src, "b.jsonl", [_item("Companies Act", 2013, 46, F2)])
    stream_ingest(spark, src, root, ckpt)
    laws = {r.act_number: r for r in ensure_buckets(spark, root)["laws"].read().collect()}
    assert set(laws) == {11, 46}
    assert laws[11].name == "Harbours And Pilotage Act 2004" and laws[46].name == "Companies Act"
    secs = ensure_buckets(spark, root)["law_sections"].read()
    n1 = secs.count()
    assert n1 > 10 and {r.law_id for r in secs.collect()} == {2004 * 100000 + 11, 2013 * 100000 + 46}
    # a later file re-sends act 46 with a new name: raw page kept, law renamed, sections replaced
    _write(src, "c.jsonl", [_item("Companies (Amendment) Act", 2013, 46, F2)])
    stream_ingest(spark, src, root, ckpt)
    assert spark.read.parquet(f"{root}/raw_pages").count() == 2
    laws = {r.act_number: r.name for r in ensure_buckets(spark, root)["laws"].read().collect()}
    assert laws == {11: "Harbours And Pilotage Act 2004", 46: "Companies (Amendment) Act"}
    assert ensure_buckets(spark, root)["law_sections"].read().count() == n1
    # SNK4: each section and subsection with text has its vector, under the law's new name
    vectors = ensure_buckets(spark, root)["law_vectors"].read().collect()
    wanted = ensure_buckets(spark, root)["law_sections"].read().filter("section_type in ('section', 'subsection') and text_content <> ''")
    assert sorted((r.law_id, r.seq) for r in vectors) == sorted((r.law_id, r.seq) for r in wanted.collect()) and len(vectors) > 3
    assert {r.metadata.law_name for r in vectors} == set(laws.values())
    assert all(len(r.embedding) == 256 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors)
    # nothing new: nothing changes
    stream_ingest(spark, src, root, ckpt)
    assert ensure_buckets(spark, root)["law_sections"].read().count() == n1


def test_sections_come_from_the_stored_page(spark):
    src = tempfile.mkdtemp(prefix="lexframe-src-")
    root = tempfile.mkdtemp(prefix="lexframe-tables-")
    ckpt = os.path.join(tempfile.mkdtemp(prefix="lexframe-stream-"), "c")
    _write(src, "a.jsonl", [_item("Companies Act", 2013, 46, F2), _item("Companies Act", 2013, 46, F1)])
    stream_ingest(spark, src, root, ckpt)
    first = sorted(map(str, ensure_buckets(spark, root)["law_sections"].read().collect()))
    assert [r.html for r in spark.read.parquet(f"{root}/raw_pages").collect()] == [page(F2)]
    # the same key with another page: the stored page and its sections stay
    _write(src, "b.jsonl", [_item("Companies Act", 2013, 46, F1)])
    stream_ingest(spark, src, root, ckpt)
    assert [r.html for r in spark.read.parquet(f"{root}/raw_pages").collect()] == [page(F2)]
    assert sorted(map(str, ensure_buckets(spark, root)["law_sections"].read().collect())) == first


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "law_id bigint, seq bigint, m map<string,string>", buckets=16)
    assert t.read().count() == 0
    rows = spark.range(200).select(F.col("id").alias("law_id"), F.lit(1).cast("bigint").alias("seq"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    assert len(t.replace(rows)) == 16
    before = t.manifest()[1]["folders"]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("data-*/*/*.parquet")}
    one = spark.createDataFrame([(7, 5, None), (7, 6, None)], t.schema)
    touched = t.replace(one)
    after = t.manifest()[1]["folders"]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == {str(touched[0])}
    assert {p: p.stat().st_mtime_ns for p in files} == files
    got = sorted((r.law_id, r.seq) for r in t.read().collect())
    assert got == sorted([(i, 1) for i in range(200) if i != 7] + [(7, 5), (7, 6)])
    # the same again gives the same; a law that comes back empty loses its rows; null ids have their bucket
    t.replace(one)
    assert sorted((r.law_id, r.seq) for r in t.read().collect()) == got
    t.replace(one.filter("false"), one.select("law_id"))
    t.vacuum()
    again = BucketTable(spark, str(tmp_path / "t"), "law_id bigint, seq bigint, m map<string,string>")
    assert sorted(r.law_id for r in again.read().collect()) == [i for i in range(200) if i != 7]
    assert len(again._versions()) == 1 and again.manifest()[1]["buckets"] == 16
    assert t.replace(one.filter("false")) == []


def test_two_merges_from_one_manifest_do_not_both_commit(spark, tmp_path):
    ddl = "law_id bigint, seq bigint"
    t = BucketTable(spark, str(tmp_path / "t"), ddl, buckets=2)
    row = spark.createDataFrame([(1, 1)], ddl)

    def interrupted(old):
        t.replace(row)
        return old.unionByName(row)

    with pytest.raises(OSError):
        t.merge(row, interrupted)
    assert t.read().count() == 1
    with pytest.raises(ValueError):
        t.merge(row, lambda old: spark.range(50).selectExpr("id AS law_id", "id AS seq"))
