"""Upsert, replace, write-once, ratings, ids, staged writes; each sink twice."""
from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexframe.sinks import tables as snk

LAW = "law_id long, name string, year int, act_number int, url string, html_path string, created_at timestamp_ntz"
BATCH = "arrival long, name string, year int, act_number int, url string, html_path string"
T0 = dt.datetime(2024, 1, 1)


def test_upsert_cases(spark):
    old = spark.createDataFrame([(1, "Old A", 2004, 11, "u1", "p1", T0), (2, "Old B", 2005, 3, "u2", "p2", T0)], LAW)
    batch = spark.createDataFrame([
        (1, "New A", 2004, 11, None, None),          # same key, NULL url: old url/path stay
        (2, "C first", 2010, 7, "c1", None),         # new key twice in the batch
        (3, "C last", 2010, 7, None, "pc"),          # last name, last non-NULL url
        (4, "No number", 2011, None, "x", None),     # NULL act number: appended
    ], BATCH)
    out = {(r.year, r.act_number): r for r in snk.upsert_laws(old, batch, "arrival").collect()}
    assert out[(2004, 11)].name == "New A" and out[(2004, 11)].url == "u1" and out[(2004, 11)].law_id == 1
    assert out[(2005, 3)].name == "Old B"
    c = out[(2010, 7)]
    assert (c.name, c.url, c.html_path, c.law_id) == ("C last", "c1", "pc", 2010 * 100000 + 7)
    assert out[(2011, None)].name == "No number"
    # idempotent: the same batch again changes nothing
    once = snk.upsert_laws(old, batch, "arrival")
    twice = snk.upsert_laws(once, batch, "arrival")
    cols = ["law_id", "year", "act_number", "name", "url", "html_path"]
    assert sorted(map(tuple, twice.select(*cols).collect()), key=str) == \
        sorted(map(tuple, once.select(*cols).collect()), key=str)


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "law_id long, seq long, t string")
    new = spark.createDataFrame([(1, 1, "A")], "law_id long, seq long, t string")
    once = snk.replace_sections(old, new)
    assert sorted(map(tuple, once.collect())) == [(1, 1, "A"), (2, 1, "c")]
    assert sorted(map(tuple, snk.replace_sections(once, new).collect())) == sorted(map(tuple, once.collect()))
    empty_law = spark.createDataFrame([(2,)], "law_id long")
    assert sorted(map(tuple, snk.replace_sections(once, new.limit(0), laws=empty_law).collect())) == [(1, 1, "A")]


def test_write_once_first_writer_wins(spark):
    store = spark.createDataFrame([(2004, 11, "old")], "year int, act_number int, html string")
    batch = spark.createDataFrame([(1, 2004, 11, "new"), (2, 2005, 1, "first"), (3, 2005, 1, "second")],
                                  "arrival long, year int, act_number int, html string")
    add = snk.write_once(store, batch, ["year", "act_number"], "arrival").collect()
    assert [(r.year, r.act_number, r.html) for r in add] == [(2005, 1, "first")]


def test_ratings_last_valid_wins_unknown_ignored(spark):
    res = spark.createDataFrame([(1, "q1", "unrated", None), (2, "q2", "unrated", None)],
                                "id long, query_text string, rating string, rated_at timestamp_ntz")
    rat = spark.createDataFrame([(1, "good", 1), (1, "bad", 2), (1, "meh", 3), (9, "good", 1)],
                                "id long, rating string, arrival int")
    out = {r.id: r for r in snk.apply_ratings(res, rat, "arrival", T0).collect()}
    assert out[1].rating == "bad" and out[1].rated_at == T0
    assert out[2].rating == "unrated" and out[2].rated_at is None and len(out) == 2


def test_dense_ids_and_append(spark):
    b = spark.createDataFrame([(k, f"q{k}") for k in (5, 3, 9, 1)], "item_id long, query_text string")
    ids = {r.item_id: r.id for r in snk.dense_ids(b, "item_id", 100, "id").collect()}
    assert ids == {1: 101, 3: 102, 5: 103, 9: 104}
    old = spark.createDataFrame([(7, "x")], "id long, query_text string")
    new = snk.append_evals(old, b, "item_id").collect()
    assert sorted(r.id for r in new) == [8, 9, 10, 11] and {r.rating for r in new} == {"unrated"}


def test_cascade_delete(spark):
    laws = spark.createDataFrame([(1,), (2,)], "law_id long")
    secs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "law_id long, seq long")
    l2, s2 = snk.cascade_delete(laws, secs, spark.createDataFrame([(1,)], "law_id long"))
    assert [r.law_id for r in l2.collect()] == [2] and [tuple(r) for r in s2.collect()] == [(2, 1)]


def test_write_table_swaps_in_place(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="lexframe-tbl-"), "laws")
    snk.write_table(spark, spark.range(3), target)
    snk.write_table(spark, spark.read.parquet(target).withColumn("id", F.col("id") + 10), target)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [10, 11, 12]
    snk.write_table(spark, spark.range(2), target, mode="append")
    assert spark.read.parquet(target).count() == 5


def test_write_table_partitioned_append(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="lexframe-tbl-"), "pages")
    rows = spark.createDataFrame([(2004, "a"), (2005, "b")], "year int, t string")
    snk.write_table(spark, rows, target, ["year"])
    more = spark.createDataFrame([(2004, "c"), (2006, "d")], "year int, t string")
    snk.write_table(spark, more, target, ["year"], mode="append")
    got = sorted((r.year, r.t) for r in spark.read.parquet(target).collect())
    assert got == [(2004, "a"), (2004, "c"), (2005, "b"), (2006, "d")]
    assert os.listdir(os.path.dirname(target)) == ["pages"]


def test_write_table_puts_the_old_table_back(spark, monkeypatch):
    target = os.path.join(tempfile.mkdtemp(prefix="lexframe-tbl-"), "laws")
    snk.write_table(spark, spark.range(3), target)
    real = snk._rename

    def fails_for_new(fs, src, dst):
        if "-new-" in src.toString():
            raise OSError("refused")
        real(fs, src, dst)

    monkeypatch.setattr(snk, "_rename", fails_for_new)
    with pytest.raises(OSError):
        snk.write_table(spark, spark.range(9), target)
    assert spark.read.parquet(target).count() == 3


def test_law_ids_do_not_clash(spark):
    keys = spark.createDataFrame([(2000, 100001, "x"), (2001, 1, "x"), (2000, 99999, "x"), (2000, 100000, "x")],
                                 "year int, act_number int, name string")
    ids = keys.select(snk.derived_law_id(F.col("year"), F.col("act_number"), F.col("name")).alias("i")).distinct()
    assert ids.count() == 4


def test_new_rows_is_multiset_difference(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a")], "k long, v string")
    after = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, snk.new_rows(after, before).collect())) == [(1, "a"), (2, "b")]
