"""Evaluation runs: batches that commit whole, runs that are taken up again, the stored
sweep, source blocks; the stored TF-IDF model; the structure preview."""
from __future__ import annotations

import datetime as dt
import math
import os
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexframe.operators import evals as ev
from lexframe.operators import evaljob as job
from lexframe.operators import quality as ql
from lexframe.operators import vectors as vx
from lexframe.sinks.batches import BatchTable
from lexframe.sinks.schema import EVAL_RESULTS
from lexframe.sinks.tables import write_table

T0 = dt.datetime(2024, 1, 1)
CORPUS = "vec_id long, text string, metadata map<string,string>, embedding array<float>, id string, rank int"
QUESTIONS = "question_no long, query_text string, embedding array<float>, score string, list_no int"


def _folder():
    return os.path.join(tempfile.mkdtemp(prefix="lexframe-eval-"), "evals")


def _corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"passage {i}", {"law": str(i)}, v.tolist(), "x", 7) for i, v in enumerate(rng.normal(size=(30, 6)).astype(np.float32))]
    return spark.createDataFrame(rows, CORPUS), np.array([r[3] for r in rows])


def _questions(spark, n=9):
    rng = np.random.default_rng(2)
    rows = [(i * 100, f" question {i}\n", v.tolist(), "x", 3) for i, v in enumerate(rng.normal(size=(n, 6)).astype(np.float32))]
    odd = [(5000, "question 0", rows[-1][2], "x", 3), (5001, "  \n", rows[0][2], "x", 3), (5002, None, rows[0][2], "x", 3),
           (5003, "no direction", [0.0] * 6, "x", 3), (5004, "no vector", None, "x", 3)]
    return spark.createDataFrame(rows + odd, QUESTIONS).repartition(4), np.array([r[2] for r in rows])


def _rows(store):
    return sorted((r.asDict(True) for r in store.read().collect()), key=lambda r: r["id"])


def test_a_stopped_run_goes_on_with_the_same_rows(spark):
    corpus, c = _corpus(spark)
    questions, q = _questions(spark)
    whole, halves = (BatchTable(spark, _folder(), EVAL_RESULTS) for _ in range(2))
    assert job.run_evaluations(whole, questions, corpus, 3, now=T0, batch_questions=100) == {"saved": 11, "skipped": 1}
    assert job.run_evaluations(halves, questions, corpus, 3, now=T0, batch_questions=4, max_batches=1)["saved"] == 4
    spark.range(3).write.parquet(f"{halves.path}/_new-left-by-a-lost-run")  # never committed, never read
    assert job.run_evaluations(halves, questions, corpus, 3, now=T0, batch_questions=4)["saved"] == 7
    assert halves.batches() == [0, 1, 2] and _rows(whole) == _rows(halves)
    assert job.run_evaluations(halves, questions, corpus, 3, now=T0) == {"saved": 0, "skipped": 12}
    got = _rows(whole)
    assert [r["id"] for r in got] == list(range(1, 12))
    sim = (q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    for i in range(9):
        best = np.argsort(-sim[i], kind="stable")[:3]
        assert got[i]["query_text"] == f"question {i}" and got[i]["top_k"] == 3 and got[i]["rating"] == "unrated"
        assert [n["text"] for n in got[i]["source_nodes"]] == [f"passage {b}" for b in best]
        assert [n["metadata"]["law"] for n in got[i]["source_nodes"]] == [str(b) for b in best]
        assert got[i]["scores"] == [n["score"] for n in got[i]["source_nodes"]] == pytest.approx(sim[i][best])
    assert [(r["query_text"], r["source_nodes"], r["scores"]) for r in got[9:]] == [("no direction", [], []), ("no vector", [], [])]


def test_run_over_earlier_answers_with_a_model(spark):
    corpus, _ = _corpus(spark)
    questions, _ = _questions(spark, 2)
    store = BatchTable(spark, _folder(), EVAL_RESULTS)
    store.append(spark.createDataFrame([(41, "question 1 ", None, None, None, "good", 5, T0, T0)], EVAL_RESULTS))
    model = lambda query, nodes: F.concat(F.upper(query), F.lit("/"), F.size(nodes).cast("string"))
    job.run_evaluations(store, questions, corpus, 2, model, T0)
    got = _rows(store)
    assert [(r["id"], r["llm_response"]) for r in got] == [(41, None), (42, "QUESTION 0/2"), (43, "NO DIRECTION/0"), (44, "NO VECTOR/0")]
    empty = BatchTable(spark, _folder(), EVAL_RESULTS)
    assert job.run_evaluations(empty, questions.filter("false"), corpus) == {"saved": 0, "skipped": 0} and empty.read().count() == 0
    job.run_evaluations(empty, questions, corpus.filter("false"), now=T0)
    assert all(r["source_nodes"] == [] for r in _rows(empty)) and len(_rows(empty)) == 4


def test_a_batch_is_not_committed_twice(spark, monkeypatch):
    table = BatchTable(spark, _folder(), "id long")
    table.append(spark.range(2))
    monkeypatch.setattr(BatchTable, "batches", lambda self: [])
    with pytest.raises(OSError):
        table.append(spark.range(5))
    monkeypatch.undo()
    assert table.read().count() == 2 and os.listdir(table.path) == ["batch=0"]


def test_stored_sweep(spark):
    corpus, c = _corpus(spark)
    q = corpus.filter("vec_id < 3")
    got = {(r.q_id, r.k): r for r in job.run_sweep(q, corpus.filter("vec_id < 5"), _folder(), drop_self=True).collect()}
    assert set(got) == {(i, k) for i in range(3) for k in range(2, 10)}
    for i in range(3):
        sim = c[:5] @ c[i] / np.linalg.norm(c[:5], axis=1)
        order = [int(j) for j in np.argsort(-sim) if j != i]
        for k in range(2, 10):
            assert got[i, k].source_ids == order[:k] and got[i, k].n_sources == len(got[i, k].scores) == min(k, 4)


def test_source_block(spark):
    scores = [0.8123, 1.0, 0.0, -0.25, 0.00051, 0.0005, -0.00012, 1.5e-05, -2e-12, 123456.5, None]
    nodes = [(t, s) for t, s in zip(["a", None, "c\nd"] + ["t"] * 8, scores)]
    df = spark.createDataFrame([(1, nodes), (2, []), (3, None)], "id int, n array<struct<text:string,score:double>>")
    got = {r.id: r.b for r in df.select("id", ev.source_block(F.col("n")).alias("b")).collect()}
    shown = lambda s: "N/A" if s is None else str(s)
    assert got[1] == "\n\n---\n\n".join(f"**Score:** {shown(s)}\n\n{t or ''}" for t, s in nodes) and got[2] == got[3] == ""


def test_stored_tfidf_model_serves_later_texts(spark):
    docs = [(1, "a b B c"), (2, "a é"), (3, None), (4, ""), (5, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("feature", F.lit("x")).withColumn("idf", F.lit(0))
    path = _folder()
    write_table(spark, vx.tfidf_fit(df, "text"), path)
    model = spark.read.parquet(path)
    assert model.count() == vx.FEATURES
    later = spark.createDataFrame([(9, "b b a unseen"), (10, None), (11, "...")], "doc_id long, text string")
    got = {r.feature: r.weight for r in vx.tfidf_weights(later, "text", "doc_id", model).collect()}
    import hashlib
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:3], 16)
    df_of = Counter({slot("a"): 3, slot("b"): 2})
    raw = {slot(w): n * math.log(6 / (df_of[slot(w)] + 1)) for w, n in Counter("b b a unseen".split()).items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got == pytest.approx({f: x / norm for f, x in raw.items()})
    v = vx.tfidf_vectors(vx.tfidf_weights(later, "text", "doc_id", model), "doc_id").collect()
    assert len(v) == 1 and len(v[0].embedding) == vx.FEATURES and sum(x * x for x in v[0].embedding) == pytest.approx(1, abs=1e-6)
    assert vx.tfidf_weights(df, "text", "doc_id", vx.tfidf_fit(df.filter("doc_id = 1"), "text")).filter("doc_id = 1 and weight <> 0").count() == 0
    assert vx.tfidf_fit(df.filter("false"), "text").filter("n_with + n_docs + idf <> 0").count() == 0


def test_structure_preview(spark):
    texts = ["plain", "it's", 'both \' and "', "back\\slash\tx", "line\nfeed\xa0end", "x" * 70, None]
    kinds = ["part", "section", "subsection", "paragraph", "subparagraph", "chapter", "odd"]
    rows = [(1, 10 * i, k, None if i == 6 else f"r{i}", "Title" if i % 2 else "", t) for i, (k, t) in enumerate(zip(kinds, texts))]
    rows.append((2, 1, "part", "p", None, "only"))
    df = spark.createDataFrame(rows, "law_id long, seq long, section_type string, section_ref string, section_title string, text_content string")
    got = {(r.law_id, r.list_no): r for r in ql.structure_preview(df, 6).collect()}
    assert set(got) == {(1, i) for i in range(1, 7)} | {(2, 1)} and got[1, 1].n_more == 1 and got[2, 1].n_more == 0
    for i, (law, seq, kind, ref, title, text) in enumerate(rows[:6]):
        shown = (text or "")[:60].replace("\n", " ")
        line = "  " * ql.INDENT[kind] + f"[{kind}] {ref}" + (f" — {title}" if title else "") + f"  |  {shown!r}"
        assert got[1, i + 1].line == line
