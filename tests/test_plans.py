"""Physical-plan properties the scale design relies on."""
from __future__ import annotations

import numpy as np

from lexframe.operators import lookup as lk
from lexframe.operators import vectors as vx
from lexframe.operators.hierarchy import build_sections
from lexframe.operators.scan import Running, running


def _plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_knn_keeps_partial_topk_before_shuffle(spark):
    rng = np.random.default_rng(1)
    c = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "vec_id long, embedding array<float>")
    q = c.limit(3)
    plan = _plan(vx.cosine_topk(q, c, 5))
    assert plan.count("WindowGroupLimit") >= 2      # partial + final around the exchange
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Broadcast" not in plan


def test_search_loops_over_short_keywords_only(spark):
    laws = spark.createDataFrame([(1, "Data Act", 2000, 1)], "law_id long, name string, year int, act_number int")
    reqs = spark.createDataFrame([(1, "data")], "req_id long, keyword string")
    plan = _plan(lk.matching_laws(laws, reqs))
    # one theta join, of the distinct keywords without a trigram
    assert plan.count("BroadcastNestedLoopJoin Inner") + plan.count("BroadcastNestedLoopJoin Cross") + plan.count("CartesianProduct") <= 2


def test_running_shuffles_rows_once(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS o", "id % 7 AS v")
    out = running(df, ["k"], "o", [Running("m", df["v"], "max")], chunk_rows=64, materialize=False)
    plan = _plan(out)
    # one hash exchange of the rows on (k, chunk); the prefix side is tiny (joined or broadcast)
    assert plan.count("hashpartitioning(k#") >= 1
    assert "Window" in plan and "CartesianProduct" not in plan


def test_section_scan_has_no_law_wide_window(spark):
    rows = spark.createDataFrame([(1, i, "", f"({i % 5 + 1}) x") for i in range(50)],
                                 "law_id long, row_no long, c1 string, c2 string")
    plan = _plan(build_sections(rows, chunk_rows=8))
    import re
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    assert specs and all("_chunk" in s for s in specs), specs


def test_marked_lines_are_computed_once(spark, tmp_path):
    from lexframe.sources import testdata as td
    docs = [(1, "One. Two.  . three ", "wiki", 4), (-5, "a. b", "x", 3), (None, "c. d", "x", 3), (3, None, "x", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = td.statute_rows(spark, str(tmp_path))
    # the filter that the section scan puts on the text does not hold the marker expression again
    assert _plan(rows.filter("c2 IS NOT NULL AND c2 <> ''")).count("SCHEDULE ") <= 1
    got = {(r.law_id, r.row_no): (r.c1, r.c2) for r in rows.filter("row_no > 0").collect()}
    assert got[1, 1] == ("", "(1) One") and got[1, 2] == ("", "(a) Two")
    assert got[1, 4] == ("", "three") and (1, 3) not in got
    assert got[-5, 1] == ("", None) and got[None, 1] == ("", None)


def test_rules_are_tried_on_their_openings_only(spark):
    import re

    from pyspark.sql import functions as F

    from lexframe.functions.patterns import CLASSIFY_RULES
    from lexframe.operators.classify import _opening, _rule_type
    lines = ["PART 1 x", "PARTS", "PART", "part 1", "SCHEDULE A b", "CHAPTER 2", "Article 9 z", "Article x", "3.—text", "3 .", "3 x", "(1) x", "(a) x",
             "(abcd) x", "(", "", "plain", "x (1)", "٣. arabic digit", "PART 2 y"]
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", _rule_type(F.col("t")).alias("r"))
    want = {t: next((n for n, p, _, _ in CLASSIFY_RULES if re.match(p.replace("(?sU)", "(?s)"), t)), None) for t in lines}
    assert {r.t: r.r for r in df.collect()} == want
    assert [_opening(p) for _, p, _, _ in CLASSIFY_RULES] == ["PART", "SCHEDULE", "CHAPTER", "Article", "", "(", "("]


def test_section_scans_store_only_what_is_read(spark, monkeypatch):
    """Running values that kept columns give, and titles nobody reads, are not checkpointed."""
    from lexframe.operators.hierarchy import build_sections
    lines = ["BE IT ENACTED", "PART 1 One", "1.— a", "more", "(2) b", "(a) c", "(i) d", "SCHEDULE 2 ", "(3) e", "Article 9 nine", "(1)", "CHAPTER 2 f"]
    rows = spark.createDataFrame([(law, i, "t", t) for law in (1, 2) for i, t in enumerate(lines)], "law_id long, row_no long, c1 string, c2 string")
    whole = build_sections(rows).collect()
    stored, kind = [], type(rows)
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: stored.append(self.columns) or real(self, eager))
    out = build_sections(rows, with_text=False, with_title=False)
    cols = [c for c in whole[0].__fields__ if c not in ("section_title", "text_content")]
    assert out.columns == cols
    assert {tuple(r) for r in out.collect()} == {tuple(r[c] for c in cols) for r in whole}
    assert len(stored) == 2 and {c for s in stored for c in s if c.startswith("_v_")} == {"_v__negfirst"}
    assert not {"node_title", "node_text", "section_title"} & {c for s in stored for c in s}


def test_rule_groups_are_those_of_the_whole_pattern(spark):
    import re

    from lexframe.functions.patterns import CLASSIFY_RULES
    from lexframe.operators.classify import classify_rows
    lines = ["PART 1 x y", "PART 1", "SCHEDULE Ab, (c)", "CHAPTER 2\nnext\nline", "Article 19z z", "3.—text . more", "3 – 4", "(1) x", "(12)", "(a) 😀 x", "(iv)é",
             "1. ", "plain"]
    out = classify_rows(spark.createDataFrame([(1, i, None, t) for i, t in enumerate(lines)], "law_id long, row_no long, c1 string, c2 string"))
    got = {r.c2: (r.raw_ref, r.node_title, r.node_text) for r in out.collect()}
    for t in lines:
        hit = next(((n, m, ref) for n, p, ref, _ in CLASSIFY_RULES if (m := re.match(p.replace("(?sU)", "(?s)"), t.strip()))), None)
        if hit is None:
            assert got[t] == (None, None, t)
        else:
            name, m, ref = hit
            rest = m[2].strip()
            headed = name in ("part", "schedule", "chapter", "article")
            assert got[t] == (ref.format(m[1]), rest if headed else "", "" if headed else rest), t
