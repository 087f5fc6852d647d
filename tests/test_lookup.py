"""JSON lists, source nodes from message history, tool dispatch, search semantics."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexframe.operators import lookup as lk
from lexframe.operators.toolcalls import dispatch

LAWS = [(1, "Data Protection Act 2018", 2018, 7), (2, "Employment Equality Act", 1998, 21),
        (3, "Data Sharing Act 2019", 2019, 5), (4, "100% Rule Act", 2001, 1)]


def laws_df(spark):
    return spark.createDataFrame(LAWS, "law_id long, name string, year int, act_number int")


def test_json_list_cases(spark):
    rows = [(1, json.dumps([{"text": "a", "score": 0.5}])), (2, None), (3, "[]"), (4, '{"not": "a list"}')]
    df = spark.createDataFrame(rows, "id long, raw string")
    got = {r.id: r.n for r in df.select("id", F.size(lk.json_list(F.col("raw"), "struct<text:string,score:double>"))
                                        .alias("n")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}
    typed = spark.createDataFrame([(1, [0.1, 0.2])], "id long, a array<double>")
    assert typed.select(lk.json_list(F.col("a"), None).alias("x")).first().x == [0.1, 0.2]


def test_source_nodes_from_messages(spark):
    def tr(content):
        return json.dumps([{"type": "tool_result", "tool_use_id": "t", "content": content}])
    msgs = [
        (1, 0, "user", "plain question"),
        (1, 1, "assistant", json.dumps([{"type": "text", "text": "x"}])),
        (1, 2, "user", tr(json.dumps([{"text_content": "sec text", "law_id": 1}, {"name": "Law B"}, 5]))),
        (1, 3, "user", tr(json.dumps({"name": "Only", "year": 2004}))),
        (1, 4, "user", tr("null")),
        (1, 5, "user", tr("not json")),
    ]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, content string")
    got = sorted((r.turn, r.item_no, r.text, r.score, tuple(sorted(r.metadata))) for r in lk.source_nodes(df).collect())
    assert got == [(2, 0, "sec text", 0.0, ("law_id",)), (2, 1, "Law B", 0.0, ("name",)),
                   (3, 0, "Only", 0.0, ("name", "year"))]


def test_search_wildcards_and_empty_keyword(spark):
    reqs = spark.createDataFrame([(1, "data"), (2, ""), (3, "100%"), (4, "d_ta"), (5, "zzz")], "req_id long, keyword string")
    hits = lk.search_laws(laws_df(spark), reqs).groupBy("req_id").agg(F.collect_set("law_id").alias("ids"))
    got = {r.req_id: sorted(r.ids) for r in hits.collect()}
    assert got[1] == [1, 3] and got[2] == [1, 2, 3, 4] and got[3] == [4] and got[4] == [1, 3] and 5 not in got
    lit = lk.search_laws(laws_df(spark), reqs.filter("req_id = 4"), literal=True)
    assert lit.count() == 0


def test_law_by_name_year_zero_means_any(spark):
    reqs = spark.createDataFrame([(1, "data", 0), (2, "data", 2019), (3, "data", None), (4, "nothing", None)],
                                 "req_id long, name string, year int")
    got = {r.req_id: r.law_id for r in lk.law_by_name(laws_df(spark), reqs).collect()}
    assert got == {1: 1, 2: 3, 3: 1, 4: None}


def test_dispatch_routes_and_reports_unknown(spark):
    secs = spark.createDataFrame([(1, 1, "section", "1", 1), (1, 2, "subsection", "1(1)", 1), (1, 3, "section", "1", 2)],
                                 "law_id long, seq long, section_type string, section_ref string, position long")
    calls = spark.createDataFrame([
        (1, "search_laws", json.dumps({"query": "equality"})),
        (2, "get_law_by_name", json.dumps({"name": "sharing", "year": 2019})),
        (3, "get_law_sections", json.dumps({"law_id": 1})),
        (4, "get_section_by_ref", json.dumps({"law_id": 1, "section_ref": "1"})),
        (5, "get_section_by_ref", json.dumps({"law_id": 1, "section_ref": "9"})),
        (6, "get_weather", "{}"),
    ], "call_id long, tool string, args string")
    out = {}
    for r in dispatch(calls, laws_df(spark), secs).collect():
        out.setdefault(r.call_id, []).append(r)
    assert json.loads(out[1][0].result)["law_id"] == 2
    assert json.loads(out[2][0].result)["law_id"] == 3
    assert sorted(r.seq for r in out[3]) == [1, 2, 3]
    assert json.loads(out[4][0].result)["seq"] == 1          # first (lowest seq) of two rows with ref "1"
    assert out[5][0].result == "null"
    assert json.loads(out[6][0].result) == {"error": "Unknown tool: get_weather"}


def test_tool_calls_bad_arguments_are_error_rows(spark):
    import json

    from lexframe.operators.toolcalls import dispatch
    laws = spark.createDataFrame([(1, "A \\b Act", 2001, 1, "u", None)], "law_id long, name string, year int, act_number int, url string, html_path string")
    secs = spark.createDataFrame([(1, 5, "section", "1", "Title", "the text", 1)],
                                 "law_id long, seq long, section_type string, section_ref string, section_title string, text_content string, position long")
    calls = spark.createDataFrame([(1, "get_law_sections", '{"law_id":"abc"}'), (2, "search_laws", '{"query":"a \\\\b"}'),
                                   (3, "get_section_by_ref", '{"law_id":"1","section_ref":"1"}'), (4, "get_law_by_name", '{"name":"act","year":"soon"}')],
                                  "call_id long, tool string, args string")
    got = {r.call_id: json.loads(r.result) for r in dispatch(calls, laws, secs).collect()}
    assert got[1] == {"error": "Invalid law_id"}
    assert got[2]["url"] == "u" and got[2]["html_path"] is None
    assert got[3]["text_content"] == "the text" and got[3]["section_title"] == "Title"
    assert got[4]["law_id"] == 1


def test_urls_with_long_numbers_or_few_pieces_are_null(spark):
    from lexframe.functions.urls import url_act_number, url_path_year
    df = spark.createDataFrame([("https://x/eli/2004/act/99999999999/print",), ("short",)], "u string")
    assert [r[0] for r in df.select(url_act_number("u")).collect()] == [None, None]
    assert df.select(url_path_year("u")).collect()[1][0] is None


def test_source_nodes_keep_types(spark):
    def tr(content):
        return json.dumps([{"type": "tool_result", "content": content}])
    raws = ["{}", '["{\\"a\\":1}"]', '[{}, {"name": "N"}, [{"name": "inner"}], null, "x"]', '{"text_content": "", "name": "", "k": 1}',
            '{"text_content": "{\\"a\\": 1}", "n": {"x": [1, 2]}}', '"{\\"name\\": 1}"', "", " [ ] ", '{"name": 7}']
    df = spark.createDataFrame([(1, i, "user", tr(r)) for i, r in enumerate(raws)] + [(1, 99, "user", None), (1, 98, None, tr(raws[8]))],
                               "conv_id long, turn long, role string, content string")
    got = sorted((r.turn, r.item_no, r.text, tuple(sorted(r.metadata.items()))) for r in lk.source_nodes(df).collect())
    assert [g[:2] for g in got] == [(2, 1), (3, 0), (4, 0), (8, 0)]
    assert got[0][2] == "N" and json.loads(got[1][2]) == {"text_content": "", "name": "", "k": "1"}
    assert got[2][2:] == ('{"a": 1}', (("n", '{"x":[1,2]}'),)) and got[3][2] == "7"


def test_trigram_search_equals_comparing_every_name(spark):
    import random
    rnd = random.Random(4)
    letters = "aAbB é%_\\İΣσ."
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    names = [(i, word(rnd.randrange(12)), 2000 + i % 3, i % 7) for i in range(150)] + [(500, None, 2001, 1), (501, "", 2001, 1)]
    laws = spark.createDataFrame(names, "law_id long, name string, year int, act_number int").repartition(3)
    asked = [(i, n[1][a:a + rnd.randrange(1, 7)]) for i, n in enumerate(names[:60]) for a in [rnd.randrange(len(n[1]) + 1)]]
    asked += [(900, ""), (901, None), (902, "a%b"), (903, "zzz"), (904, "%%%"), (905, "ab" * 400), (3, asked[3][1])]
    reqs = spark.createDataFrame(asked, "req_id long, keyword string")
    for literal in (False, True):
        got = sorted((r.req_id, r.law_id) for r in lk.matching_laws(laws, reqs, literal=literal).collect())
        want = sorted((r.req_id, r.law_id) for r in reqs.join(laws, lk.name_match(laws["name"], reqs["keyword"], literal)).collect())
        assert got == want and len(want) > 100, literal


def test_answers_are_numbered_in_their_order(spark):
    reqs = spark.createDataFrame([(1, "act"), (2, "data"), (3, "none of them")], "req_id long, keyword string")
    laws = laws_df(spark).union(spark.createDataFrame([(9, "Act without number", 1998, None)], "law_id long, name string, year int, act_number int"))
    got = {(r.req_id, r.list_no): r.law_id for r in lk.search_laws(laws, reqs).collect()}
    assert got == {(1, 1): 2, (1, 2): 9, (1, 3): 4, (1, 4): 1, (1, 5): 3, (2, 1): 1, (2, 2): 3}


def test_numbered_over_gaps_null_keys_and_no_key(spark):
    from lexframe.operators.evals import unrated_queue
    from lexframe.operators.scan import numbered
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "(id * 7919 % 5000) * 4294967296 AS o")
    rows = numbered(df, ["k"], [F.desc("o")]).collect()
    want = {}
    for r in rows:
        want.setdefault(r.k, []).append((-r.o, r.list_no))
    assert len(rows) == 5000 and all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in want.values())
    results = spark.createDataFrame([(7, "unrated"), (3, "good"), (5, "unrated"), (90, "unrated")], "id long, rating string")
    assert sorted((r.list_no, r.id) for r in unrated_queue(results).collect()) == [(1, 5), (2, 7), (3, 90)]
    assert numbered(df.filter("false"), [], [F.col("o")]).count() == 0
