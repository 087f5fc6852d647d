"""Shredding, gate, classification, title and tree on hand-made act pages,
plus the chunked scan against a stack-walk model on random documents."""
from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexframe.functions.text import slug, strip_ws, title_case
from lexframe.operators.classify import act_titles, classify_rows, enactment_gate
from lexframe.operators.hierarchy import build_sections, parent_by_ref
import html.entities

from lexframe.functions.text import decode_references
from lexframe.operators.shred import joined_cell_text, page_text, shred_rows

from .fixtures import F1, F1_ROWS, F2, F2_ROWS, F3, F3_ROWS, expected, labels_of, node, page

COLS = ["seq", "section_type", "section_ref", "section_title", "text_content", "position",
        "parent_seq", "parent_ref"]


def pages_df(spark, *docs):
    return spark.createDataFrame([(i + 1, page(rows)) for i, rows in enumerate(docs)], "law_id long, html string")


def shredded(spark, *docs):
    return shred_rows(pages_df(spark, *docs)).select("law_id", "row_no", "c1", "c2")


def sections_of(spark, rows_list, chunk_rows=1 << 16):
    df = spark.createDataFrame([(1, i, c1, c2) for i, (c1, c2) in enumerate(rows_list)],
                               "law_id long, row_no long, c1 string, c2 string")
    out = build_sections(df, chunk_rows=chunk_rows).orderBy("seq").collect()
    return [{c: r[c] for c in COLS} for r in out]


def test_shred_keeps_three_cell_rows_in_order(spark):
    rows = shredded(spark, F3).orderBy("row_no").collect()
    assert [r.row_no for r in rows][:2] == [0, 2]          # the 2-cell row is dropped, numbers kept
    assert rows[0].c2 == "SMALL MATTERS ACT 2001"


def test_page_without_table_gives_no_rows_but_text(spark):
    df = spark.createDataFrame([(1, "<html><body><p>Alpha</p> <p>Beta &amp; Gamma</p></body></html>")],
                               "law_id long, html string")
    assert shred_rows(df).count() == 0
    assert df.select(page_text(F.col("html")).alias("t")).first().t == "Alpha\nBeta & Gamma"


def test_cell_text_joined_and_newlines_flattened(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a\nb</td><td><b>c</b></td></tr></table>")], "law_id long, html string")
    assert df.select(joined_cell_text(F.col("html"), "td").alias("t")).first().t == "a b c"


def test_f1_title_parts_refs(spark):
    rows = shredded(spark, F1)
    title = act_titles(rows).first().detected_title
    assert title == "Harbours And Pilotage Act 2004"
    secs = build_sections(rows).collect()
    parts = [r.section_ref for r in secs if r.section_type == "part"]
    assert len(parts) >= 3 and len(parts) == len(set(parts))
    refs = {r.section_ref for r in secs}
    assert {"7(2)", "3(2)"} <= refs
    s7 = [r for r in secs if r.section_ref == "7"][0]
    assert s7.section_title == "Pilotage districts."
    b = [r for r in secs if r.section_ref == "b"][0]
    assert b.text_content == "by removing one.\nand the order shall be laid before each House."


def test_f2_refs_and_no_bare_subsections(spark):
    rows = shredded(spark, F2)
    assert act_titles(rows).first().detected_title == "Companies (Miscellaneous Provisions) Act 2013"
    secs = build_sections(rows).collect()
    refs = {r.section_ref for r in secs}
    assert {"1", "2", "3", "2(8)", "2(9)", "Article 2(3)", "Schedule 1"} <= refs
    assert not [r for r in secs if r.section_type == "subsection" and r.section_ref.startswith("(")]


def test_f3_edge_cases(spark):
    secs = {r.section_ref: r for r in build_sections(shredded(spark, F3)).collect()}
    assert secs["1"].section_type == "part"                  # NBSP after PART, Unicode \s
    assert "(2)" in secs                                     # subsection right after a part
    assert secs["5(1)"].parent_ref == "Chapter 2"            # chapter keeps the current section
    assert secs["c"].section_type == "subparagraph" and secs["e"].section_type == "paragraph"
    assert "(viii) four roman letters match nothing" in secs["c"].text_content
    assert "3A" not in secs and "Part 1 lower-case keyword is text" in secs["c"].text_content
    assert all("before any node" not in r.text_content for r in secs.values())


def test_no_enacting_row_no_nodes(spark):
    rows = [["", "", "1.—A section"], ["", "", "(1) sub"]]
    assert build_sections(shredded(spark, rows)).count() == 0


def test_matches_labels_of_fixtures(spark):
    for doc in (F1_ROWS, F2_ROWS, F3_ROWS):
        pairs = [(cells[1], cells[2]) for cells, _ in doc if len(cells) == 3]
        assert sections_of(spark, pairs, chunk_rows=3) == [{c: n[c] for c in COLS} for n in expected(labels_of(doc))]


def test_structure_only_sections_equal_full_sections_without_text(spark):
    for doc, chunk in ((F1, 3), (F2, 2), (F3, 1 << 16)):
        rows = shredded(spark, doc)
        full = build_sections(rows, chunk_rows=chunk, with_breadcrumb=True).drop("text_content")
        bare = build_sections(rows, chunk_rows=chunk, with_breadcrumb=True, with_text=False)
        assert bare.columns == full.columns
        assert sorted(bare.collect()) == sorted(full.collect())


def test_start_of_texts_is_the_start_of_whole_texts(spark):
    cells = [(-1, "", "THE ACT"), (0, "", "BE IT ENACTED"), (1, "a", "1.\u2014" + "x" * 9), (2, "", "y" * 9), (3, "", "zz"), (4, "", "(1) é𝒳" * 3),
             (5, "", "(2)"), (6, "", "w" * 30), (7, "", "PART 2 T")]
    rows = spark.createDataFrame([(5, *c) for c in cells], "law_id long, row_no long, c1 string, c2 string")
    full = {r.seq: r for r in build_sections(rows).collect()}
    for n in (4, 10):
        cut = build_sections(rows, text_chars=n).collect()
        assert len(cut) == len(full) == 4
        for r in cut:
            assert r.asDict() == full[r.seq].asDict() | {"text_content": full[r.seq].text_content[:n]}


def row(c1, c2, label):
    return (c1, c2), label


GATE = object()
#: each strategy draws a row together with its label
ROW = st.one_of(
    st.builds(lambda n, t: row("", f"PART {n} {t}", node("part", str(n), t, "")), st.integers(1, 4), st.sampled_from(["", "Heading"])),
    st.builds(lambda n: row("", f"SCHEDULE {n}", node("schedule", f"Schedule {n}", "", "")), st.integers(1, 3)),
    st.builds(lambda n: row("", f"CHAPTER {n}", node("chapter", f"Chapter {n}", "", "")), st.integers(1, 3)),
    st.builds(lambda n: row("", f"Article {n} Title", node("article", f"Article {n}", "Title", "")), st.integers(1, 3)),
    st.builds(lambda n, c1: row(c1, f"{n}.—Text of section", node("section", str(n), c1, "—Text of section")), st.integers(1, 20),
              st.sampled_from(["", "Short title."])),
    st.builds(lambda n: row("", f"({n}) subsection", node("subsection", str(n), "", "subsection")), st.integers(1, 9)),
    st.builds(lambda a: row("", f"({a}) paragraph", node("paragraph", a, "", "paragraph")), st.sampled_from(["a", "b", "ab"])),
    st.builds(lambda a: row("", f"({a}) item", node("subparagraph", a, "", "item")), st.sampled_from(["c", "i", "ii", "iv", "x"])),
    st.just(row("", "(viii) paragraph", "(viii) paragraph")),
    st.just(row("", "plain continuation", "plain continuation")),
    st.just(row("", "", None)),
    st.just(row("", "BE IT ENACTED as follows", GATE)),
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=0, max_size=40), st.sampled_from([2, 5, 1 << 16]))
def test_chunked_scan_matches_labels(spark, rows, chunk):
    labels = [x for _, x in rows]
    gate = labels.index(GATE) if GATE in labels else len(labels)
    # rows up to the first enacting row are none; a later one is text
    labels = [None if i <= gate else "BE IT ENACTED as follows" if x is GATE else x for i, x in enumerate(labels)]
    got = sections_of(spark, [c for c, _ in rows], chunk_rows=chunk)
    assert got == [{c: n[c] for c in COLS} for n in expected(labels)]


def test_gate_and_parent_by_ref(spark):
    rows = shredded(spark, F1)
    gated = enactment_gate(rows).orderBy("row_no").collect()
    assert gated[0].c2 == "PART 1 Preliminary and General"
    pb = parent_by_ref(build_sections(rows)).collect()
    sub = [r for r in pb if r.section_ref == "7(2)"][0]
    assert sub.parent_by_ref == sub.parent_seq


def test_classify_rules(spark):
    df = spark.createDataFrame([(1, 0, "", t) for t in ["PART 1Preliminary", "12.—(1) In this", "(l) x", "Part 1"]],
                               "law_id long, row_no long, c1 string, c2 string")
    got = [(r.section_type, r.raw_ref, r.node_text) for r in classify_rows(df).collect()]
    assert got[0][:2] == ("part", "1Preliminary")
    assert got[1] == ("section", "12", "—(1) In this")
    assert got[2][0] == "subparagraph" and got[3][0] is None


def test_text_helpers_match_python(spark):
    samples = ["THE (AMENDMENT) ACT 2004", "co-op's DUBLIN", "ÉIRE ACT", "  padded\t", "src12act"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(title_case("s").alias("t"), strip_ws("s").alias("w"), slug("s").alias("g")).collect()
    import re
    assert [r.t for r in got] == [s.title() for s in samples]
    assert [r.w for r in got] == [s.strip() for s in samples]
    assert [r.g for r in got] == [re.sub(r"\W+", "_", s).lower() for s in samples]


def raw_pages(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs, 1)), "law_id long, html string")


def found(df):
    return {(r.law_id, r.row_no): (r.n_cells, r.c0, r.c1, r.c2) for r in df.collect()}


def test_rows_without_end_tags(spark):
    messy = ("<p>before</p><TABLE class='a > b'><tr><td>a<td>Title.<td>1.—Text <b>bold</b>"
             "<tr><td><td><td>(1) sub<table><tr><td>x</td></tr></table> tail</table><p>after</p>"
             "<script>var s = '<tr><td>no</td></tr>';</script>")
    no_end = "<table><tr><td>a<td>b<td>c"
    twice = "<table><tr><td>1<td>2<td>3</table><table><tr><td>4<td>5<td>6</table>"
    stray = "</table></td><table><tbody><tr><th>h<td>p<td>q<td>r &eacute;&#8212;&#x1F642;&nbsp;</tbody><tr><td>x<!-- c --> y<td>5 < 6<td title=\"<td>\">&amp;lt;"
    got = found(shred_rows(raw_pages(spark, messy, no_end, twice, stray, "", "<p>none</p>", None, "<tables><tr><td>1<td>2<td>3")))
    assert got == {(1, 0): (3, "a", "Title.", "1.—Text bold"), (1, 1): (4, "", "", "(1) sub x tail"),
                   (2, 0): (3, "a", "b", "c"), (3, 0): (3, "1", "2", "3"),
                   (4, 0): (3, "p", "q", "r é—🙂"), (4, 1): (3, "xy", "5 < 6", "&lt;")}


def test_nested_tables_keep_their_rows_and_the_text_after_them(spark):
    nested = ("<table><tr><td></td><td></td><td>BE IT ENACTED</td></tr>"
              "<tr><td></td><td></td><td>1.—Text <table><tr><td>i<td>ii<td>iii<table><tr><td>d<td>e<td>f</table></td></tr></table> more</td></tr>"
              "<tr><td></td><td></td><td>(1) after the inner table</td></tr></table>")
    got = found(shred_rows(raw_pages(spark, nested, page(F2))))
    assert {k: v for k, v in got.items() if k[0] == 1} == {
        (1, 0): (3, "", "", "BE IT ENACTED"), (1, 1): (9, "", "", "1.—Text i ii iii d e f more"), (1, 2): (6, "i", "ii", "iii d e f"),
        (1, 3): (3, "d", "e", "f"), (1, 4): (3, "", "", "(1) after the inner table")}
    assert sum(1 for k in got if k[0] == 2) == len(F2)


def test_repeated_pages_and_null_keys(spark):
    one, two = "<table><tr><td>a<td>b<td>c", "<table><tr><td>d<td>e<td>f"
    df = spark.createDataFrame([(1, one), (1, one), (1, two), (None, one), (None, None)], "law_id long, html string").repartition(3)
    got = sorted((r.law_id or 0, r.c0) for r in shred_rows(df).collect())
    assert got == [(0, "a"), (1, "a"), (1, "d")]
    assert shred_rows(df.filter("false")).count() == 0


def test_links_in_any_quoting(spark):
    from lexframe.operators.shred import page_links
    html = ("<nav><a href='no.html'>no</a></nav><nav class=x id='acts'><a href=\"a.html\">A</a><a class='k' href='b.html'>B &amp; &eacute;"
            "<a href=c.html>C</a><a data-href='x.html' name=q>D</a></nav><a href='e.html'>E</a>")
    df = raw_pages(spark, html)
    assert [(r.name, r.href) for r in page_links(df, key="law_id", element_id="acts").orderBy("link_no").collect()] == [
        ("A", "a.html"), ("B & é", "b.html"), ("C", "c.html")]
    assert [r.name for r in page_links(df, key="law_id").collect()] == ["no"]


def test_cell_text_without_end_tags(spark):
    df = raw_pages(spark, "<table><tr><td>a<td>b</td><td class='x'>c\n<tr><td>d</table><p>e")
    assert df.select(joined_cell_text(df.html, "td").alias("t")).first().t == "a b c  d"


def test_references_decode_like_html_unescape(spark):
    import html as h
    texts = [f"x&{n}y &{n} z" for n in sorted(h.entities.html5)[::7]] + [f"&#{n};&#x{n:x} &#{n}" for n in (0, 9, 38, 128, 159, 0xD800, 0xFFFE, 0x1F642, 0x110000)]
    texts += ["", "&", "&&amp;lt;", "&#;&#x;", "no reference", "&notit; &copyright"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.d for r in df.select("i", decode_references("t").alias("d")).collect()}
    assert got == {i: h.unescape(t) for i, t in enumerate(texts)}
