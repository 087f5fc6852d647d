"""

The test tables are not statute pages, so each corpus table of the reference
is derived from one of them, deterministically and over the whole table:

* ``laws``          <- ``pages``: id, ``<title>`` as name, year and act number
* ``statute_rows``  <- ``documents``: the marked-line view; every sentence is
  a row, prefixed by a marker chosen by ``(seq + doc_id) % 12``, after a title
  row and an enacting row per document
* ``eval_results``  <- ``conversations``: each user turn with the next
  assistant turn
* ``vectors``       <- ``embeddings``; questions are the vectors whose id is a
  ``benchmark`` item (the question list)
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities, is_blank, strip_ws

# ---- fixed values: line markers of the marked-line view, by (seq+doc_id)%12 --
# "{seq}" is replaced by the line number; 5 leaves the line unmarked.
LINE_MARKERS = ("PART {seq} ", "{seq}.—", "(1) ", "(a) ", "(i) ", "",
                "(2) ", "(c) ", "SCHEDULE {seq} ", "Article 9 ", "(3) ", "CHAPTER 2 ")
ENACTING_ROW = "BE IT ENACTED by the Oireachtas as follows:"
FIRST_YEAR = 2000
YEAR_SPAN = 25


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table as a DataFrame.  The files never change, so one
    DataFrame per (session, path) is kept: its schema is read once, not at
    every reference (a plan object, no data is cached)."""
    key = (id(spark), f"{sf_dir}/{name}.parquet")
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(key[1])
    return df


def _marker(seq, key):
    """The marker of line ``seq``; NULL where the remainder is none of the twelve."""
    template = F.get(F.array(*[F.lit(t) for t in LINE_MARKERS]), (seq + key) % 12)
    return F.replace(template, F.lit("{seq}"), seq.cast("string"))


def statute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(law_id, row_no, c1, c2)`` rows of every document (marked-line view).

    Row -1 is an upper-case title row (``ACT`` only for even ``n_chars``, so
    both detection and the fallback name occur), row 0 the enacting row, rows
    1.. the non-blank sentences (split on ``". "``) with their markers.  The
    section-title cell ``c1`` holds the first word on section rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    year = (F.lit(FIRST_YEAR) + F.col("doc_id") % YEAR_SPAN).cast("string")
    title = F.concat(F.lit("THE "), F.upper(F.col("source")),
                     F.when(F.col("n_chars") % 2 == 0, F.lit(" ACT ")).otherwise(F.lit(" ORDER ")), year)
    # one scan: [title, enacting row, sentence 1, sentence 2, ...]
    parts = F.concat(F.array(title, F.lit(ENACTING_ROW)), F.split(F.col("text"), r"\. "))
    x = docs.select("doc_id", F.posexplode(parts).alias("pos", "line"))
    x = x.filter((F.col("pos") < 2) | ~is_blank(F.col("line")))
    seq = (F.col("pos") - 1).cast("bigint")
    body = seq >= 1
    marked = F.when(body, F.concat(_marker(seq, F.col("doc_id")), F.col("line"))).otherwise(F.col("line"))
    # a generated column is computed once: a later filter on c2 would repeat the whole expression
    x = x.select("doc_id", "pos", "line", F.explode(F.array(marked)).alias("marked"))
    return x.select(
        F.col("doc_id").alias("law_id"),
        seq.alias("row_no"),
        F.when(body & ((seq + F.col("doc_id")) % 12 == 1), F.split_part(F.col("line"), F.lit(" "), F.lit(1)))
         .otherwise(F.lit("")).alias("c1"),
        strip_ws("marked").alias("c2"))


def doc_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law keys of the marked-line documents: ``(law_id, year, act_number)``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("law_id"),
                       (F.lit(FIRST_YEAR) + F.col("doc_id") % YEAR_SPAN).cast("int").alias("year"),
                       F.col("doc_id").cast("int").alias("act_number"))


def page_title(html) -> "F.Column":
    return strip_ws(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``laws`` stand-in from ``pages``.

    ``law_id=page_id``, name = page ``<title>``, ``year = 2000 + page_id % 25``,
    ``act_number`` = the number in the URL path, ``html_path`` the raw-page
    path it would be stored under.
    """
    pages = table(spark, sf_dir, "pages")
    year = (F.lit(FIRST_YEAR) + F.col("page_id") % YEAR_SPAN).cast("int")
    num = F.regexp_extract(F.col("url"), r"/[a-z]{2}/([0-9]+)", 1)
    act = F.when(num != "", num.cast("int"))
    return pages.select(
        F.col("page_id").alias("law_id"),
        page_title(F.col("html")).alias("name"),
        year.alias("year"),
        act.alias("act_number"),
        F.col("url"),
        F.when(act.isNotNull(), F.format_string("raw_html/%d/act_%d.html", year, act)).alias("html_path"))


EVAL_EPOCH = "2024-01-01 00:00:00"


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_results`` stand-in: each user turn with the next assistant turn.

    ``id = conv_id * 100 + turn``; the answer is the assistant text of turn
    ``turn + 1`` (equi-join on (conv_id, turn), so a long conversation never
    becomes one window partition); ``scores`` are the answer's sentence
    lengths / 100; rows start ``unrated``.
    """
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").alias("u")
    a = conv.filter(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1), "left")
    scores = F.transform(F.split(F.col("a.text"), "\n"), lambda s: F.length(s).cast("double") / 100.0)
    return j.select(
        (F.col("u.conv_id") * 100 + F.col("u.turn")).cast("bigint").alias("id"),
        F.col("u.conv_id").alias("conv_id"),
        F.col("u.text").alias("query_text"),
        F.col("a.text").alias("llm_response"),
        F.when(F.col("a.text").isNotNull(), scores).alias("scores"),
        F.lit("unrated").alias("rating"),
        F.lit(5).alias("top_k"),
        (F.to_timestamp_ntz(F.lit(EVAL_EPOCH)) + F.make_dt_interval(secs=F.col("u.conv_id") * 60 + F.col("u.turn")))
        .alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("rated_at"))


def ratings_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings from ``labels``: every answer of a labelled conversation gets
    ``good`` (quality 1) or ``bad``; toxic ones are rated ``bad`` again later
    (arrival 1 after 0), so the last rating wins."""
    lab = table(spark, sf_dir, "labels")
    ev = eval_results(spark, sf_dir).select("id", "conv_id")
    first = lab.select(F.col("doc_id").alias("conv_id"),
                       F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("bad")).alias("rating"),
                       F.lit(0).alias("arrival"))
    second = lab.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("conv_id"), F.lit("bad").alias("rating"),
                                                    F.lit(1).alias("arrival"))
    return first.unionByName(second).join(ev, "conv_id").select("id", "rating", "arrival")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup requests, one per ``benchmark`` item (the question list).

    ``keyword``: first run of 3+ ASCII letters of the lower-cased question;
    ``name``: the second such run; ``year``: set, 0 or NULL by ``item_id % 3``;
    ``law_id = item_id`` and ``section_ref = item_id % 9 + 1`` for section
    lookups.
    """
    b = table(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z]{3,}"), 0)
    year = (F.when(F.col("item_id") % 3 == 0, F.lit(FIRST_YEAR) + F.col("item_id") % YEAR_SPAN)
             .when(F.col("item_id") % 3 == 1, F.lit(0)))
    return b.select(F.col("item_id").alias("req_id"),
                    F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("keyword"),
                    F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("name"),
                    year.cast("int").alias("year"),
                    F.col("item_id").alias("law_id"),
                    (F.col("item_id") % 9 + 1).cast("string").alias("section_ref"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent message history stand-in from ``conversations``.

    Assistant turns hold a text block list; system turns and the first user
    turn plain text; later user turns one ``tool_result`` block whose content
    is, by ``turn % 3``: a JSON list of two items (1), one object (2), or text
    that is not JSON (0).
    """
    c = table(spark, sf_dir, "conversations")
    item1 = F.to_json(F.struct(F.col("conv_id").alias("law_id"), F.col("text").alias("text_content")))
    item2 = F.to_json(F.struct((F.col("conv_id") + 1).alias("law_id"),
                               F.concat(F.lit("n"), F.col("turn").cast("string")).alias("name")))
    obj = F.to_json(F.struct(F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("name"),
                             (F.lit(FIRST_YEAR) + F.col("turn")).alias("year")))
    inner = (F.when(F.col("turn") % 3 == 1, F.concat(F.lit("["), item1, F.lit(","), item2, F.lit("]")))
              .when(F.col("turn") % 3 == 2, obj).otherwise(F.lit("not json")))
    tool = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"),
                                      F.format_string("t%d_%d", F.col("conv_id"), F.col("turn")).alias("tool_use_id"),
                                      inner.alias("content"))))
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    content = (F.when(F.col("role") == "assistant", text)
                .when((F.col("role") == "user") & (F.col("turn") > 0), tool)
                .otherwise(F.col("text")))
    return c.select("conv_id", "turn", "role", content.alias("content"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls stand-in: one per request, tool by ``item_id % 5`` (4 is a
    tool nobody knows), JSON arguments built from the request."""
    r = requests(spark, sf_dir)
    k = F.col("req_id") % 5
    tool = (F.when(k == 0, "search_laws").when(k == 1, "get_law_by_name").when(k == 2, "get_law_sections")
             .when(k == 3, "get_section_by_ref").otherwise("get_weather"))
    args = (F.when(k == 0, F.to_json(F.struct(F.col("keyword").alias("query"))))
             .when(k == 1, F.to_json(F.struct("name", "year")))
             .when(k == 2, F.to_json(F.struct("law_id")))
             .when(k == 3, F.to_json(F.struct("law_id", "section_ref")))
             .otherwise(F.to_json(F.struct(F.col("keyword").alias("city")))))
    return r.select(F.col("req_id").alias("call_id"), tool.alias("tool"), args.alias("args"))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(law_id, html)``: every page's article paragraphs as the rows of a carelessly
    written table.  By the paragraph's number modulo 4: no end tags; capitals, references
    and a tag in quotes; a nested table with text after it; two cells, a comment and a
    script that hold tags.  Odd pages do not close the table."""
    from ..operators.shred import clean_html, elements, first_block
    p = table(spark, sf_dir, "pages")
    texts = F.transform(elements(first_block(clean_html(F.col("html")), "article"), "p"),
                        lambda x: F.regexp_replace(x, r"<[^>]*>", ""))

    def row(t, i):
        n = i.cast("string")
        say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
        return (F.when(i % 4 == 0, say("<tr><td>", n, "<td class='a > b'>T", n, "<td>", t))
                .when(i % 4 == 1, say("<TR><TD>", n, "</TD><td>&#84;", n, "</td><td title=\"<td>\"><b>", t, "</b> &eacute;&#8212;</td></TR>"))
                .when(i % 4 == 2, say("<tr><td>", n, "<td>T", n, "<td>", t, "<table><tr><td>x<td>y<td>z", n, "</table> tail"))
                .otherwise(say("<tr><td>", n, "<td>", t, "</tr><!-- <tr><td>no --><script>'<tr><td>no'</script>")))

    end = F.when(F.col("page_id") % 2 == 0, F.lit("</table><p>after</p><table><tr><td>q<td>q<td>q</table>")).otherwise(F.lit(""))
    html = F.concat(F.lit("<p>before</p><table id=main>"), F.array_join(F.transform(texts, row), "\n"), end)
    return p.select(F.col("page_id").alias("law_id"), html.alias("html"))
