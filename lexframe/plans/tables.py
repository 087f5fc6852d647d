"""Tables group: upsert, replace, ratings, appends, cascade delete, run summary."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.quality import status_summary
from ..sinks import tables as snk
from ..sources import testdata as td
from ..sources.jsonl import keyed_items, parse_json_lines
from .acquire import SCRAPED, scraped_lines
from .parse import sections
from .registry import register
from .sqlviews import EVALS, LAWS, sections_sql, with_

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 6, 1)


def old_laws(spark, sf):
    laws = td.laws(spark, sf)
    return laws.filter(F.col("url").startswith("https")).withColumn(
        "created_at", F.lit(T0).cast("timestamp_ntz"))


def law_batch(spark, sf):
    """Every page again: name gains its year, URLs with a query string are
    missing (NULL keeps the stored one)."""
    laws = td.laws(spark, sf)
    return laws.select(
        "law_id", F.concat(F.col("name"), F.lit(" Act "), F.col("year").cast("string")).alias("name"),
        "year", "act_number",
        F.when(F.col("url").contains("?"), F.lit(None).cast("string")).otherwise(F.col("url")).alias("url"),
        "html_path")


@register("upsert_laws", with_(LAWS) + """
, old AS (SELECT * FROM laws WHERE url LIKE 'https%'),
b AS (SELECT law_id AS arrival, name || ' Act ' || CAST(year AS VARCHAR) AS name, year, act_number,
             CASE WHEN url LIKE '%?%' THEN NULL ELSE url END AS url, html_path FROM laws),
bk AS (SELECT year, act_number, arg_max(name, arrival) AS name,
              arg_max(url, arrival) FILTER (WHERE url IS NOT NULL) AS url,
              arg_max(html_path, arrival) FILTER (WHERE html_path IS NOT NULL) AS html_path
       FROM b WHERE act_number IS NOT NULL GROUP BY year, act_number)
SELECT coalesce(o.law_id, CAST(bk.year AS BIGINT) * 100000 + bk.act_number) AS law_id,
       coalesce(bk.name, o.name) AS name, coalesce(o.year, bk.year) AS year,
       coalesce(o.act_number, bk.act_number) AS act_number,
       coalesce(bk.url, o.url) AS url, coalesce(bk.html_path, o.html_path) AS html_path,
       CASE WHEN o.law_id IS NULL THEN 'inserted' ELSE 'kept' END AS origin
FROM old o FULL OUTER JOIN bk ON o.year = bk.year AND o.act_number = bk.act_number""")
def q_upsert_laws(spark, sf):
    """SNK2/SCL16: upsert on (year, act_number) into the https-page laws."""
    old = old_laws(spark, sf)
    merged = snk.upsert_laws(old, law_batch(spark, sf), arrival="law_id", now=T1)
    return merged.select("law_id", "name", "year", "act_number", "url", "html_path",
                         F.when(F.col("created_at") == F.lit(T0).cast("timestamp_ntz"), F.lit("kept"))
                          .otherwise(F.lit("inserted")).alias("origin"))


@register("replace_sections", sections_sql() + """
SELECT s.law_id, s.seq, s.section_type, s.section_ref, 'old' AS origin FROM sections s
WHERE s.law_id NOT IN (SELECT d.doc_id FROM documents d WHERE d.lang = 'en')
UNION ALL
SELECT s.law_id, s.seq, s.section_type, s.section_ref, 'new' FROM sections s
JOIN documents d ON d.doc_id = s.law_id AND d.lang = 'en' WHERE s.text_content <> ''""")
def q_replace_sections(spark, sf):
    """SNK3: re-ingested laws (English documents, rebuilt without empty-text
    nodes) replace all their old rows; other laws stay."""
    s = sections(spark, sf).select("law_id", "seq", "section_type", "section_ref", "text_content")
    en = td.table(spark, sf, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("law_id"))
    batch = s.join(en, "law_id").filter(F.col("text_content") != "").withColumn("origin", F.lit("new"))
    old = s.withColumn("origin", F.lit("old"))
    return snk.replace_sections(old, batch, laws=en).drop("text_content")


@register("apply_ratings", with_(EVALS) + """
SELECT id, rating, rated_at FROM rated""")
def q_apply_ratings(spark, sf):
    """SNK9: ratings batch (from labels) applied by id, last one wins."""
    ev = td.eval_results(spark, sf)
    out = snk.apply_ratings(ev, td.ratings_batch(spark, sf), arrival="arrival", rated_at=T0)
    return out.select("id", "rating", "rated_at")


@register("eval_append", with_(EVALS) + r"""
, pend AS (
  SELECT b.item_id, regexp_replace(b.text, '^\s+|\s+$', '', 'g') AS query_text FROM benchmark b
  WHERE regexp_replace(b.text, '^\s+|\s+$', '', 'g') <> ''
    AND NOT EXISTS (SELECT 1 FROM evals e
                    WHERE regexp_replace(e.query_text, '^\s+|\s+$', '', 'g')
                          = regexp_replace(b.text, '^\s+|\s+$', '', 'g'))
)
SELECT CAST((SELECT max(id) FROM evals) + row_number() OVER (ORDER BY item_id) AS BIGINT) AS id,
       query_text, 'unrated' AS rating, TIMESTAMP '2024-06-01 00:00:00' AS created_at
FROM pend""")
def q_eval_append(spark, sf):
    """SNK6/JN7: pending benchmark questions appended with ids max(id)+1.."""
    ev = td.eval_results(spark, sf)
    bench = td.table(spark, sf, "benchmark").select("item_id", strip_ws("text").alias("query_text"))
    bench = bench.filter(F.col("query_text") != "")
    done = ev.select(strip_ws("query_text").alias("query_text"))
    pending = bench.join(done, "query_text", "left_anti")
    new = snk.append_evals(ev, pending, order="item_id", now=T1)
    return new.select("id", "query_text", "rating", "created_at")


@register("cascade_delete", sections_sql() + """
, gone AS (SELECT doc_id AS law_id FROM documents WHERE source IN ('src0', 'src1'))
SELECT 'laws' AS tbl, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id NOT IN (SELECT law_id FROM gone)
UNION ALL
SELECT 'law_sections', CAST(count(*) AS BIGINT) FROM sections WHERE law_id NOT IN (SELECT law_id FROM gone)""")
def q_cascade_delete(spark, sf):
    """SNK10: deleting the laws of two sources removes their sections too."""
    laws = td.doc_laws(spark, sf)
    s = sections(spark, sf, with_text=False)
    gone = td.table(spark, sf, "documents").filter(F.col("source").isin("src0", "src1")) \
             .select(F.col("doc_id").alias("law_id"))
    laws2, s2 = snk.cascade_delete(laws, s, gone)
    return laws2.agg(F.count(F.lit(1)).alias("n")).select(F.lit("laws").alias("tbl"), "n").unionByName(
        s2.agg(F.count(F.lit(1)).alias("n")).select(F.lit("law_sections").alias("tbl"), "n"))


@register("ingest_summary", with_(SCRAPED) + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY y, act_number, status = 'ok' ORDER BY page_id, kind) AS r FROM keyed)
SELECT CASE WHEN status = 'ok' AND r > 1 THEN 'skipped' ELSE status END AS status, CAST(count(*) AS BIGINT) AS n
FROM ranked GROUP BY 1""")
def q_ingest_summary(spark, sf):
    """AGG1: written / skipped / error counts of one JSON-lines extract run
    (same items as ``src_jsonl``; a second page for a key is skipped)."""
    items = keyed_items(parse_json_lines(scraped_lines(spark, sf), "value"))
    ok = items.filter(F.col("status") == "ok")
    first = snk.keep_first(ok.select("year_key", "act_number", "page_id"), ["year_key", "act_number"], "page_id")
    flagged = ok.join(first.select("page_id", F.lit(1).alias("_first")), "page_id", "left") \
                .select(F.when(F.col("_first").isNull(), F.lit("skipped")).otherwise(F.lit("ok")).alias("status"))
    errors = items.filter(F.col("status") != "ok").select("status")
    return status_summary(flagged.unionByName(errors))
