"""Lookup group: search, law by name, sections, section by ref, tool calls,
source nodes, JSON lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as lk
from ..operators.toolcalls import dispatch
from ..sources import testdata as td
from .parse import sections
from .registry import register
from .sqlviews import LAWS, REQUESTS, SECTIONS, STATUTE_ROWS, GATED, CLASSIFIED, with_

_SECTIONS = with_(STATUTE_ROWS, GATED, CLASSIFIED.replace("{src}", "gated"), SECTIONS)


@register("search_laws", with_(LAWS, REQUESTS) + """
SELECT r.req_id, r.keyword, l.law_id, l.year, l.act_number,
       CAST(row_number() OVER (PARTITION BY r.req_id ORDER BY l.year, l.act_number, l.law_id) AS BIGINT) AS list_no
FROM req r JOIN laws l ON l.name ILIKE '%' || r.keyword || '%'""")
def q_search_laws(spark, sf):
    """SCL27/JN6/TOP6: every law whose name contains each request keyword, in its order."""
    hits = lk.search_laws(td.laws(spark, sf), td.requests(spark, sf).select("req_id", "keyword"))
    return hits.select("req_id", "keyword", "law_id", "year", "act_number", "list_no")


@register("law_by_name", with_(LAWS, REQUESTS) + """
, hits AS (
  SELECT r.req_id, arg_min(l.law_id, (l.year, l.act_number, l.law_id)) AS law_id
  FROM req r JOIN laws l ON l.name ILIKE '%' || r.name || '%'
    AND (r.year IS NULL OR r.year = 0 OR l.year = r.year)
  GROUP BY r.req_id)
SELECT r.req_id, r.name, r.year, h.law_id, l.year AS law_year, l.act_number
FROM req r LEFT JOIN hits h ON h.req_id = r.req_id LEFT JOIN laws l ON l.law_id = h.law_id""")
def q_law_by_name(spark, sf):
    """JN5/TOP5: at most one law per (name, optional year) request."""
    laws = td.laws(spark, sf).select("law_id", "name", "year", "act_number")
    out = lk.law_by_name(laws, td.requests(spark, sf).select("req_id", "name", "year"))
    return out.select("req_id", "name", "year", "law_id", "law_year", "act_number")


@register("law_sections", _SECTIONS + """
, req AS (SELECT item_id AS req_id, item_id * 5 AS law_id FROM benchmark)
SELECT r.req_id, s.law_id, s.seq, s.section_ref, s.position,
       CAST(row_number() OVER (PARTITION BY r.req_id ORDER BY s.position, s.seq) AS BIGINT) AS list_no
FROM req r JOIN sections s ON s.law_id = r.law_id""")
def q_law_sections(spark, sf):
    """JN3/TOP3: all sections of each requested law, by position then seq."""
    reqs = td.table(spark, sf, "benchmark").select(F.col("item_id").alias("req_id"),
                                                   (F.col("item_id") * 5).alias("law_id"))
    s = sections(spark, sf, with_text=False).select("law_id", "seq", "section_ref", "position")
    return lk.law_sections(s, reqs).select("req_id", "law_id", "seq", "section_ref", "position", "list_no")


@register("section_by_ref", _SECTIONS + "," + REQUESTS + """
, best AS (SELECT law_id, section_ref, min(seq) AS seq FROM sections GROUP BY law_id, section_ref)
SELECT r.req_id, r.law_id, r.section_ref, b.seq, s.section_type
FROM req r LEFT JOIN best b ON b.law_id = r.law_id AND b.section_ref = r.section_ref
LEFT JOIN sections s ON s.law_id = b.law_id AND s.seq = b.seq""")
def q_section_by_ref(spark, sf):
    """JN4/TOP5: first section with the ref in the law, NULL on a miss."""
    reqs = td.requests(spark, sf).select("req_id", "law_id", "section_ref")
    s = sections(spark, sf, with_text=False).select("law_id", "seq", "section_ref", "section_type")
    return lk.section_by_ref(s, reqs).select("req_id", "law_id", "section_ref", "seq", "section_type")


@register("tool_calls", with_(LAWS, REQUESTS) + "," + _SECTIONS[len("WITH "):] + """
, calls AS (
  SELECT req_id AS call_id,
    CASE req_id % 5 WHEN 0 THEN 'search_laws' WHEN 1 THEN 'get_law_by_name' WHEN 2 THEN 'get_law_sections'
                    WHEN 3 THEN 'get_section_by_ref' ELSE 'get_weather' END AS tool, *
  FROM req),
s AS (SELECT c.call_id, l.* FROM calls c
      JOIN laws l ON l.name ILIKE '%' || c.keyword || '%' WHERE c.tool = 'search_laws'),
n AS (SELECT c.call_id, arg_min(l.law_id, (l.year, l.act_number, l.law_id)) AS law_id FROM calls c
      JOIN laws l ON l.name ILIKE '%' || c.name || '%' AND (c.year IS NULL OR c.year = 0 OR l.year = c.year)
      WHERE c.tool = 'get_law_by_name' GROUP BY c.call_id),
ls AS (SELECT c.call_id, s.* FROM calls c JOIN sections s ON s.law_id = c.law_id WHERE c.tool = 'get_law_sections'),
rb AS (SELECT law_id, section_ref, min(seq) AS seq FROM sections GROUP BY law_id, section_ref)
SELECT call_id, 'search_laws' AS tool, CAST(law_id AS BIGINT) AS law_id, CAST(NULL AS BIGINT) AS seq,
       to_json(struct_pack(law_id := law_id, name := name, year := year, act_number := act_number,
                           url := url, html_path := html_path))::VARCHAR AS result
FROM s
UNION ALL
SELECT call_id, 'search_laws', NULL, NULL, '[]' FROM calls c
WHERE tool = 'search_laws' AND NOT EXISTS (SELECT 1 FROM s WHERE s.call_id = c.call_id)
UNION ALL
SELECT c.call_id, 'get_law_by_name', n.law_id, NULL,
  CASE WHEN n.law_id IS NULL THEN 'null' ELSE
    to_json(struct_pack(law_id := l.law_id, name := l.name, year := l.year, act_number := l.act_number,
                        url := l.url, html_path := l.html_path))::VARCHAR END
FROM calls c LEFT JOIN n ON n.call_id = c.call_id LEFT JOIN laws l ON l.law_id = n.law_id
WHERE c.tool = 'get_law_by_name'
UNION ALL
SELECT call_id, 'get_law_sections', law_id, seq,
  to_json(struct_pack(seq := seq, section_type := section_type, section_ref := section_ref, section_title := section_title,
                      text_content := text_content, position := position))::VARCHAR FROM ls
UNION ALL
SELECT call_id, 'get_law_sections', law_id, NULL, '[]' FROM calls c
WHERE tool = 'get_law_sections' AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.call_id = c.call_id)
UNION ALL
SELECT c.call_id, 'get_section_by_ref', c.law_id, rb.seq,
  CASE WHEN rb.seq IS NULL THEN 'null' ELSE
    to_json(struct_pack(seq := s.seq, section_type := s.section_type, section_ref := s.section_ref, section_title := s.section_title,
                        text_content := s.text_content, position := s.position))::VARCHAR END
FROM calls c LEFT JOIN rb ON rb.law_id = c.law_id AND rb.section_ref = c.section_ref
LEFT JOIN sections s ON s.law_id = rb.law_id AND s.seq = rb.seq
WHERE c.tool = 'get_section_by_ref'
UNION ALL
SELECT call_id, tool, NULL, NULL, '{"error":"Unknown tool: ' || tool || '"}' FROM calls
WHERE tool NOT IN ('search_laws', 'get_law_by_name', 'get_law_sections', 'get_section_by_ref')""")
def q_tool_calls(spark, sf):
    """JN12/SCL24: a batch of tool calls dispatched to the four lookups."""
    laws = td.laws(spark, sf)
    s = sections(spark, sf)
    return dispatch(td.tool_calls(spark, sf), laws, s)


_MSG = r"""
WITH msg AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'assistant' THEN to_json([{'type': 'text', 'text': text}])::VARCHAR
         WHEN role = 'user' AND turn > 0 THEN to_json([{'type': 'tool_result',
              'tool_use_id': 't' || conv_id || '_' || turn,
              'content': CASE turn % 3
                 WHEN 1 THEN '[' || to_json({'law_id': conv_id, 'text_content': text})::VARCHAR || ','
                                 || to_json({'law_id': conv_id + 1, 'name': 'n' || turn})::VARCHAR || ']'
                 WHEN 2 THEN to_json({'name': split_part(text, ' ', 1), 'year': 2000 + turn})::VARCHAR
                 ELSE 'not json' END}])::VARCHAR
         ELSE text END AS content
  FROM conversations
),
blocks AS (
  SELECT conv_id, turn, b.i - 1 AS block_no, b.blk
  FROM (SELECT conv_id, turn, content FROM msg
        WHERE role = 'user' AND json_valid(content) AND json_type(content) = 'ARRAY') m,
  LATERAL (SELECT unnest(range(1, json_array_length(m.content)::BIGINT + 1)) AS i,
                  json_extract(m.content, '$[' || (unnest(range(1, json_array_length(m.content)::BIGINT + 1)) - 1) || ']') AS blk) b
),
raw AS (SELECT conv_id, turn, block_no, blk->>'$.content' AS raw FROM blocks WHERE blk->>'$.type' = 'tool_result'),
items AS (
  SELECT conv_id, turn, block_no, 0 AS item_no, raw::JSON AS item FROM raw
  WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'
  UNION ALL
  SELECT conv_id, turn, block_no, i - 1, json_extract(raw, '$[' || (i - 1) || ']')
  FROM (SELECT *, unnest(range(1, json_array_length(raw)::BIGINT + 1)) AS i FROM raw
        WHERE json_valid(raw) AND json_type(raw) = 'ARRAY')
)
SELECT conv_id, turn, CAST(block_no AS INTEGER) AS block_no, CAST(item_no AS INTEGER) AS item_no,
  coalesce(nullif(item->>'$.text_content', ''), nullif(item->>'$.name', ''), item::VARCHAR) AS text,
  0.0::DOUBLE AS score,
  array_to_string(list_sort(list_filter(json_keys(item), lambda k: k <> 'text_content')), ',') AS meta_keys
FROM items WHERE json_type(item) = 'OBJECT'"""


@register("source_nodes", _MSG)
def q_source_nodes(spark, sf):
    """TXT1: source nodes from tool results in the message history."""
    n = lk.source_nodes(td.messages(spark, sf))
    return n.select("conv_id", "turn", "block_no", "item_no", "text", "score",
                    F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("meta_keys"))


@register("json_list", """
SELECT event_id, CAST(len(coalesce(from_json(raw, '[{"k": "BIGINT"}]'), [])) AS INTEGER) AS n_items,
       coalesce(from_json(raw, '[{"k": "BIGINT"}]'), [])[1].k AS first_k
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '[]'
                            ELSE '[' || props || ']' END AS raw FROM events)""")
def q_json_list(spark, sf):
    """SCL23: JSON list text or NULL or an empty list -> array (events' props)."""
    ev = td.table(spark, sf, "events")
    raw = (F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
            .when(F.col("event_type") == "view", F.lit("[]"))
            .otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]"))))
    arr = lk.json_list(raw, "struct<k:bigint>")
    return ev.select("event_id", F.size(arr).alias("n_items"), F.try_element_at(arr, F.lit(1))["k"].alias("first_k"))
