"""Parse group: statute rows -> typed, nested section rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.classify import act_titles, classify_rows, enactment_gate
from ..operators.hierarchy import build_sections, parent_by_ref
from ..operators.quality import PREVIEW_CHARS, bad_types, dup_refs, structure_preview, structure_profile
from ..sources import testdata as td
from .registry import register
from .sqlviews import CLASSIFIED, GATED, STATUTE_ROWS, sections_sql, with_


def sections(spark, sf, with_breadcrumb=False, with_text=True, text_chars=None, with_title=True):
    """The section table; ``with_text=False`` for structure-only queries
    (the corpus text is then never materialized or shuffled), ``text_chars``
    for those that need the start of each text only, ``with_title=False`` for
    those that read no titles."""
    rows = td.statute_rows(spark, sf)
    return build_sections(rows, with_breadcrumb=with_breadcrumb, with_text=with_text, text_chars=text_chars, with_title=with_title)


@register("enactment_gate", with_(STATUTE_ROWS, GATED) + """
SELECT law_id, count(*) AS n_rows, min(row_no) AS first_row, max(row_no) AS last_row
FROM gated GROUP BY law_id""")
def q_enactment_gate(spark, sf):
    """WIN5/SCL17: rows kept after the enacting row, per act."""
    g = enactment_gate(td.statute_rows(spark, sf))
    return g.groupBy("law_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


@register("classify_rows", with_(STATUTE_ROWS, CLASSIFIED.replace("{src}", "statute_rows")) + """
SELECT law_id, row_no, section_type, raw_ref, CAST(rank AS INTEGER) AS rank, node_title, node_text
FROM classified""")
def q_classify_rows(spark, sf):
    """SCL18/SCL20 on every row (no gate): type, raw ref, rank, title, text."""
    c = classify_rows(td.statute_rows(spark, sf))
    return c.select("law_id", "row_no", "section_type", "raw_ref", "rank", "node_title", "node_text")


@register("act_title", with_(STATUTE_ROWS) + r"""
, cand AS (
  SELECT law_id,
    min(CASE WHEN upper(c2) LIKE '%ENACTED%' THEN row_no END) AS stop,
    arg_min(c2, row_no) FILTER (WHERE c2 = upper(c2) AND c2 <> lower(c2) AND c2 LIKE '%ACT%') AS t,
    min(row_no) FILTER (WHERE c2 = upper(c2) AND c2 <> lower(c2) AND c2 LIKE '%ACT%') AS t_row
  FROM statute_rows GROUP BY law_id
), titled AS (
  SELECT law_id,
    CASE WHEN t IS NOT NULL AND (stop IS NULL OR t_row < stop) THEN
      array_to_string(list_transform(regexp_extract_all(t, '(\pL+|\PL+)'),
                                     lambda x: upper(x[1]) || lower(x[2:])), '')
    END AS detected_title
  FROM cand
)
SELECT t.law_id, t.detected_title,
  coalesce(nullif(t.detected_title, ''),
           'Act ' || d.doc_id || ' of ' || CAST(2000 + d.doc_id % 25 AS VARCHAR)) AS name
FROM titled t JOIN documents d ON d.doc_id = t.law_id""")
def q_act_title(spark, sf):
    """SCL14/SCL15/WIN6: detected title, else ``Act {n} of {year}``."""
    t = act_titles(td.statute_rows(spark, sf))
    keys = td.doc_laws(spark, sf)
    j = t.join(keys, "law_id")
    name = F.coalesce(F.nullif(F.col("detected_title"), F.lit("")),
                      F.format_string("Act %d of %d", F.col("act_number"), F.col("year")))
    return j.select("law_id", "detected_title", name.alias("name"))


@register("section_rows", sections_sql() + """
SELECT law_id, seq, section_type, section_ref, section_title, text_content, position, parent_seq, parent_ref
FROM sections""")
def q_section_rows(spark, sf):
    """AGG4/SCL20 + WIN1-4: the full section table."""
    return sections(spark, sf)


@register("section_tree", sections_sql() + """
SELECT law_id, seq, section_type, section_ref, position, parent_seq, parent_ref FROM sections""")
def q_section_tree(spark, sf):
    """WIN1/WIN2/JN2: structure only (no text)."""
    return sections(spark, sf, with_text=False, with_title=False).select("law_id", "seq", "section_type", "section_ref", "position",
                                      "parent_seq", "parent_ref")


@register("compound_ref", sections_sql() + """
SELECT law_id, seq, section_ref, parent_ref FROM sections WHERE section_type = 'subsection'""")
def q_compound_ref(spark, sf):
    """SCL19/WIN3: subsection refs ``{section}({n})``."""
    s = sections(spark, sf, with_text=False, with_title=False)
    return s.filter(F.col("section_type") == "subsection").select("law_id", "seq", "section_ref", "parent_ref")


@register("parent_by_ref", sections_sql() + """
, last_ref AS (SELECT law_id, section_ref, max(seq) AS parent_by_ref FROM sections
               WHERE section_ref IS NOT NULL AND section_ref <> '' GROUP BY law_id, section_ref)
SELECT s.law_id, s.seq, s.parent_ref, s.parent_seq, l.parent_by_ref
FROM sections s LEFT JOIN last_ref l ON l.law_id = s.law_id AND l.section_ref = s.parent_ref""")
def q_parent_by_ref(spark, sf):
    """JN1/AGG3: parent id by ref text, last row with that ref wins."""
    return parent_by_ref(sections(spark, sf, with_text=False, with_title=False)).select("law_id", "seq", "parent_ref", "parent_seq",
                                                     "parent_by_ref")


@register("breadcrumb", (sections_sql() + """
, anc AS (
  SELECT law_id, seq AS node, seq, parent_seq, section_ref, 0 AS d FROM sections
  UNION ALL
  SELECT a.law_id, a.node, p.seq, p.parent_seq, p.section_ref, a.d + 1
  FROM anc a JOIN sections p ON p.law_id = a.law_id AND p.seq = a.parent_seq
)
SELECT law_id, node AS seq, CAST(count(*) - 1 AS BIGINT) AS depth,
       coalesce(string_agg(section_ref, ' > ' ORDER BY d DESC) FILTER (WHERE d > 0), '') AS breadcrumb
FROM anc GROUP BY law_id, node""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_breadcrumb(spark, sf):
    """WIN10: ancestor refs of every node, outermost first."""
    s = sections(spark, sf, with_breadcrumb=True, with_text=False, with_title=False)
    depth = F.when(F.col("breadcrumb") == "", F.lit(0)).otherwise(
        F.size(F.split(F.col("breadcrumb"), " > "))).cast("bigint")
    return s.select("law_id", "seq", depth.alias("depth"), "breadcrumb")


@register("structure_profile", sections_sql() + """
SELECT law_id, count(*) AS n_nodes,
  count(*) FILTER (WHERE section_type = 'part') AS n_part,
  count(*) FILTER (WHERE section_type = 'schedule') AS n_schedule,
  count(*) FILTER (WHERE section_type = 'chapter') AS n_chapter,
  count(*) FILTER (WHERE section_type = 'article') AS n_article,
  count(*) FILTER (WHERE section_type = 'section') AS n_section,
  count(*) FILTER (WHERE section_type = 'subsection') AS n_subsection,
  count(*) FILTER (WHERE section_type = 'paragraph') AS n_paragraph,
  count(*) FILTER (WHERE section_type = 'subparagraph') AS n_subparagraph,
  max(CASE WHEN seq_rank = 1 THEN preview END) AS first_node
FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY seq) AS seq_rank,
        '[' || section_type || '] ' || section_ref ||
        CASE WHEN section_title <> '' THEN ' — ' || section_title ELSE '' END AS preview
      FROM sections)
GROUP BY law_id""")
def q_structure_profile(spark, sf):
    """AGG2/TOP4: node counts per type and the first node of each act."""
    return structure_profile(sections(spark, sf, with_text=False), preview_rows=1)


@register("structure_preview", sections_sql() + r"""
, n AS (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY seq) AS list_no, count(*) OVER (PARTITION BY law_id) AS n_nodes,
          replace(left(text_content, 60), chr(10), ' ') AS t FROM sections)
SELECT law_id, list_no,
  repeat('  ', CASE section_type WHEN 'chapter' THEN 1 WHEN 'section' THEN 1 WHEN 'article' THEN 1 WHEN 'subsection' THEN 2
                                 WHEN 'paragraph' THEN 3 WHEN 'subparagraph' THEN 4 ELSE 0 END)
  || '[' || section_type || '] ' || section_ref || CASE WHEN section_title <> '' THEN ' — ' || section_title ELSE '' END || '  |  '
  || CASE WHEN contains(t, chr(39)) AND NOT contains(t, '"') THEN '"' || e || '"'
          ELSE chr(39) || replace(e, chr(39), chr(92) || chr(39)) || chr(39) END AS line,
  greatest(n_nodes - 80, 0) AS n_more
FROM (SELECT *, replace(replace(t, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't') AS e FROM n) WHERE list_no <= 80""")
def q_structure_preview(spark, sf):
    """AGG2/TOP4: the first 80 nodes of each act, indented, with the start of their text."""
    return structure_preview(sections(spark, sf, text_chars=PREVIEW_CHARS))


@register("dup_refs", sections_sql() + """
SELECT law_id, section_type, section_ref, count(*) AS n
FROM sections WHERE section_type IN ('part', 'schedule', 'chapter')
GROUP BY law_id, section_type, section_ref HAVING count(*) > 1""")
def q_dup_refs(spark, sf):
    """AGG6: duplicate heading refs within an act (data-quality check)."""
    return dup_refs(sections(spark, sf, with_text=False, with_title=False), types=("part", "schedule", "chapter"))


@register("bad_types", sections_sql() + """
SELECT section_type, count(*) AS n,
  section_type IN ('act', 'part', 'section', 'subsection', 'paragraph', 'subparagraph',
                   'schedule', 'chapter', 'article') AS valid
FROM sections GROUP BY section_type""")
def q_bad_types(spark, sf):
    """Set membership of node types (anti-join on the valid list), as counts."""
    return bad_types(sections(spark, sf, with_text=False, with_title=False))
