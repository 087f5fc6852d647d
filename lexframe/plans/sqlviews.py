"""DuckDB text of the stand-in views, written independently of the Spark code.

Plain windows over whole acts (DuckDB runs the oracle on small data); the
Spark side computes the same values with chunked running aggregates.
RE2 has no ``(?U)``; the test tables hold no non-ASCII white space or
digits at the places the patterns look, so ASCII classes agree there.
"""

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


# documents -> (law_id, row_no, c1, c2)
STATUTE_ROWS = r"""
sr_lines AS (
  SELECT doc_id, line, pos FROM (
    SELECT doc_id, unnest(string_split(text, '. ')) AS line,
           generate_subscripts(string_split(text, '. '), 1) AS pos
    FROM documents)
  WHERE regexp_matches(line, '\S')
),
sr_body AS (
  SELECT doc_id AS law_id, CAST(pos AS BIGINT) AS row_no,
         CASE WHEN (pos + doc_id) % 12 = 1 THEN split_part(line, ' ', 1) ELSE '' END AS c1,
         regexp_replace(
           CASE (pos + doc_id) % 12
             WHEN 0 THEN 'PART ' || pos || ' '
             WHEN 1 THEN pos || '.—'
             WHEN 2 THEN '(1) '
             WHEN 3 THEN '(a) '
             WHEN 4 THEN '(i) '
             WHEN 5 THEN ''
             WHEN 6 THEN '(2) '
             WHEN 7 THEN '(c) '
             WHEN 8 THEN 'SCHEDULE ' || pos || ' '
             WHEN 9 THEN 'Article 9 '
             WHEN 10 THEN '(3) '
             ELSE 'CHAPTER 2 ' END || line,
           '^\s+|\s+$', '', 'g') AS c2
  FROM sr_lines
),
statute_rows AS (
  SELECT doc_id AS law_id, CAST(-1 AS BIGINT) AS row_no, '' AS c1,
         'THE ' || upper(source) || CASE WHEN n_chars % 2 = 0 THEN ' ACT ' ELSE ' ORDER ' END
           || CAST(2000 + doc_id % 25 AS VARCHAR) AS c2
  FROM documents
  UNION ALL
  SELECT doc_id, CAST(0 AS BIGINT), '', 'BE IT ENACTED by the Oireachtas as follows:' FROM documents
  UNION ALL
  SELECT law_id, row_no, c1, c2 FROM sr_body
)"""

# statute_rows -> rows after the enacting row
GATED = r"""
gate_flag AS (
  SELECT *, max(CASE WHEN upper(c2) LIKE '%BE IT ENACTED%' OR upper(c2) LIKE '%HEREBY ENACTED%'
                     THEN 1 ELSE 0 END)
              OVER (PARTITION BY law_id ORDER BY row_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
  FROM statute_rows WHERE c2 IS NOT NULL AND c2 <> ''
),
gated AS (SELECT law_id, row_no, c1, c2 FROM gate_flag WHERE past = 1)"""

_P = {
    "part": r"(?s)^PART\s+(\w+)(.*)",
    "schedule": r"(?s)^SCHEDULE\s+(\w+)(.*)",
    "chapter": r"(?s)^CHAPTER\s+(\w+)(.*)",
    "article": r"(?s)^Article\s+(\d+)(.*)",
    "section": r"(?s)^(\d+)\s*[.—–]\s*(.*)",
    "subsection": r"(?s)^\((\d+)\)\s*(.*)",
    "paragraph": r"(?s)^\(([a-z]{1,3})\)\s*(.*)",
}


def _rule_case() -> str:
    whens = "\n".join(f"      WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in _P.items())
    return f"CASE\n{whens}\n    END"


def _group_case(g: int) -> str:
    whens = " ".join(f"WHEN '{n}' THEN regexp_extract(t, '{p}', {g})" for n, p in _P.items())
    return f"CASE rule {whens} END"


# gated -> classified (section_type, rank, raw_ref, node_title, node_text)
CLASSIFIED = rf"""
cl_t AS (SELECT *, {strip('c2')} AS t FROM {{src}}),
cl_r AS (SELECT *, {_rule_case()} AS rule FROM cl_t),
cl_g AS (SELECT *, {strip(_group_case(1))} AS g1, {strip(_group_case(2))} AS g2 FROM cl_r),
classified AS (
  SELECT law_id, row_no, c1, c2,
    CASE WHEN rule = 'paragraph' AND regexp_matches(g1, '^[ivxlcdm]+$') THEN 'subparagraph'
         ELSE rule END AS section_type,
    CASE rule WHEN 'schedule' THEN 'Schedule ' || g1 WHEN 'chapter' THEN 'Chapter ' || g1
              WHEN 'article' THEN 'Article ' || g1 ELSE g1 END AS raw_ref,
    CASE rule WHEN 'part' THEN 1 WHEN 'schedule' THEN 1 WHEN 'chapter' THEN 1
              WHEN 'section' THEN 2 WHEN 'article' THEN 2 WHEN 'subsection' THEN 3
              WHEN 'paragraph' THEN CASE WHEN regexp_matches(g1, '^[ivxlcdm]+$') THEN 5 ELSE 4 END
         END AS rank,
    CASE WHEN rule = 'section' THEN coalesce(c1, '')
         WHEN rule IN ('part', 'schedule', 'chapter', 'article') THEN g2
         WHEN rule IS NOT NULL THEN '' END AS node_title,
    CASE WHEN rule IN ('part', 'schedule', 'chapter', 'article') THEN ''
         WHEN rule IS NOT NULL THEN g2 ELSE c2 END AS node_text
  FROM cl_g
)"""

# classified -> sections (one row per node), plain windows per act
SECTIONS = r"""
sc_w AS (
  SELECT *,
    max(CASE WHEN rank = 1 THEN row_no END) OVER wx AS l1,
    max(CASE WHEN rank = 2 THEN row_no END) OVER wx AS l2,
    max(CASE WHEN rank = 3 THEN row_no END) OVER wx AS l3,
    max(CASE WHEN rank = 4 THEN row_no END) OVER wx AS l4,
    max(CASE WHEN section_type IN ('section', 'article', 'part', 'schedule') THEN row_no END) OVER wx AS ev,
    max(CASE WHEN section_type IS NOT NULL THEN row_no END) OVER wi AS grp
  FROM classified
  WINDOW wx AS (PARTITION BY law_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wi AS (PARTITION BY law_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sc_n AS (
  SELECT n.*,
    CASE WHEN n.section_type = 'subsection'
         THEN coalesce(CASE WHEN e.section_type IN ('section', 'article') THEN e.raw_ref END, '')
              || '(' || n.raw_ref || ')'
         ELSE n.raw_ref END AS section_ref,
    CASE n.rank WHEN 2 THEN n.l1 WHEN 3 THEN greatest(n.l1, n.l2)
                WHEN 4 THEN greatest(n.l1, n.l2, n.l3) WHEN 5 THEN greatest(n.l1, n.l2, n.l3, n.l4) END
      AS parent_seq
  FROM sc_w n LEFT JOIN sc_w e ON e.law_id = n.law_id AND e.row_no = n.ev
  WHERE n.section_type IS NOT NULL
),
sc_text AS (
  SELECT law_id, grp, coalesce(string_agg(nullif(node_text, ''), chr(10) ORDER BY row_no), '') AS text_content
  FROM sc_w WHERE grp IS NOT NULL GROUP BY law_id, grp
),
sections AS (
  SELECT n.law_id, CAST(n.row_no AS BIGINT) AS seq, n.section_type, n.section_ref,
         n.node_title AS section_title, t.text_content,
         CAST(row_number() OVER (PARTITION BY n.law_id, n.parent_seq ORDER BY n.row_no) AS BIGINT) AS position,
         CAST(n.parent_seq AS BIGINT) AS parent_seq, p.section_ref AS parent_ref, n.rank
  FROM sc_n n
  JOIN sc_text t ON t.law_id = n.law_id AND t.grp = n.row_no
  LEFT JOIN sc_n p ON p.law_id = n.law_id AND p.row_no = n.parent_seq
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def sections_sql() -> str:
    """CTE chain documents -> ... -> sections."""
    return with_(STATUTE_ROWS, GATED, CLASSIFIED.replace("{src}", "gated"), SECTIONS)


def decode(x: str) -> str:
    """DuckDB twin of ``functions.text.decode_entities``."""
    out = x
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{ent}', '{ch}')"
    return out


NOISE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"


def clean(x: str) -> str:
    return f"regexp_replace({x}, '{NOISE}', '', 'g')"


def pieces(x: str) -> str:
    """Stripped, non-empty text nodes of an HTML fragment (list)."""
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), "
            f"lambda p: {strip(decode('p'))}), lambda p: p <> '')")


def cell_text(x: str, sep: str = " ") -> str:
    return f"array_to_string({pieces(x)}, '{sep}')"


def element_re(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"


def element_list(x: str, tag: str) -> str:
    """Inner HTML of each ``<tag>`` (list); one ends at its closing tag or the next opening one."""
    return (rf"list_transform(regexp_split_to_array({x}, '(?i)<{tag}(?:\s[^>]*)?>')[2:], "
            rf"lambda e: regexp_replace(e, '(?is)</{tag}\s*>.*$', ''))")


# pages -> laws stand-in
LAWS = r"""
laws AS (
  SELECT page_id AS law_id,
    """ + strip(decode(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")) + r""" AS name,
    CAST(2000 + page_id % 25 AS INTEGER) AS year,
    CAST(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') AS INTEGER) AS act_number,
    url,
    CASE WHEN nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') IS NOT NULL THEN
      'raw_html/' || CAST(2000 + page_id % 25 AS VARCHAR) || '/act_'
      || CAST(CAST(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS INTEGER) AS VARCHAR) || '.html'
    END AS html_path
  FROM pages
)"""


EVALS = r"""
evals AS (
  SELECT CAST(u.conv_id * 100 + u.turn AS BIGINT) AS id, u.conv_id, u.text AS query_text, a.text AS llm_response,
    CASE WHEN a.text IS NOT NULL THEN list_transform(string_split(a.text, chr(10)),
                                                      lambda s: length(s) / 100.0) END AS scores,
    'unrated' AS rating, 5 AS top_k,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(u.conv_id * 60 + u.turn) AS created_at,
    CAST(NULL AS TIMESTAMP) AS rated_at
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
),
ratings AS (
  SELECT e.id, r.rating, r.arrival FROM (
    SELECT doc_id AS conv_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rating, 0 AS arrival FROM labels
    UNION ALL SELECT doc_id, 'bad', 1 FROM labels WHERE toxic = 1) r
  JOIN evals e ON e.conv_id = r.conv_id
),
rated AS (
  SELECT e.id, e.conv_id, e.query_text, e.llm_response, e.scores,
    coalesce(l.rating, e.rating) AS rating, e.top_k, e.created_at,
    CASE WHEN l.rating IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE e.rated_at END AS rated_at
  FROM evals e
  LEFT JOIN (SELECT id, arg_max(rating, arrival) AS rating FROM ratings
             WHERE rating IN ('good', 'bad') GROUP BY id) l ON l.id = e.id
)"""


REQUESTS = r"""
req AS (
  SELECT item_id AS req_id,
    coalesce(regexp_extract_all(lower(text), '[a-z]{3,}')[1], '') AS keyword,
    coalesce(regexp_extract_all(lower(text), '[a-z]{3,}')[2], '') AS name,
    CAST(CASE WHEN item_id % 3 = 0 THEN 2000 + item_id % 25 WHEN item_id % 3 = 1 THEN 0 END AS INTEGER) AS year,
    item_id AS law_id,
    CAST(item_id % 9 + 1 AS VARCHAR) AS section_ref
  FROM benchmark
)"""


TITLES = r"""
t_cand AS (
  SELECT law_id,
    min(CASE WHEN upper(c2) LIKE '%ENACTED%' THEN row_no END) AS stop,
    arg_min(c2, row_no) FILTER (WHERE c2 = upper(c2) AND c2 <> lower(c2) AND c2 LIKE '%ACT%') AS t,
    min(row_no) FILTER (WHERE c2 = upper(c2) AND c2 <> lower(c2) AND c2 LIKE '%ACT%') AS t_row
  FROM statute_rows GROUP BY law_id
),
titles AS (
  SELECT c.law_id,
    CASE WHEN t IS NOT NULL AND (stop IS NULL OR t_row < stop) THEN
      array_to_string(list_transform(regexp_extract_all(t, '(\pL+|\PL+)'),
                                     lambda x: upper(x[1]) || lower(x[2:])), '') END AS detected_title,
    coalesce(nullif(CASE WHEN t IS NOT NULL AND (stop IS NULL OR t_row < stop) THEN
      array_to_string(list_transform(regexp_extract_all(t, '(\pL+|\PL+)'),
                                     lambda x: upper(x[1]) || lower(x[2:])), '') END, ''),
      'Act ' || d.doc_id || ' of ' || CAST(2000 + d.doc_id % 25 AS VARCHAR)) AS name,
    CAST(2000 + d.doc_id % 25 AS INTEGER) AS year
  FROM t_cand c JOIN documents d ON d.doc_id = c.law_id
)"""

TOKEN_RE = r"([\pL\pM\p{Nd}\p{Pc}]+|[^\pL\pM\p{Nd}\p{Pc}\s])"

KNN_TOP = r"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS q_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM v q, v c
           WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM scored)"""
