"""Acquire group: seeds, URL and path keys, links, JSON lines, raw-page store."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import slug
from ..operators.shred import joined_cell_text, page_body, page_links, shred_rows
from ..sinks.tables import keep_first, latest_per_key, write_once
from ..sources import testdata as td
from ..sources.jsonl import keyed_items, parse_json_lines
from ..sources.seed import year_seed_from
from .registry import register
from .sqlviews import LAWS, cell_text, clean, decode, element_list, element_re, strip, with_  # noqa: F401

BASE = "https://statutes.example.org"


def _laws(spark, sf):
    return td.laws(spark, sf)


def _eli(url_col, year_col):
    """ELI print URL of a page: host of the page URL + its number + year."""
    host = F.regexp_extract(url_col, r"^(https?://[^/]+)", 1)
    num = F.regexp_extract(url_col, r"/[a-z]{2}/([0-9]+)", 1)
    return F.when(num != "", F.concat(host, F.lit("/eli/"), year_col.cast("string"), F.lit("/act/"),
                                      num, F.lit("/enacted/en/print.html"))).otherwise(url_col)


_ELI_SQL = ("CASE WHEN regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) <> '' THEN "
            "regexp_extract(url, '^(https?://[^/]+)', 1) || '/eli/' || CAST(2000 + page_id % 25 AS VARCHAR)"
            " || '/act/' || regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) || '/enacted/en/print.html' "
            "ELSE url END")


@register("year_seed", f"""
WITH y AS (SELECT min(2000 + page_id % 25) AS lo, max(2000 + page_id % 25) AS hi FROM pages)
SELECT CAST(year AS INTEGER) AS year, '{BASE}/eli/' || year || '/act/' AS url
FROM y, LATERAL (SELECT unnest(range(lo, hi + 1)) AS year)""")
def q_year_seed(spark, sf):
    """SRC5: one index URL per year from the first to the last year of the laws."""
    return year_seed_from(_laws(spark, sf).select("year"), BASE)


@register("url_key", f"""
SELECT page_id, eli,
  CAST(nullif(regexp_extract(eli, '/eli/(\\d+)/act/(\\d+)/', 1), '') AS INTEGER) AS year,
  CAST(nullif(regexp_extract(eli, '/eli/(\\d+)/act/(\\d+)/', 2), '') AS INTEGER) AS act_number,
  string_split(eli, '/')[-3] AS path_year
FROM (SELECT page_id, {_ELI_SQL} AS eli FROM pages)""")
def q_url_key(spark, sf):
    """SCL1 + SCL4: (year, act number) from ELI URLs, and the year by position."""
    pages = td.table(spark, sf, "pages")
    year = (F.lit(td.FIRST_YEAR) + F.col("page_id") % td.YEAR_SPAN)
    e = pages.select("page_id", _eli(F.col("url"), year).alias("eli"))
    return e.select("page_id", "eli", urls.url_year("eli").alias("year"),
                    urls.url_act_number("eli").alias("act_number"),
                    urls.url_path_year("eli").alias("path_year"))


@register("path_key", with_(LAWS) + r"""
SELECT law_id, html_path,
  CAST(nullif(regexp_extract(html_path, '[/\\](\d{4})[/\\]act_(\d+)\.html$', 1), '') AS INTEGER) AS year,
  CAST(nullif(regexp_extract(html_path, '[/\\](\d{4})[/\\]act_(\d+)\.html$', 2), '') AS INTEGER) AS act_number,
  CASE WHEN regexp_matches(coalesce(html_path, ''), '[/\\](\d{4})[/\\]act_(\d+)\.html$') THEN 'ok'
       ELSE 'error:path' END AS status
FROM laws""")
def q_path_key(spark, sf):
    """SCL2: (year, act number) from raw-page paths; no match -> error row."""
    laws = _laws(spark, sf)
    y = urls.path_year("html_path")
    return laws.select("law_id", "html_path", y.alias("year"),
                       urls.path_act_number("html_path").alias("act_number"),
                       F.when(y.isNull(), F.lit("error:path")).otherwise(F.lit("ok")).alias("status"))


@register("link_transform", f"""
SELECT page_id, link,
  CASE WHEN regexp_extract(link, '/(\\d+)/index\\.html$', 1) <> '' THEN
    '{BASE}/eli/' || CAST(2000 + page_id % 25 AS VARCHAR) || '/act/'
    || CAST(CAST(regexp_extract(link, '/(\\d+)/index\\.html$', 1) AS INTEGER) AS VARCHAR)
    || '/enacted/en/print.html' END AS print_url
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/index.html' AS link FROM pages)""")
def q_link_transform(spark, sf):
    """SCL3: index links -> absolute print URLs (leading zeros dropped)."""
    pages = td.table(spark, sf, "pages")
    link = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/index.html"))
    year = (F.lit(td.FIRST_YEAR) + F.col("page_id") % td.YEAR_SPAN)
    p = pages.select("page_id", link.alias("link"), year.alias("_y"))
    return p.select("page_id", "link", urls.link_transform(F.col("link"), F.col("_y"), BASE).alias("print_url"))


_A_RE = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


@register("page_links", f"""
WITH b AS (SELECT page_id, regexp_extract({clean('html')}, '{element_re('nav')}', 1) AS block FROM pages),
z AS (SELECT page_id,
        list_zip(list_transform(regexp_extract_all(block, '{_A_RE}', 2),
                                lambda x: {decode("regexp_replace(x, '<[^>]*>', '', 'g')")}),
                 regexp_extract_all(block, '{_A_RE}', 1)) AS pairs FROM b),
f AS (SELECT page_id, list_filter(pairs, lambda p: ends_with(p[2], '.')) AS kept FROM z)
SELECT page_id, CAST(i - 1 AS BIGINT) AS link_no, kept[i][1] AS name, kept[i][2] AS href
FROM f, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS i)""")
def q_page_links(spark, sf):
    """SCL6 + JN9: (name, href) pairs of the nav links whose href ends with '.'."""
    return page_links(td.table(spark, sf, "pages"), container="nav", keep_suffix=".")


@register("page_body", r"""
SELECT page_id,
  CAST(length(regexp_extract(html, '(?is)<body[^>]*>.*</body>', 0)) AS BIGINT) AS body_chars,
  md5(regexp_extract(html, '(?is)<body[^>]*>.*</body>', 0)) AS body_md5,
  nullif(""" + decode(r"regexp_extract(html, '(?is)<body[^>]*>([^<]*)', 1)") + """, '') AS first_text
FROM pages""")
def q_page_body(spark, sf):
    """SCL7: body HTML size and the first text right after ``<body>``."""
    pages = td.table(spark, sf, "pages")
    body, first = page_body(F.col("html"))
    return pages.select("page_id", F.length(body).cast("bigint").alias("body_chars"), F.md5(body).alias("body_md5"), first.alias("first_text"))


@register("shred_rows", f"""
WITH r AS (
  SELECT page_id, {element_list(f"regexp_extract({clean('html')}, '{element_re('article')}', 1)", 'p')} AS rows FROM pages)
SELECT page_id AS law_id, CAST(i - 1 AS BIGINT) AS row_no, CAST(1 AS BIGINT) AS n_cells,
       {cell_text('rows[i]')} AS c2
FROM r, LATERAL (SELECT unnest(range(1, len(rows) + 1)) AS i)""")
def q_shred_rows(spark, sf):
    """SCL12: row elements of the first container, cell text per row
    (pages have no tables: container ``article``, rows ``p``, one cell each)."""
    pages = td.table(spark, sf, "pages").withColumnRenamed("page_id", "law_id")
    r = shred_rows(pages, container="article", row="p", cell=None, min_cells=1)
    return r.select("law_id", "row_no", "n_cells", "c2")


@register("table_rows", f"""
WITH r AS (
  SELECT page_id, {element_list(f"regexp_extract({clean('html')}, '{element_re('article')}', 1)", 'p')} AS rows FROM pages),
t AS (
  SELECT page_id, i, i + (i + 1) // 4 AS row_no, {strip(decode("regexp_replace(rows[i + 1], '<[^>]*>', '', 'g')"))} AS t
  FROM r, LATERAL (SELECT unnest(range(0, len(rows))) AS i))
SELECT page_id AS law_id, CAST(row_no AS BIGINT) AS row_no, CAST(CASE i % 4 WHEN 2 THEN 6 ELSE 3 END AS BIGINT) AS n_cells,
       CAST(i AS VARCHAR) AS c0, 'T' || i AS c1,
       CASE i % 4 WHEN 0 THEN t WHEN 1 THEN concat_ws(' ', nullif(t, ''), 'é—') ELSE concat_ws(' ', nullif(t, ''), 'x y z' || i || ' tail') END AS c2
FROM t WHERE i % 4 < 3
UNION ALL
SELECT page_id, CAST(row_no + 1 AS BIGINT), CAST(3 AS BIGINT), 'x', 'y', 'z' || i FROM t WHERE i % 4 = 2""")
def q_table_rows(spark, sf):
    """SCL12: rows and cells of tables without end tags, nested ones included (the view
    ``table_pages`` of all pages)."""
    return shred_rows(td.table_pages(spark, sf))


@register("cell_text", f"""
SELECT page_id,
  replace(array_to_string(list_transform(regexp_extract_all({clean('html')}, '{element_re('li')}', 1),
          lambda x: {decode("regexp_replace(x, '<[^>]*>', '', 'g')")}), ' '), chr(10), ' ') AS plain_text
FROM pages""")
def q_cell_text(spark, sf):
    """SCL8: text of every cell element (here ``li``) joined by a space."""
    pages = td.table(spark, sf, "pages")
    return pages.select("page_id", joined_cell_text(F.col("html"), "li").alias("plain_text"))


#: JSON lines of the scraped items: each page whole (kind 0); pages whose URL has a fragment
#: once more cut in half (1), those with a query string once more without a URL (2)
SCRAPED = rf"""
items AS (
  SELECT page_id, url AS page_url, html, year, eli, name FROM (
    SELECT page_id, html, url, 2000 + page_id % 25 AS year, {_ELI_SQL} AS eli,
           {strip(decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS name FROM pages)),
whole AS (
  SELECT page_id, page_url, CAST(json_object('name', name, 'year', CAST(year AS VARCHAR), 'url', eli, 'full_text', html, 'plain_text', NULL) AS VARCHAR) AS j,
         CAST(json_object('name', name, 'year', CAST(year AS VARCHAR), 'url', '', 'full_text', html, 'plain_text', NULL) AS VARCHAR) AS no_url
  FROM items),
lines AS (
  SELECT page_id, 0 AS kind, j AS line FROM whole
  UNION ALL SELECT page_id, 1, substr(j, 1, length(j) // 2) FROM whole WHERE page_url LIKE '%#%'
  UNION ALL SELECT page_id, 2, no_url FROM whole WHERE page_url LIKE '%?%'),
parsed AS (
  SELECT page_id, kind, json_valid(line) AS ok,
    CASE WHEN json_valid(line) THEN line->>'$.name' END AS name,
    CASE WHEN json_valid(line) THEN line->>'$.year' END AS year,
    CASE WHEN json_valid(line) THEN line->>'$.url' END AS url,
    CASE WHEN json_valid(line) THEN line->>'$.full_text' END AS full_text
  FROM lines),
keyed AS (
  SELECT *, CASE WHEN NOT ok THEN 'error:json'
                 WHEN coalesce(url, '') = '' OR coalesce(full_text, '') = '' THEN 'error:empty'
                 WHEN regexp_extract(url, '/eli/(\d+)/act/(\d+)/', 1) = '' THEN 'error:no_key'
                 ELSE 'ok' END AS status,
    nullif(regexp_extract(url, '/eli/(\d+)/act/(\d+)/', 1), '') AS y,
    CAST(nullif(regexp_extract(url, '/eli/(\d+)/act/(\d+)/', 2), '') AS INTEGER) AS act_number
  FROM parsed)"""


def scraped_lines(spark, sf):
    """``(page_id, kind, value)``: the JSON lines of ``SCRAPED``."""
    pages = td.table(spark, sf, "pages")
    year = F.lit(td.FIRST_YEAR) + F.col("page_id") % td.YEAR_SPAN
    item = lambda url: F.to_json(F.struct(td.page_title(F.col("html")).alias("name"), year.cast("string").alias("year"),
                                          url.alias("url"), F.col("html").alias("full_text"), F.lit(None).cast("string").alias("plain_text")))
    whole = item(_eli(F.col("url"), year))
    kinds = F.concat(F.array(F.lit(0)), F.when(F.col("url").contains("#"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
                     F.when(F.col("url").contains("?"), F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    lines = pages.withColumn("kind", F.explode(kinds))
    value = F.when(F.col("kind") == 0, whole).when(F.col("kind") == 1, whole.substr(F.lit(1), F.floor(F.length(whole) / 2).cast("int"))) \
             .otherwise(item(F.lit("")))
    return lines.select("page_id", "kind", value.alias("value"))


@register("src_jsonl", with_(SCRAPED) + """
SELECT page_id, kind, name, year, url, md5(full_text) AS text_md5, status, act_number FROM keyed""")
def q_src_jsonl(spark, sf):
    """SRC1 + SCL5: tolerant JSON-lines parse with a status per line: every page whole,
    and broken and incomplete lines beside them."""
    items = keyed_items(parse_json_lines(scraped_lines(spark, sf), "value"))
    return items.select("page_id", "kind", "name", "year", "url", F.md5("full_text").alias("text_md5"), "status", "act_number")


@register("write_once_keep", with_(LAWS) + """
, old AS (SELECT year, act_number, law_id FROM laws WHERE url LIKE 'https%' AND act_number IS NOT NULL),
old1 AS (SELECT year, act_number, min(law_id) AS law_id FROM old GROUP BY year, act_number),
batch AS (SELECT year, act_number, min(law_id) AS law_id FROM laws WHERE act_number IS NOT NULL
          GROUP BY year, act_number)
SELECT year, act_number, law_id, 'kept' AS origin FROM old1
UNION ALL
SELECT b.year, b.act_number, b.law_id, 'written' FROM batch b
WHERE NOT EXISTS (SELECT 1 FROM old1 o WHERE o.year = b.year AND o.act_number = b.act_number)""")
def q_write_once_keep(spark, sf):
    """SNK1/WIN8/JN8: first writer per (year, number) wins, existing pages stay.

    The store holds the https pages; the batch is every page in arrival
    (page id) order.
    """
    laws = _laws(spark, sf).filter(F.col("act_number").isNotNull())
    old = keep_first(laws.filter(F.col("url").startswith("https")), ["year", "act_number"], "law_id")
    batch = laws
    new = write_once(old, batch, ["year", "act_number"], "law_id")
    cols = ["year", "act_number", "law_id"]
    return old.select(*cols, F.lit("kept").alias("origin")).unionByName(
        new.select(*cols, F.lit("written").alias("origin")))


@register("acts_from_pages", with_(LAWS) + r"""
SELECT law_id, html_path AS path,
  CAST(nullif(regexp_extract(html_path, '[/\\](\d{4})[/\\]act_(\d+)\.html$', 1), '') AS INTEGER) AS year,
  CAST(nullif(regexp_extract(html_path, '[/\\](\d{4})[/\\]act_(\d+)\.html$', 2), '') AS INTEGER) AS act_number,
  CAST(length(html) AS BIGINT) AS html_chars, md5(html) AS html_md5
FROM laws JOIN pages ON pages.page_id = laws.law_id""")
def q_acts_from_pages(spark, sf):
    """SRC3 + SCL2 stand-in: each page as a raw act file at its path."""
    laws = _laws(spark, sf)
    pages = td.table(spark, sf, "pages").select(F.col("page_id").alias("law_id"), "html")
    j = laws.select("law_id", F.col("html_path").alias("path")).join(pages, "law_id")
    return j.select("law_id", "path", urls.path_year("path").alias("year"),
                    urls.path_act_number("path").alias("act_number"),
                    F.length("html").cast("bigint").alias("html_chars"), F.md5("html").alias("html_md5"))


@register("act_text_by_slug", f"""
WITH t AS (
  SELECT page_id, lower(regexp_replace(name, '[^\\pL\\pN_]+', '_', 'g')) AS slug,
    replace(array_to_string(list_transform({element_list(clean('html'), 'p')},
            lambda x: {decode("regexp_replace(x, '<[^>]*>', '', 'g')")}), ' '), chr(10), ' ') AS text
  FROM (SELECT page_id, html,
          {strip(decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS name FROM pages))
SELECT slug, max(page_id) AS page_id, CAST(length(arg_max(text, page_id)) AS BIGINT) AS n_chars, md5(arg_max(text, page_id)) AS text_md5
FROM t WHERE length(slug) > 1 GROUP BY slug""")
def q_act_text_by_slug(spark, sf):
    """SNK5 + SCL8/SCL10/SCL11: one text per slug, the latest page wins;
    slugs of length 0 or 1 are rejected."""
    pages = td.table(spark, sf, "pages")
    t = pages.select("page_id", slug(td.page_title(F.col("html"))).alias("slug"),
                     joined_cell_text(F.col("html"), "p").alias("text"))
    t = t.filter(F.length("slug") > 1)
    last = latest_per_key(t, ["slug"], "page_id")
    return last.select("slug", "page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))
