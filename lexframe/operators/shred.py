"""SCL6-SCL8, SCL12, SCL13: HTML pages -> rows, cells, links, body text.

All of it is built-in Spark functions (JVM side, no Python).  Rows are found by tag
events: a page is cut into its tags and text nodes, a running sum keeps the depth of
open containers, and rows and cells start at their opening tags and end where the next
one starts, so closing tags may be missing and tables may be nested.  The wide ``html``
column is dropped right after the cutting.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_entities, decode_references, strip_tags, strip_ws, text_pieces

NOISE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
#: comments, elements whose text is not shown, tags (a ``>`` may stand in quotes), other
#: markup, text
TOKENS = (r"""(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"""
          r"""|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*+>|<[!?/][^>]*+>"""
          r"""|[^<]++(?:<(?![a-z/!?])[^<]*+)*+|<(?![a-z/!?])[^<]*+(?:<(?![a-z/!?])[^<]*+)*+|<""")
ROW_GROUPS = ("tbody", "thead", "tfoot")


def clean_html(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, "")


def first_block(html: Column, tag: str) -> Column:
    """Inner HTML of the first ``<tag>`` element, to the page's end where nothing closes
    it ('' when there is none)."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|\z)", 1)


def elements(html: Column, tag: str) -> Column:
    """Inner HTML of every ``<tag>`` element, in document order; an element ends at its
    closing tag, at the next opening one or with a table row."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?=</?{tag}[\s>]|</?tr[\s>]|</table|\z)"), 1)


def tag_events(pages: DataFrame, key: str, html: str, tags: set[str]) -> DataFrame:
    """``(_k, _h, _pos, _tag, _t)``: the text nodes of each page (stripped, references
    decoded, blank ones left out) and those tags that are among ``tags`` (a closing one as
    ``/name``), in document order.  ``_h`` tells pages of one key apart."""
    cut = pages.select(F.col(key).alias("_k"), F.xxhash64(html).alias("_h"),
                       F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKENS), 0)).alias("_pos", "_x"))
    name = F.lower(F.regexp_extract("_x", r"(?i)^<(/?[a-z][a-z0-9:-]*)", 1))
    is_text = ~F.col("_x").rlike(r"(?i)^<[a-z/!?]")
    out = cut.select("_k", "_h", F.col("_pos").cast("bigint").alias("_pos"), F.when(~is_text, name).alias("_tag"),
                     F.when(is_text, strip_ws(decode_references("_x"))).alias("_t"))
    return out.filter((F.col("_t") != "") | F.col("_tag").isin(*sorted(tags)))


def shred_rows(pages: DataFrame, key: str = "law_id", html: str = "html",
               container: str = "table", row: str = "tr", cell: str | None = "td",
               min_cells: int = 3) -> DataFrame:
    """SCL12: ``(key, row_no, n_cells, c0, c1, c2)`` per row of the first container.

    Rows are all ``row`` elements in the container, nested ones included; cells all
    ``cell`` elements in a row, nested ones included; a cell's text is all text in it.
    Rows with fewer than ``min_cells`` cells are dropped (their ``row_no`` stays as in
    the page).  ``c0``/``c1`` are joined without a separator, ``c2`` with a space; with
    ``cell=None`` each row is one cell (``c2``).  A page without the container yields
    no rows (SCL13); a null page neither; rows that repeat key and page are one page.
    """
    starts_none = {f"/{row}", container, f"/{container}", *(ROW_GROUPS if row == "tr" else ()),
                   *(f"/{g}" for g in ROW_GROUPS if row == "tr")}
    cells = {cell, "th", f"/{cell}", "/th"} if cell else set()
    ev = tag_events(pages.filter(F.col(html).rlike(rf"(?i)<{container}[\s>]")), key, html, {row, *starts_none, *cells})
    page = Window.partitionBy("_k", "_h").orderBy("_pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag, opens, closes = F.col("_tag"), F.col("_tag") == container, F.col("_tag") == f"/{container}"
    ev = ev.withColumn("_same", F.coalesce(F.lag("_pos").over(page) == F.col("_pos"), F.lit(False))).filter(~F.col("_same"))
    ev = ev.withColumn("_sum", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far)) \
        .withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(so_far), F.lit(0))) \
        .withColumn("_open", F.max(F.coalesce(opens, F.lit(False))).over(so_far)) \
        .withColumn("_done", F.sum(F.when(closes & (F.col("_depth") == 0) & F.col("_open"), 1).otherwise(0)).over(so_far))
    ev = ev.filter(F.col("_open") & (F.col("_done") == 0))
    # text and cells count in every container around them, other tags in their own
    inner = F.col("_t").isNotNull() | F.coalesce(tag == (cell or row), F.lit(False))
    level = F.when(inner, F.sequence(F.lit(1), F.col("_depth").cast("int"))) \
        .when(closes, F.array(F.col("_depth").cast("int") + 1)).otherwise(F.array(F.col("_depth").cast("int")))
    ev = ev.select("_k", "_h", "_pos", "_tag", "_t", "_depth", F.explode(level).alias("_level"))
    here = Window.partitionBy("_k", "_h", "_level").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (F.col("_depth") == F.col("_level")) | F.coalesce(closes, F.lit(False))
    row_mark = F.when(own & (tag == row), F.col("_pos")).when(own & tag.isin(*sorted(starts_none)), F.lit(-1))
    cell_mark = F.when(own & (tag == cell), F.col("_pos")).when(own & tag.isin(row, *sorted(starts_none | cells)), F.lit(-1)) if cell else row_mark
    ev = ev.select("*", F.last(row_mark, True).over(here).alias("_row"), F.last(cell_mark, True).over(here).alias("_in"))
    # one item per text node of a cell, per cell of a row, and per row (cell null)
    a_cell, a_row = tag == (cell or row), own & (tag == row)
    item = ev.select("_k", "_h", F.when(a_cell, F.col("_pos")).when(F.col("_t").isNotNull(), F.col("_in")).alias("_cell"),
                     F.when(a_cell | a_row, F.when(a_row, F.col("_pos")).otherwise(F.col("_row"))).alias("_row"),
                     F.when(F.col("_t").isNotNull(), F.struct("_pos", "_t")).alias("_text"))
    item = item.filter((F.coalesce(F.col("_cell"), F.lit(0)) >= 0) & (F.coalesce(F.col("_row"), F.lit(0)) >= 0)
                       & (F.col("_cell").isNotNull() | F.col("_row").isNotNull()))
    held = item.groupBy("_k", "_h", "_cell").agg(F.collect_set("_row").alias("_rows"), F.sort_array(F.collect_list("_text")).alias("_texts"))
    held = held.withColumn("_texts", F.col("_texts._t")).select(
        "_k", "_h", F.explode("_rows").alias("_row"), F.when(F.col("_cell").isNotNull(), F.struct("_cell", "_texts")).alias("_c"))
    rows = held.groupBy("_k", "_h", "_row").agg(F.sort_array(F.collect_list("_c")).alias("_cells"))
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("_k", "_h").orderBy("_row")) - 1) \
        .filter(F.size("_cells") >= min_cells)
    text = lambda i, sep: F.array_join(F.get("_cells", F.lit(i))["_texts"], sep)
    c0, c1, c2 = (text(0, ""), text(1, ""), text(2, " ")) if cell else (F.lit(""), F.lit(""), text(0, " "))
    return rows.select(F.col("_k").alias(key), F.col("row_no").cast("bigint").alias("row_no"),
                       F.size("_cells").cast("bigint").alias("n_cells"), c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))


def page_text(html: Column, sep: str = "\n") -> Column:
    """SCL13: the whole text of a page without a table (text nodes joined)."""
    return F.array_join(text_pieces(clean_html(html)), sep)


def joined_cell_text(html: Column, tag: str = "td") -> Column:
    """SCL8: raw text of every ``<tag>`` joined by a space, newlines -> spaces.

    Each element's text is counted once (the reference repeats the text of
    nested cells)."""
    texts = F.transform(elements(clean_html(html), tag), lambda x: strip_tags(x))
    return F.replace(F.array_join(texts, " "), F.lit("\n"), F.lit(" "))


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html",
               container: str = "nav", keep_suffix: str = ".html", compat: bool = False,
               element_id: str | None = None) -> DataFrame:
    """SCL6 + JN9: ``(key, link_no, name, href)`` of the links inside the first
    ``container`` element (the first one whose id is ``element_id``, if given) whose
    href ends with ``keep_suffix``.

    Pairs are zipped before filtering, so a name always belongs to its own
    link; ``compat=True`` filters the hrefs alone and zips by position
    afterwards (truncating to the shorter list), as the reference does.
    """
    doc = clean_html(F.col(html))
    if element_id is not None:
        with_id = rf"""(?is)<{container}\s(?:[^>]*?\s)?id\s*=\s*(?:"{re.escape(element_id)}"|'{re.escape(element_id)}'|{re.escape(element_id)}(?=[\s>]))"""
        doc = F.regexp_extract(doc, with_id + r".*", 0)
    block = first_block(doc, container)
    # the value stands in quotes of either kind or in none; a link ends where the next starts
    a_re = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)[^>]*>(.*?)(?=</a[\s>]|<a\s|\z)"""
    hrefs = F.transform(F.regexp_extract_all(block, F.lit(a_re), 1), lambda x: decode_references(F.regexp_replace(x, r"""^["']|["']$""", "")))
    names = F.transform(F.regexp_extract_all(block, F.lit(a_re), 2), lambda x: decode_references(F.regexp_replace(x, r"<[^>]*>", "")))
    if compat:
        kept = F.filter(hrefs, lambda h: h.endswith(keep_suffix))
        pairs = F.arrays_zip(names.alias("name"), kept.alias("href"))
        pairs = F.filter(pairs, lambda p: p["name"].isNotNull() & p["href"].isNotNull())
    else:
        pairs = F.filter(F.arrays_zip(names.alias("name"), hrefs.alias("href")),
                         lambda p: p["href"].endswith(keep_suffix))
    out = pages.select(F.col(key), F.posexplode(pairs).alias("link_no", "_p"))
    return out.select(key, F.col("link_no").cast("bigint").alias("link_no"),
                      F.col("_p.name").alias("name"), F.col("_p.href").alias("href"))


def page_body(html: Column) -> tuple[Column, Column]:
    """SCL7: (body HTML, first text directly after ``<body>`` or NULL)."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>.*</body>", 0)
    first = F.nullif(decode_entities(F.regexp_extract(html, r"(?is)<body[^>]*>([^<]*)", 1)), F.lit(""))
    return body, first
