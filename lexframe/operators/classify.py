"""SCL14, SCL17/WIN5, SCL18, SCL20: from statute rows to typed nodes.

Input rows: ``(law_id, row_no, c1, c2)``; ``c1`` is the section-title cell,
``c2`` the text cell, both already cell text (``get_text(strip=True)``).
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import (CLASSIFY_RULES, ENACTING_MARKERS, RANKS,
                                  ROMAN_REF, TITLE_KEYWORD, TITLE_STOP_WORD)
from ..functions.text import is_upper, strip_ws, title_case
from .scan import DEFAULT_CHUNK_ROWS, Running, running


def is_enacting(c2: Column) -> Column:
    """SCL17: the enacting-words row (upper-cased containment)."""
    up = F.upper(c2)
    cond = F.lit(False)
    for m in ENACTING_MARKERS:
        cond = cond | up.contains(m)
    return F.coalesce(cond, F.lit(False))


def enactment_gate(rows: DataFrame, key: str = "law_id", order: str = "row_no",
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """WIN5: keep only rows after the first enacting row of each act.

    Rows up to and including the enacting row (the table of contents) go;
    an act without one keeps no rows.  Empty text rows are dropped first,
    as they never take part.
    """
    rows = rows.filter(F.col("c2").isNotNull() & (F.col("c2") != ""))
    flagged = running(rows, [key], order,
                      [Running("_past", is_enacting(F.col("c2")).cast("int"), "max")],
                      chunk_rows)
    return flagged.filter(F.col("_past") == 1).drop("_past")


def act_titles(rows: DataFrame, key: str = "law_id", order: str = "row_no") -> DataFrame:
    """SCL14/WIN6: per act, the first all-upper row holding ``ACT`` that comes
    before any row containing ``ENACTED``, in Title Case.

    One grouped aggregate (partial aggregation first, so a huge act is
    combined map-side); returns ``(law_id, detected_title)``, NULL when none.
    """
    c2 = F.col("c2")
    cand = F.when(c2.contains(TITLE_KEYWORD) & is_upper(c2), F.struct(F.col(order).alias("o"), c2.alias("t")))
    stop = F.when(F.upper(c2).contains(TITLE_STOP_WORD), F.col(order))
    agg = rows.groupBy(key).agg(F.min(cand).alias("_cand"), F.min(stop).alias("_stop"))
    found = F.col("_cand").isNotNull() & (F.col("_stop").isNull() | (F.col("_cand.o") < F.col("_stop")))
    return agg.select(key, F.when(found, title_case(F.col("_cand.t"))).alias("detected_title"))


def _opening(pattern: str) -> str:
    """The literal text that every match of an anchored rule begins with ("" if none)."""
    return re.match(r"\(\?sU\)\^(\\\(|[A-Za-z]*)", pattern).group(1).replace("\\", "")


def _head(pattern: str) -> str:
    """A rule without its last group, which takes all the rest of any text."""
    return pattern.removesuffix("(.*)")


def _rule_type(text: Column) -> Column:
    """Name of the first matching rule (CASE stops at the first hit); a pattern is only
    tried on text that begins with its opening."""
    out = None
    for name, pat, _, _ in CLASSIFY_RULES:
        hit = text.startswith(_opening(pat)) & text.rlike(_head(pat)) if _opening(pat) else text.rlike(_head(pat))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _rule_group(text: Column, rule: Column, group: int) -> Column:
    """Group ``group`` of the matched rule's head (one regex per row)."""
    out = None
    for name, pat, _, _ in CLASSIFY_RULES:
        e = F.regexp_extract(text, _head(pat), group)
        out = F.when(rule == name, e) if out is None else out.when(rule == name, e)
    return out


def classify_rows(rows: DataFrame) -> DataFrame:
    """SCL18 + SCL20: type, raw ref, rank, title and own text of every row.

    Adds ``section_type`` (NULL for continuation rows), ``rank``, ``raw_ref``
    (ref before SCL19 compounding), ``node_title`` and ``node_text``.
    Continuation rows carry their ``c2`` in ``node_text``.
    """
    rows = rows.withColumn("_text", strip_ws(F.col("c2")))
    rows = rows.withColumn("_rule", _rule_type(F.col("_text")))
    # the head of the row once, as a column: group 1 is read from it, group 2 is all after it
    rows = rows.withColumn("_g0", F.explode(F.array(_rule_group(F.col("_text"), F.col("_rule"), 0)))) \
               .withColumn("_g1", _rule_group(F.col("_g0"), F.col("_rule"), 1)) \
               .withColumn("_g2", F.substr(F.col("_text"), F.length("_g0") + 1)) \
               .withColumn("_g2", strip_ws(F.col("_g2")))
    rows = rows.withColumn(
        "section_type",
        F.when((F.col("_rule") == "paragraph") & F.col("_g1").rlike(ROMAN_REF), F.lit("subparagraph"))
         .otherwise(F.col("_rule")))
    st = F.col("section_type")
    ref = (F.when(st == "schedule", F.concat(F.lit("Schedule "), F.col("_g1")))
            .when(st == "chapter", F.concat(F.lit("Chapter "), F.col("_g1")))
            .when(st == "article", F.concat(F.lit("Article "), F.col("_g1")))
            .otherwise(F.col("_g1")))
    rank = F.lit(None).cast("int")
    for t, r in RANKS.items():
        rank = F.when(st == t, F.lit(r)).otherwise(rank)
    headed = st.isin("part", "schedule", "chapter", "article")
    title = (F.when(st == "section", F.coalesce(F.col("c1"), F.lit("")))
              .when(headed, F.col("_g2"))
              .when(st.isNotNull(), F.lit("")))
    own_text = (F.when(headed, F.lit(""))
                 .when(st.isNotNull(), F.col("_g2"))
                 .otherwise(F.col("c2")))
    return (rows.withColumn("raw_ref", ref)
                .withColumn("rank", rank)
                .withColumn("node_title", title)
                .withColumn("node_text", own_text)
                .drop("_text", "_rule", "_g0", "_g1", "_g2"))
