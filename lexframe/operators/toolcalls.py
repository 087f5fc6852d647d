"""JN12 + SCL24: batch dispatch of agent tool calls to the four lookups.

Calls are split by tool name, each group runs its lookup as one join, and
the answers come back as one row per result item with the item encoded as
JSON (``to_json``); a miss gives ``null``, an unknown tool an error object.
One row per item (not one JSON list per call) keeps a call that matches
every law from becoming one huge value.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import law_by_name, matching_laws, section_by_ref

LAW_FIELDS = ["law_id", "name", "year", "act_number", "url", "html_path"]
SECTION_FIELDS = ["seq", "section_type", "section_ref", "section_title", "text_content", "position"]


def _json(row):
    return F.to_json(row, {"ignoreNullFields": "false"})


def dispatch(calls: DataFrame, laws: DataFrame, sections: DataFrame) -> DataFrame:
    """``calls(call_id, tool, args)`` -> ``(call_id, tool, law_id, seq, result)``."""
    law_fields = [c for c in LAW_FIELDS if c in laws.columns]
    section_fields = [c for c in SECTION_FIELDS if c in sections.columns]
    arg = lambda p: F.get_json_object(F.col("args"), f"$.{p}")
    tool = F.col("tool")
    null_l, null_s = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")

    # a law id that is no number answers an error and leaves the other calls alone
    keyed = tool.isin("get_law_sections", "get_section_by_ref")
    bad = calls.filter(keyed & arg("law_id").try_cast("bigint").isNull()).select(
        "call_id", "tool", null_l.alias("law_id"), null_s.alias("seq"), _json(F.struct(F.lit("Invalid law_id").alias("error"))).alias("result"))
    calls = calls.filter(~keyed | arg("law_id").try_cast("bigint").isNotNull())

    s_req = calls.filter(tool == "search_laws").select("call_id", F.coalesce(arg("query"), F.lit("")).alias("keyword"))
    s = matching_laws(laws, s_req, "call_id", "keyword").select(
        "call_id", F.lit("search_laws").alias("tool"), F.col("law_id").cast("bigint").alias("law_id"),
        null_s.alias("seq"), _json(F.struct(*law_fields)).alias("result"))

    s_none = s_req.join(s.select("call_id").distinct(), "call_id", "left_anti").select(
        "call_id", F.lit("search_laws").alias("tool"), null_l.alias("law_id"), null_s.alias("seq"),
        F.lit("[]").alias("result"))

    n_req = calls.filter(tool == "get_law_by_name").select(
        "call_id", F.coalesce(arg("name"), F.lit("")).alias("name"), arg("year").try_cast("int").alias("year"))
    n = law_by_name(laws.select(*law_fields), n_req, "call_id", "name", "year").select(
        "call_id", F.lit("get_law_by_name").alias("tool"), F.col("law_id").cast("bigint").alias("law_id"),
        null_s.alias("seq"),
        F.when(F.col("law_id").isNotNull(),
               _json(F.struct(*(F.col({"name": "law_name", "year": "law_year"}.get(c, c)).alias(c) for c in law_fields)))).otherwise(F.lit("null")).alias("result"))

    l_req = calls.filter(tool == "get_law_sections").select("call_id", arg("law_id").try_cast("bigint").alias("law_id"))
    hits = l_req.join(sections.select("law_id", *section_fields), "law_id")
    ls = hits.select("call_id", F.lit("get_law_sections").alias("tool"), "law_id", "seq",
                     _json(F.struct(*section_fields)).alias("result"))
    # a law with no sections answers an empty list: no item rows, one marker row
    empty = l_req.join(hits.select("call_id").distinct(), "call_id", "left_anti").select(
        "call_id", F.lit("get_law_sections").alias("tool"), "law_id", null_s.alias("seq"), F.lit("[]").alias("result"))

    r_req = calls.filter(tool == "get_section_by_ref").select(
        "call_id", arg("law_id").try_cast("bigint").alias("law_id"), arg("section_ref").alias("section_ref"))
    r = section_by_ref(sections.select("law_id", *section_fields), r_req, "call_id").select(
        "call_id", F.lit("get_section_by_ref").alias("tool"), "law_id", "seq",
        F.when(F.col("seq").isNotNull(), _json(F.struct(*section_fields))).otherwise(F.lit("null")).alias("result"))

    unknown = calls.filter(~tool.isin("search_laws", "get_law_by_name", "get_law_sections", "get_section_by_ref")) \
        .select("call_id", "tool", null_l.alias("law_id"), null_s.alias("seq"),
                _json(F.struct(F.concat(F.lit("Unknown tool: "), tool).alias("error"))).alias("result"))
    return s.unionByName(s_none).unionByName(n).unionByName(ls).unionByName(empty).unionByName(r).unionByName(unknown).unionByName(bad)
