"""JN3-JN6, JN12, SCL23/24/27, TOP3/5/6, TXT1: lookups over whole request tables.

The reference answers one request at a time with SQL; here a table of requests is
joined with the laws or sections table in one job.  ``ILIKE`` joins go through an
inverted index of the trigrams of the names: a keyword meets the names that hold its
rarest trigram, and ``ILIKE`` decides.  Only keywords without three literal characters in
a row are compared with every name, once per distinct keyword.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import numbered


def name_match(name: Column, keyword: Column, literal: bool = False) -> Column:
    """SCL27: case-insensitive substring; ``%``/``_`` are live wildcards
    (``ILIKE``) unless ``literal``; '' matches everything."""
    if literal:
        return F.lower(name).contains(F.lower(keyword))
    plain = F.replace(keyword, F.lit("\\"), F.lit("\\\\"))  # a backslash stands for itself
    return F.ilike(name, F.concat(F.lit("%"), plain, F.lit("%")))


def _trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: text.substr(i, F.lit(3)))) \
        .otherwise(F.array().cast("array<string>"))


def trigram_index(laws: DataFrame) -> DataFrame:
    """``(tri, law_id)``: the trigrams of each lower-cased name."""
    return laws.select(F.explode(F.array_distinct(_trigrams(F.lower("name")))).alias("tri"), F.col("law_id").alias("_law")).distinct()


def _candidates(laws: DataFrame, keywords: DataFrame, literal: bool) -> DataFrame:
    """``(_kw, _law)`` of distinct ``keywords(_kw)``: the names that may match by the
    keyword's rarest trigram."""
    index = trigram_index(laws)
    low = F.lower("_kw")
    runs = F.array(low) if literal else F.split(low, "[%_]")
    asked = keywords.select("_kw", F.explode(F.array_distinct(F.flatten(F.transform(runs, _trigrams)))).alias("tri"))
    count = index.join(asked.select("tri").distinct(), "tri", "left_semi").groupBy("tri").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(count, "tri", "left").groupBy("_kw").agg(F.min_by("tri", F.struct(F.coalesce("n", F.lit(0)), "tri")).alias("tri"))
    return rare.join(index, "tri").select("_kw", "_law")


def matching_laws(laws: DataFrame, requests: DataFrame, req_id: str = "req_id", keyword: str = "keyword",
                  literal: bool = False) -> DataFrame:
    """JN6 without the order: the request's columns and those of each law whose name
    contains the keyword.  A null keyword matches nothing; law ids are not null."""
    keywords = requests.select(F.col(keyword).alias("_kw")).filter(F.col("_kw").isNotNull()).distinct()
    run = F.lit(3) <= (F.length("_kw") if literal else F.array_max(F.transform(F.split(F.lower("_kw"), "[%_]"), F.length)))
    found = _candidates(laws, keywords.filter(run), literal)
    law = laws.select(F.struct(*laws.columns).alias("_l"), F.col("law_id").alias("_law"))
    hits = found.join(law, "_law").filter(name_match(F.col("_l.name"), F.col("_kw"), literal)).select("_kw", "_l")
    short = keywords.filter(~run)
    hits = hits.unionByName(short.join(law, name_match(F.col("_l.name"), F.col("_kw"), literal)).select("_kw", "_l"))
    out = requests.withColumnRenamed(keyword, "_kw").join(hits, "_kw")
    return out.select(*(F.col("_kw" if c == keyword else c).alias(c) for c in requests.columns),
                      *(F.col(f"_l.{c}").alias(c) for c in laws.columns))


def search_laws(laws: DataFrame, requests: DataFrame, req_id: str = "req_id", keyword: str = "keyword",
                literal: bool = False) -> DataFrame:
    """JN6/TOP6: every law whose name contains the request keyword, with ``list_no``, its
    place in the answer by year, act number and id."""
    hits = matching_laws(laws, requests, req_id, keyword, literal)
    return numbered(hits, [req_id], [F.asc_nulls_last("year"), F.asc_nulls_last("act_number"), F.asc_nulls_last("law_id")])


def law_by_name(laws: DataFrame, requests: DataFrame, req_id: str = "req_id", name: str = "name",
                year: str = "year") -> DataFrame:
    """JN5/TOP5: at most one law per request: name contains the text and, when
    the request year is set and not 0, the year equals; ties -> lowest
    (year, act_number, law_id).  Misses have NULL law columns."""
    reqs = requests.select(F.col(req_id).alias("_rid"), F.col(name).alias("_rname"), F.col(year).alias("_ryear"))
    law_cols = laws.columns
    hits = matching_laws(laws, reqs, "_rid", "_rname").filter(
        F.col("_ryear").isNull() | (F.col("_ryear") == 0) | (F.col("year") == F.col("_ryear")))
    best = hits.groupBy("_rid").agg(
        F.min_by(F.struct(*[F.col(c) for c in law_cols]),
                 F.struct(F.col("year"), F.col("act_number"), F.col("law_id"))).alias("_law"))
    return (reqs.join(best, "_rid", "left")
            .select(F.col("_rid").alias(req_id), F.col("_rname").alias(name), F.col("_ryear").alias(year),
                    *[F.col(f"_law.{c}").alias(c if c not in (name, year) else f"law_{c}") for c in law_cols]))


def law_sections(sections: DataFrame, requests: DataFrame, req_id: str = "req_id",
                 order: str = "position") -> DataFrame:
    """JN3/TOP3: all sections of the requested law with ``list_no``, their
    place in the answer: by position then seq (the reference's order), or by
    seq with ``order='document'``.  One very large law is numbered by many tasks."""
    j = requests.select(req_id, "law_id").join(sections, "law_id")
    return numbered(j, [req_id], [F.col("seq")] if order == "document" else [F.asc_nulls_last("position"), F.col("seq")])


def section_by_ref(sections: DataFrame, requests: DataFrame, req_id: str = "req_id") -> DataFrame:
    """JN4/TOP5: the first section (lowest seq) with that ref in that law;
    a miss keeps the request with NULL section columns."""
    sec_cols = [c for c in sections.columns if c not in ("law_id", "section_ref")]
    asked = requests.select("law_id", "section_ref").distinct()
    best = sections.join(asked, ["law_id", "section_ref"], "left_semi").groupBy("law_id", "section_ref").agg(
        F.min_by(F.struct(*[F.col(c) for c in sec_cols]), F.col("seq")).alias("_s"))
    j = requests.join(best, ["law_id", "section_ref"], "left")
    return j.select(*requests.columns, *[F.col(f"_s.{c}").alias(c) for c in sec_cols])


def json_list(col: Column, element_type: str) -> Column:
    """SCL23: a JSON list text (or a typed array) -> array; NULL, '' and
    non-list JSON give an empty array."""
    if element_type is None:
        return F.coalesce(col, F.array())
    is_list = F.regexp_extract(col, r"^\s*(\S)", 1) == "["  # Spark would wrap a lone object
    parsed = F.when(is_list, F.from_json(col, f"array<{element_type}>"))
    return F.coalesce(parsed, F.array().cast(f"array<{element_type}>"))


def source_nodes(messages: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """TXT1: source nodes of tool results in a message history.

    Only ``user`` messages whose content is a JSON list; its ``tool_result``
    blocks whose content is valid JSON; an object is one item, a list many,
    what is no object or an empty one is dropped.  ``text`` = text_content, else name, else the
    item as JSON; ``score`` 0.0; ``metadata`` = the rest of the item.
    """
    blocks_t = "array<struct<type:string,content:string>>"
    m = messages.filter(F.col("role") == "user").select(*keys, F.from_json("content", blocks_t).alias("_b"))
    b = m.select(*keys, F.posexplode("_b").alias("block_no", "blk")) \
         .filter(F.col("blk.type") == "tool_result") \
         .select(*keys, "block_no", F.col("blk.content").alias("raw"))
    # typed: a string that looks like an object stays a string
    value = F.try_parse_json("raw")
    kind = F.schema_of_variant(value)
    items = (F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
              .when(kind.startswith("OBJECT"), F.array(value)))
    kind = F.schema_of_variant("item")
    x = b.select(*keys, "block_no", F.posexplode(items).alias("item_no", "item")) \
         .filter(kind.startswith("OBJECT") & (kind != "OBJECT<>")) \
         .withColumn("item", F.from_json(F.to_json("item"), "map<string,string>"))
    it = F.col("item")
    text = F.coalesce(F.nullif(it["text_content"], F.lit("")), F.nullif(it["name"], F.lit("")), F.to_json(it))
    return x.select(*keys, "block_no", "item_no", text.alias("text"), F.lit(0.0).alias("score"),
                    F.map_filter(it, lambda k, v: k != "text_content").alias("metadata"))
