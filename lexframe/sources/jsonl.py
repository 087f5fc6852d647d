"""SRC1/SRC2 + SCL5: scraped items as JSON lines, tolerant or strict.

Item fields are all strings (``year`` is a URL piece).  Tolerant mode keeps
malformed lines as rows with ``_corrupt_record`` set and lets every later
step see a per-row ``status`` instead of stopping the run.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import url_act_number, url_year

ITEM_FIELDS = ("name", "year", "url", "full_text", "plain_text")
ITEM_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in ITEM_FIELDS])
CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Read JSON lines.  Blank lines vanish; a broken line becomes a row
    with only ``_corrupt_record`` set (tolerant) or fails the job (strict)."""
    if strict:
        return spark.read.schema(ITEM_SCHEMA).option("mode", "FAILFAST").json(path)
    return parse_json_lines(spark.read.text(path))


def parse_json_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Tolerant parse of a string column of JSON lines (same rules as
    :func:`read_jsonl`): blank lines dropped, broken lines keep their text in
    ``_corrupt_record``."""
    blank = F.col(col).isNull() | (F.trim(F.col(col)) == "")
    parsed = F.from_json(F.col(col), ITEM_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(F.col(col)).isNotNull()
    out = lines.filter(~blank).withColumn("_item", F.when(valid, parsed))
    return out.select(*[c for c in lines.columns if c != col], "_item.*",
                      F.when(~valid, F.col(col)).alias(CORRUPT))


def item_status() -> Column:
    """SCL5 + SCL1: ``ok``, ``error:json``, ``error:empty`` or ``error:no_key``."""
    empty = (F.coalesce(F.col("url"), F.lit("")) == "") | (F.coalesce(F.col("full_text"), F.lit("")) == "")
    return (F.when(F.col(CORRUPT).isNotNull(), F.lit("error:json"))
             .when(empty, F.lit("error:empty"))
             .when(url_year(F.col("url")).isNull(), F.lit("error:no_key"))
             .otherwise(F.lit("ok")))


def keyed_items(items: DataFrame) -> DataFrame:
    """Items with ``status`` and the (year, act_number) key of their URL."""
    return (items.withColumn("status", item_status())
                 .withColumn("year_key", url_year(F.col("url")))
                 .withColumn("act_number", url_act_number(F.col("url"))))
