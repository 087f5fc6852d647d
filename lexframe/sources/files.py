"""SRC3/SRC4: whole files as rows (HTML act tree, plain-text acts)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import path_act_number, path_year


def read_act_pages(spark: SparkSession, root: str) -> DataFrame:
    """SRC3 + SCL2: ``{root}/{year}/*.html``, exactly one folder level.

    One row per file: ``path, year, act_number, html, status``; a file whose
    path does not name a 4-digit year and ``act_{n}.html`` keeps a row with
    ``status = 'error:path'`` instead of failing the run.
    """
    df = (spark.read.option("wholetext", True).text(root.rstrip("/") + "/*/*.html")
          .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")))
    y, n = path_year(F.col("path")), path_act_number(F.col("path"))
    return df.select("path", y.alias("year"), n.alias("act_number"), "html",
                     F.when(y.isNull(), F.lit("error:path")).otherwise(F.lit("ok")).alias("status"))


def read_text_files(spark: SparkSession, root: str, ext: str = ".txt") -> DataFrame:
    """SRC4: every ``*{ext}`` file below ``root`` (recursive); the path is the id."""
    return (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*{ext}").text(root)
            .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))
