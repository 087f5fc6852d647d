"""SRC5: per-year index URLs to seed a crawl."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import year_index_url


def year_seed(spark: SparkSession, min_year: int, end_year: int, base: str) -> DataFrame:
    """Years ``min_year .. end_year - 1`` (end exclusive, as ``range``) with URLs."""
    years = spark.range(min_year, end_year).select(F.col("id").cast("int").alias("year"))
    return years.select("year", year_index_url(base, F.col("year")).alias("url"))


def year_seed_from(years: DataFrame, base: str) -> DataFrame:
    """Seed URLs for every year from the first to the last year in ``years``."""
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    out = span.select(F.explode(F.sequence(F.col("lo"), F.col("hi"))).alias("year"))
    return out.select(F.col("year").cast("int").alias("year"), year_index_url(base, F.col("year")).alias("url"))
