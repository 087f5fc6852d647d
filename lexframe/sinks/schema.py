"""SNK8: table schemas and create-if-missing (empty parquet tables)."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .buckets import BucketTable

# ---- fixed values: table layouts -------------------------------------------
RAW_PAGES = "year int, act_number int, name string, url string, html string"
LAWS = ("law_id bigint, name string, year int, act_number int, url string, html_path string, "
        "created_at timestamp_ntz")
LAW_SECTIONS = ("law_id bigint, seq bigint, section_type string, section_ref string, section_title string, "
                "text_content string, position bigint, parent_seq bigint, parent_ref string")
EVAL_RESULTS = ("id bigint, query_text string, llm_response string, scores array<double>, "
                "source_nodes array<struct<text:string,score:double,metadata:map<string,string>>>, "
                "rating string, top_k int, created_at timestamp_ntz, rated_at timestamp_ntz")
LAW_VECTORS = ("law_id bigint, seq bigint, text string, metadata struct<law_id:bigint,law_name:string,year:int,"
               "section_ref:string,section_type:string,section_title:string>, embedding array<float>")
#: tables that are merged by law, in buckets of ``law_id``
BUCKETED = {"laws": LAWS, "law_sections": LAW_SECTIONS, "law_vectors": LAW_VECTORS}
TABLES = {"raw_pages": RAW_PAGES, "laws": LAWS, "law_sections": LAW_SECTIONS, "eval_results": EVAL_RESULTS}


def ensure_buckets(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, BucketTable]:
    """The bucketed tables under ``root``, made where they are missing."""
    return {name: BucketTable(spark, os.path.join(root, name), ddl, "law_id", buckets) for name, ddl in BUCKETED.items()}


def ensure_tables(spark: SparkSession, root: str, names=tuple(TABLES)) -> dict[str, str]:
    """Create every missing table under ``root`` as an empty parquet folder;
    existing ones are left alone.  Returns name -> path."""
    paths = {}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = os.path.join(root, name)
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            spark.createDataFrame([], TABLES[name]).write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths
