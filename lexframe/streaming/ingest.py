"""STR1: incremental ingest of scraped JSON-lines files.

``readStream`` picks up new files in a folder; every micro-batch goes
through the same batch operators as a one-off run: keys and statuses
(SRC1/SCL1/SCL5), write-once raw pages (SNK1), law upsert (SNK2), shredding
and the section tree (SCL12, WIN1-5, AGG4), replace-by-law (SNK3) and the
vectors of the sections (SNK4).  Laws, sections and vectors are bucketed by
``law_id`` and a micro-batch rewrites only the buckets it touches.  All
writes are idempotent, so a micro-batch replayed after a failure
leaves the tables as they were; ``availableNow`` processes what is there
and stops.  The stream's own checkpoint lives under ``spark.checkpoint.dir``
unless one is given.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.classify import act_titles
from ..operators.hierarchy import build_sections
from ..operators.shred import shred_rows
from ..operators.vectors import embedded, hashed_embedding
from ..session import ensure_checkpoint_dir
from ..sinks import tables as snk
from ..sinks.buckets import BucketTable
from ..sinks.schema import ensure_buckets, ensure_tables
from ..sources.jsonl import CORRUPT, ITEM_SCHEMA, keyed_items


def ingest_batch(spark: SparkSession, items: DataFrame, raw_path: str, tables: dict[str, BucketTable], embed=hashed_embedding) -> None:
    """One batch of scraped items -> raw_pages, laws, law_sections, law_vectors."""
    keyed = keyed_items(items).filter(F.col("status") == "ok")
    pages = keyed.select(F.col("year_key").alias("year"), "act_number", "name", "url",
                         F.col("full_text").alias("html"), "arrival")
    keys = ["year", "act_number"]
    # SNK1: first writer per (year, number) wins, stored pages stay
    raw = spark.read.parquet(raw_path)
    new_raw = snk.write_once(raw, pages, keys, "arrival").select(*raw.columns)
    snk.write_table(spark, new_raw, raw_path, mode="append")
    # names and urls: the last of each key; sections: the stored page of each key touched
    latest = snk.latest_per_key(pages, keys, "arrival").withColumn(
        "law_id", snk.derived_law_id(F.col("year"), F.col("act_number"), F.col("name")))
    stored = spark.read.parquet(raw_path).select(*keys, "html").join(latest.select(*keys, "law_id"), keys)
    rows = shred_rows(stored.select("law_id", "html"))
    sections = build_sections(rows)
    titles = act_titles(rows)
    named = latest.join(titles, "law_id", "left").select(
        "law_id", "year", "act_number", "url",
        F.coalesce(F.nullif("name", F.lit("")), F.nullif("detected_title", F.lit("")),
                   F.format_string("Act %d of %d", F.col("act_number"), F.col("year"))).alias("name"),
        F.format_string("raw_html/%d/act_%d.html", F.col("year"), F.col("act_number")).alias("html_path"),
        "arrival")
    # SNK2 to SNK4: only the buckets of the batch's laws
    tables["laws"].merge(latest.select("law_id"), lambda old: snk.upsert_laws(old, named.drop("law_id"), "arrival"))
    tables["law_sections"].replace(sections, latest.select("law_id"))
    stored_sections = tables["law_sections"].read().join(latest.select("law_id").distinct(), "law_id", "left_semi")
    tables["law_vectors"].replace(embedded(stored_sections, tables["laws"].read(), embed), latest.select("law_id"))


def stream_ingest(spark: SparkSession, source_dir: str, root: str, checkpoint: str | None = None,
                  buckets: int = 64, embed=hashed_embedding) -> None:
    """Process every new ``*.jsonl`` file in ``source_dir`` into the tables
    under ``root`` and stop (``availableNow``)."""
    raw_path = ensure_tables(spark, root, ("raw_pages",))["raw_pages"]
    tables = ensure_buckets(spark, root, buckets)
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", "ingest")
    schema = T.StructType(ITEM_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
    stream = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.jsonl")
              .json(source_dir)
              .withColumn("_file", F.col("_metadata.file_path"))
              .withColumn("_start", F.col("_metadata.file_block_start")))

    def per_batch(df: DataFrame, epoch_id: int) -> None:
        # arrival = (file, place in it), however files are packed into tasks; the id rises within a file
        items = df.withColumn("arrival", F.struct("_file", "_start", F.monotonically_increasing_id())).drop("_file", "_start")
        ingest_batch(spark, items, raw_path, tables, embed)

    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
