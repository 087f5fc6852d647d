"""SNK1-SNK10: idempotent table maintenance without a transactional format.

Every merge is a pure DataFrame function ``(existing, batch) -> new table``;
:func:`write_table` then writes it to a staging folder beside the table
and swaps it in, so a table is never read and overwritten
by the same plan and a lost executor only re-runs tasks of the staging job.

Per-key choices (first/last writer, last non-NULL value) are aggregates
(``min_by``/``max_by``), combined map-side, so one hot key never lands whole
in one task the way a ``row_number()`` window would.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import RATINGS
from ..operators.scan import numbered

LAW_COLUMNS = ["law_id", "name", "year", "act_number", "url", "html_path", "created_at"]


def keep_first(batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """WIN8: the earliest row (by ``arrival``) of every key."""
    rest = [c for c in batch.columns if c not in keys]
    agg = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("_r"))
    return agg.select(*keys, "_r.*")


def latest_per_key(batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """SNK5: the latest row (by ``arrival``) of every key (later write wins)."""
    rest = [c for c in batch.columns if c not in keys]
    agg = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_r"))
    return agg.select(*keys, "_r.*")


def write_once(existing: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """SNK1/JN8: rows to append: first per key in the batch, not already stored."""
    first = keep_first(batch, keys, arrival)
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def derived_law_id(year, act_number, name) -> "F.Column":
    """Stable law id: ``year * 100000 + act_number``; where the act number would
    run into the year, ``-(year * 2**32 + act_number)``, so that no two keys
    share an id; hash of (name, year) when the act number is missing."""
    y, a = year.cast("bigint"), act_number.cast("bigint")
    return F.when(a.between(0, 99_999), y * 100_000 + a).when(a.isNotNull(), -(y * (1 << 32) + a)) \
            .otherwise(F.xxhash64(name, year))


def _merge(e: DataFrame, n: DataFrame, on: list[str], now: dt.datetime) -> DataFrame:
    """Full outer merge of stored rows ``e`` with collapsed batch rows ``n``:
    the batch sets the name, a NULL url/html_path keeps the stored one, ids
    and creation times stay."""
    e, n = e.alias("e"), n.alias("n")
    cond = [F.col(f"e.{k}") == F.col(f"n.{k}") for k in on]
    m = e.join(n, cond, "full_outer")
    year = F.coalesce(F.col("e.year"), F.col("n.year"))
    act = F.coalesce(F.col("e.act_number"), F.col("n.act_number"))
    return m.select(
        F.coalesce(F.col("e.law_id"), F.col("n.law_id")).alias("law_id"),
        F.coalesce(F.col("n.name"), F.col("e.name")).alias("name"), year.alias("year"), act.alias("act_number"),
        F.coalesce(F.col("n.url"), F.col("e.url")).alias("url"),
        F.coalesce(F.col("n.html_path"), F.col("e.html_path")).alias("html_path"),
        F.coalesce(F.col("e.created_at"), F.lit(now).cast("timestamp_ntz")).alias("created_at"))


def _collapse(b: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """In-batch conflicts: last name, last non-NULL url and html_path."""
    return b.groupBy(*keys).agg(
        F.max_by("name", arrival).alias("name"),
        F.max_by("url", F.when(F.col("url").isNotNull(), F.col(arrival))).alias("url"),
        F.max_by("html_path", F.when(F.col("html_path").isNotNull(), F.col(arrival))).alias("html_path"))


def upsert_laws(existing: DataFrame, batch: DataFrame, arrival: str,
                now: dt.datetime | None = None) -> DataFrame:
    """SNK2: insert or update laws on (year, act_number).

    Within the batch the last row per key sets the name and the last
    non-NULL url/html_path (as row-by-row ON CONFLICT would); against the
    table, a NULL url/html_path keeps the stored one and ids stay.  A row
    with a NULL act number has no natural key; its id is
    ``xxhash64(name, year)`` and it merges on that id, so re-running a batch
    never duplicates it (the row store would insert it again).
    """
    now = now or dt.datetime(2024, 1, 1)
    keys = ["year", "act_number"]
    b = batch.withColumn("url", F.nullif(F.col("url"), F.lit("")))
    keyed = _collapse(b.filter(F.col("act_number").isNotNull()), keys, arrival)
    keyed = keyed.withColumn("law_id", derived_law_id(F.col("year"), F.col("act_number"), F.col("name")))
    loose = b.filter(F.col("act_number").isNull()) \
             .withColumn("law_id", derived_law_id(F.col("year"), F.col("act_number"), F.col("name")))
    loose = _collapse(loose, ["law_id", "year", "act_number"], arrival)
    e_keyed = existing.filter(F.col("act_number").isNotNull())
    e_loose = existing.filter(F.col("act_number").isNull())
    return _merge(e_keyed, keyed, keys, now).unionByName(_merge(e_loose, loose, ["law_id"], now))


def replace_sections(existing: DataFrame, batch: DataFrame, key: str = "law_id",
                     laws: DataFrame | None = None) -> DataFrame:
    """SNK3: every re-ingested law loses all its old rows and gets the
    new ones; other laws are untouched (re-running is a no-op).

    ``laws`` lists the re-ingested ids (a law may come back with no rows);
    by default the ids present in ``batch``."""
    touched = (laws if laws is not None else batch).select(key).distinct()
    return existing.join(touched, key, "left_anti").unionByName(batch)


def new_rows(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``after`` that were not in ``before`` (multiset difference,
    ``EXCEPT ALL``): what an ingest added."""
    return after.exceptAll(before.select(*after.columns))


def cascade_delete(laws: DataFrame, sections: DataFrame, ids: DataFrame,
                   key: str = "law_id") -> tuple[DataFrame, DataFrame]:
    """SNK10: drop laws by id and, by the foreign key, their sections."""
    ids = ids.select(key).distinct()
    return laws.join(ids, key, "left_anti"), sections.join(ids, key, "left_anti")


def apply_ratings(results: DataFrame, ratings: DataFrame, arrival: str,
                  rated_at: dt.datetime | None = None) -> DataFrame:
    """SNK9: set rating + rated_at by id; the last valid rating per id wins,
    unknown ids and ratings outside the domain are ignored."""
    rated_at = rated_at or dt.datetime(2024, 1, 1)
    valid = ratings.filter(F.col("rating").isin(*[r for r in RATINGS if r != "unrated"]))
    last = valid.groupBy("id").agg(F.max_by("rating", arrival).alias("_rating"))
    j = results.join(last, "id", "left")
    return j.select(*[c for c in results.columns if c not in ("rating", "rated_at")],
                    F.coalesce(F.col("_rating"), F.col("rating")).alias("rating"),
                    F.when(F.col("_rating").isNotNull(), F.lit(rated_at).cast("timestamp_ntz"))
                     .otherwise(F.col("rated_at")).alias("rated_at"))


def dense_ids(batch: DataFrame, order: str, start: "F.Column | int" = 0, name: str = "id") -> DataFrame:
    """``start + 1, start + 2, ..`` in ``order`` (unique), by ranges of it: gaps in the
    order cost nothing."""
    start_col = start if not isinstance(start, int) else F.lit(start).cast("bigint")
    return numbered(batch, [], [F.col(order)], "_n").withColumn(name, start_col + F.col("_n")).drop("_n")


def append_evals(existing: DataFrame, batch: DataFrame, order: str,
                 now: dt.datetime | None = None) -> DataFrame:
    """SNK6: append eval rows with ids ``max(id) + 1 ..`` in ``order``;
    rating starts 'unrated'."""
    now = now or dt.datetime(2024, 1, 1)
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()  # scalar subquery
    b = dense_ids(batch, order, 0, "_k")
    new = b.select(
        (top + F.col("_k")).alias("id"),
        *[F.col(c) for c in batch.columns if c != order],
        F.lit("unrated").alias("rating"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("rated_at"))
    return new


def write_table(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Write ``df`` to a staging folder beside ``path``, then move it there.

    Beside the target the move is a rename on one file system (HDFS/local;
    object stores would use a table format instead).  Every rename is
    checked; if the new table cannot take the old one's place, the old one is
    put back.  An append moves the staged files into the folders of their
    partitions.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    dst = Path(path)
    tag = f"{dt.datetime.now():%Y%m%d%H%M%S%f}"
    src, old = (Path(dst.getParent(), f"_{dst.getName()}-{kind}-{tag}") for kind in ("new", "old"))
    fs = dst.getFileSystem(conf)
    fs.mkdirs(dst.getParent())
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(src.toString())
    if mode == "append" and fs.exists(dst):
        _move_files(fs, Path, src, dst, tag)
        fs.delete(src, True)
        return path
    had = fs.exists(dst)
    if had:
        _rename(fs, dst, old)
    try:
        _rename(fs, src, dst)
    except OSError:
        if had:
            _rename(fs, old, dst)
        raise
    if had:
        fs.delete(old, True)
    return path


def _rename(fs, src, dst) -> None:
    if not fs.rename(src, dst):
        raise OSError(f"cannot rename {src.toString()} to {dst.toString()}")


def _move_files(fs, Path, src, dst, tag: str) -> None:
    """Move the data files below ``src`` into the same folders below ``dst``."""
    fs.mkdirs(dst)
    for st in fs.listStatus(src):
        name = st.getPath().getName()
        if st.isDirectory():
            _move_files(fs, Path, st.getPath(), Path(dst, name), tag)
        elif not name.startswith("_"):
            _rename(fs, st.getPath(), Path(dst, f"{tag}-{name}"))
