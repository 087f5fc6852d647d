"""Running aggregates over ordered rows that survive one huge key.

A window ``partitionBy(key).orderBy(seq)`` puts every row of a key into one
task.  One act (or one parent node) can hold a large share of all rows, so
the scan here splits each key into chunks of ``chunk_rows`` consecutive
``seq`` values and runs in two levels:

1. per ``(key, chunk)``: a partial aggregate (map-side combined) gives one
   summary row per chunk;
2. per key: an exclusive running aggregate over the chunk summaries (tiny:
   one row per chunk) gives what every earlier chunk contributes;
3. per ``(key, chunk)``: the in-chunk running window, combined with the
   carried-in prefix.

Only associative operations are allowed: ``max`` (latest-wins values are
expressed as ``max(struct(seq, value))``) and ``sum``.  The rows are
shuffled once, on ``(key, chunk)``; summaries, prefix join and window all
reuse that exchange.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DEFAULT_CHUNK_ROWS = 1 << 16


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``op`` of ``expr`` over earlier rows.

    ``inclusive`` adds the current row to the frame.  ``op`` is ``max`` or
    ``sum``; ``sum`` results are never NULL (0 when nothing is summed).  A ``late``
    expression is cheap and reads kept columns only: it is evaluated on the stored
    rows, so its values are not shuffled or checkpointed.
    """
    name: str
    expr: Column
    op: str = "max"
    inclusive: bool = False
    late: bool = False

    @property
    def value(self) -> Column:
        return self.expr if self.late else F.col(f"_v_{self.name}")


def _agg(op: str, c: Column) -> Column:
    if op == "max":
        return F.max(c)
    if op == "sum":
        return F.sum(c)
    raise ValueError(f"unsupported running op {op!r}")


def chunked(df: DataFrame, keys: list[str], order: str, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and hash-partition by ``(keys, _chunk)``: the layout
    :func:`running` works on.  Expensive per-row work placed after this runs
    with full parallelism on the shuffled, narrow input."""
    c = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_rows)).cast("bigint"))
    return c.repartition(*keys, "_chunk")


def running(df: DataFrame, keys: list[str], order: str, specs: list[Running],
            chunk_rows: int = DEFAULT_CHUNK_ROWS, materialize: bool = True,
            partitioned: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add one column per spec: its running aggregate within ``keys`` by ``order``.

    ``order`` must be an integral, unique-within-key column (the row number);
    ``keys`` must not be NULL (map a missing key to a sentinel first).

    The rows are shuffled once, by ``(keys, chunk)``; the chunk summaries
    are aggregated from that same exchange (Spark reuses it, so the input is
    computed once), the tiny per-key prefix is joined back on
    ``(keys, chunk)`` without moving the rows again, and the in-chunk window
    runs on the same partitioning.

    The input is read by two branches (summaries and rows), and scans are
    chained (parent -> position, ids -> next), so unmaterialized inputs would
    be recomputed once per reference, level after level.  With
    ``materialize`` (default) the shuffled rows are checkpointed (reliably, into
    ``spark.checkpoint.dir``) so an expensive input is computed once and its
    lineage is cut; the checkpoint keeps the ``(keys, chunk)`` partitioning,
    so neither branch shuffles again.  ``partitioned`` says ``df`` came
    from :func:`chunked` with the same ``chunk_rows`` (no second shuffle).
    ``drop`` names input columns only the spec expressions read: they are
    removed once the specs are evaluated, before any shuffle or checkpoint.
    """
    chunk = "_chunk"
    cols = [c for c in df.columns if c != chunk and c not in drop]
    base = df if partitioned else df.withColumn(chunk, F.floor(F.col(order) / F.lit(chunk_rows)).cast("bigint"))
    for s in specs:
        if not s.late:
            base = base.withColumn(f"_v_{s.name}", s.expr)
    base = base.drop(*drop)
    part = base if partitioned else base.repartition(*keys, chunk)
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        part = part.checkpoint(eager=True)

    # (1) chunk summaries from the shuffled rows (already clustered)
    summary = part.groupBy(*keys, chunk).agg(
        *[_agg(s.op, s.value).alias(f"_s_{s.name}") for s in specs])
    # (2) exclusive prefix over earlier chunks of the same key (one row per chunk)
    wk = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select(
        *keys, chunk, *[_agg(s.op, F.col(f"_s_{s.name}")).over(wk).alias(f"_p_{s.name}") for s in specs])
    # (3) in-chunk running window plus the carried prefix
    joined = part.join(prefix, on=[*keys, chunk], how="left")
    out = []
    for s in specs:
        w = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(
            Window.unboundedPreceding, 0 if s.inclusive else -1)
        local = _agg(s.op, s.value).over(w)
        carried = F.col(f"_p_{s.name}")
        if s.op == "max":
            val = F.greatest(local, carried)
        else:
            val = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        out.append(val.alias(s.name))
    return joined.select(*[F.col(c) for c in cols], *out)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "list_no") -> DataFrame:
    """Add ``name``: each row's place (from 1) within ``keys`` in any total ``order``.

    The rows are dealt to ranges of ``(keys, order)`` and checkpointed there; the rows of
    each key are counted per range, and a row's place is its place in the range plus the
    counts of the ranges before.  So one key of any size, or no key at all, is numbered
    by as many tasks as it fills ranges, and gaps in the order cost nothing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    part = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    counts = part.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = part.withColumn("_place", place).join(counts, on)
    return out.select(*df.columns, (F.col("_place") + F.col("_before")).cast("bigint").alias(name))
