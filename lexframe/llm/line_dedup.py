"""Line dedup by levelled sorted runs of line hashes (DataFrame functions only).

The corpus arrives in batches of documents.  The index is a family of runs, each
a stored table ``(h1, h2, n_docs)`` sorted by the 128-bit line hash.  A batch is
merge-anti-joined with the entries that already reached the limit (their fate is
settled, so their counts need not grow) and adds a run of its own; when
``FANOUT`` runs stand on a level they are compacted into one run of the next
level.  In the end a key's documents are the sum over the runs.

Defined results: a null text is one empty line, an empty key is never dropped,
rows with a null ``doc_id`` count as one document, rows with equal ``doc_id``
as one document; each row keeps its own lines.  Extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, WS, Work, read_table, with_text
from .registry import register

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line):
    """The line without white space at both ends, A-Z lower-cased."""
    t = F.btrim(line, F.lit(WS))
    ascii_only = F.octet_length(t) == F.length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs by level; ``levels[k]`` holds the runs compacted ``k`` times."""

    def __init__(self, work: Work, min_docs: int):
        self.work, self.min_docs, self.levels = work, min_docs, [[]]

    def all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch(h1, h2, n_docs)``: the documents of one batch per line hash."""
        known = self.all()
        if known is not None:
            full = known.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= self.min_docs)
            batch = batch.join(full, ["h1", "h2"], "left_anti")
        self._put(0, batch)

    def _put(self, level: int, rows: DataFrame) -> None:
        run = self.work.cut(rows.sortWithinPartitions("h1", "h2"), f"run-{level}")
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = [*self.levels[level], run]
        if len(self.levels[level]) >= FANOUT:
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for r in old[1:]:
                merged = merged.unionByName(r)
            self._put(level + 1, merged.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")))
            self.work.drop(*old)

    def frequent(self) -> DataFrame:
        return self.all().groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= self.min_docs) \
            .select("h1", "h2")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                  batches: int = BATCHES) -> DataFrame:
    """``(doc_id, text_hash, dropped)``: the 0-based positions of the lines that a
    row loses; rows that lose none are absent."""
    work = Work(docs.sparkSession, "lines")
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    keys = keys.filter(F.length("key") >= max(1, min_chars)).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    keys = work.cut(keys, "lines", partition_by="batch")
    runs = LineRuns(work, min_docs)
    for i in range(batches):
        of = keys.filter(F.col("batch") == i).select("h1", "h2", "doc_id").distinct()
        runs.add(of.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")))
    frequent = runs.frequent().withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    hits = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")) \
        .join(frequent, ["h1", "h2", "salt"], "left_semi")
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row`` (all columns of ``docs`` but ``text``), ``kept_text``, ``n_lines`` and
    ``n_dropped`` of every row."""
    d = docs.select(F.struct("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("row"), "doc_id", "text")
    hit = dropped_lines(docs.select("doc_id", "text"), min_docs, min_chars).select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "dropped")
    lines = lines_of(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")),
                       lambda i: F.get(lines, i))
    return d.join(hit, d["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(d["text"]) == hit["hit_hash"]), "left").select(
        "row", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce(F.col("text"), F.lit("")))
         .otherwise(F.array_join(kept, "\n")).alias("kept_text"))


def without_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as text."""
    return with_text(dedup_lines(docs, min_docs, min_chars), docs.columns, "kept_text")


SQL = r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line,
                  translate(trim(lines[i], chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) s,
                generate_series(1, len(lines)) t(i)),
     f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
     j AS (SELECT l.*, f.key IS NOT NULL AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@register("op4_line_dedup", SQL)
def op4_line_dedup(spark, sf_dir):
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
