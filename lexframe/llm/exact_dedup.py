"""Exact dedup by progressive refinement.

Two texts are equal when they are identical without white space.  Each pass reads
the texts once and keeps only the rows that are still undecided:

1. rows are grouped by the length of their text without white space;
2. rows whose length repeats are grouped by length and a hash of the first
   ``PREFIX`` bytes;
3. only rows whose prefix repeats too have their full content hashed (SHA-256), and
   rows with equal length, prefix and full hash are one group.

Which lengths and prefixes repeat is told to the tasks by a bitmap that has
``BITS_EACH`` bits per value (a power of two, ``MOST_BITS`` at most); what it lets
through by chance has its content hashed for nothing, never joins a group.  All that
is shuffled are lengths and hashes.  A group is found by map-side aggregates and told
to its rows through ``SALTS`` copies, so a third of all rows in one group is spread.

Defined results: a null text equals an empty one and texts of white space alone; of
equal texts the row with the most code points stays, then the smallest ``doc_id``
(null last), then the least hash of the text, then one of the rows that repeat id and
text; repeated rows count each; an empty table gives no rows; extra columns are kept
by ``one_per_text`` and not read otherwise.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_WS, SALTS, Bitmap, Work, chunks, mix, read_table
from .registry import register

PREFIX = 128
BITS_EACH = 16
LEAST_BITS = 16
MOST_BITS = 25


def _without_space(texts: pa.Array):
    """``(bytes, offsets)`` of texts without their white space, in pieces."""
    for _, _, buf, off in chunks(texts):
        solid = ~_IS_WS[buf]
        before = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(solid, out=before[1:])
        yield buf[solid], before[off]


def _slot(size: np.ndarray) -> np.ndarray:
    """A length, scrambled one to one for the bitmap."""
    return mix(size.astype(np.uint64))


def _length_rows(batches):
    for b in batches:
        sizes = [np.zeros(0, np.int64), *(np.diff(off) for _, off in _without_space(b.column("text")))]
        yield pa.RecordBatch.from_arrays([pa.array(_slot(np.concatenate(sizes)).astype(np.int64))], names=["size"])


def _prefixes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of the length and the first bytes of each text."""
    raw = buf.tobytes()
    crc = np.array([zlib.crc32(raw[a:min(b, a + PREFIX)]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
    return mix(_slot(np.diff(off)) ^ crc)


def _prefix_rows(same_size: Bitmap):
    def run(batches):
        for b in batches:
            out = [np.zeros(0, np.uint64)]
            for buf, off in _without_space(b.column("text")):
                out.append(_prefixes(buf, off)[same_size(_slot(np.diff(off)))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64))], names=["prefix"])
    return run


def _content_rows(same_size: Bitmap, same_prefix: Bitmap, digests: bool):
    def run(batches):
        for b in batches:
            size, prefix, full, open_ = [], [], [], []
            for buf, off in _without_space(b.column("text")):
                first = _prefixes(buf, off)
                hashed = same_size(_slot(np.diff(off))) & same_prefix(first)
                raw = memoryview(buf)
                full += [hashlib.sha256(raw[s:e]).hexdigest() if digests or h else None
                         for s, e, h in zip(off[:-1].tolist(), off[1:].tolist(), hashed.tolist())]
                size.append(np.diff(off))
                prefix.append(first.astype(np.int64))
                open_.append(hashed)
            if not size:
                continue
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), b.column("chars"), pa.array(np.concatenate(size)), pa.array(np.concatenate(prefix)),
                 pa.array(full, pa.string()), pa.array(np.concatenate(open_))],
                names=["doc_id", "th", "chars", "size", "prefix", "full", "hashed"])
    return run


def _bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))


def _repeated(work: Work, rows: DataFrame, column: str) -> Bitmap:
    """A bitmap of the values that stand in two rows or more."""
    twice = work.cut(rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").select(column), column)
    out = Bitmap(twice, column, _bits(twice.count()))
    work.drop(twice)
    return out


def exact_copies(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``(doc_id, th, keep_id, group_size, kept, full)`` of every row of ``docs(doc_id,
    text)``: ``th`` is ``xxhash64`` of the text, ``full`` the hex SHA-256 of the text
    without white space where the third pass needed it (of every row with ``digests``)."""
    work = Work(docs.sparkSession, "copies")
    kind = dict(docs.dtypes)["doc_id"]
    text = docs.select("text")
    same_size = _repeated(work, text.mapInArrow(_length_rows, "size long"), "size")
    same_prefix = _repeated(work, text.mapInArrow(_prefix_rows(same_size), "prefix long"), "prefix")
    facts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), "text") \
        .mapInArrow(_content_rows(same_size, same_prefix, digests),
                    f"doc_id {kind}, th long, chars long, size long, prefix long, full string, hashed boolean")
    facts = work.cut(facts.withColumn("rid", F.monotonically_increasing_id()), "rows")
    return _decided(facts)


def _decided(facts: DataFrame) -> DataFrame:
    key = ["size", "prefix", "full"]
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "rid")
    groups = facts.filter("hashed").groupBy(*key).agg(F.count("*").alias("group_size"), F.min(best).alias("best")).filter("group_size > 1") \
        .withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = facts.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    found = rows.join(groups, [*key, "salt"], "left")
    alone = F.col("group_size").isNull()
    return found.select("doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        (alone | (F.col("best.rid") == F.col("rid"))).alias("kept"), "full")


def one_per_text(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat id and
    text are one."""
    def key(*more):
        return (F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), *more)
    stay = exact_copies(docs.select("doc_id", "text")).filter("kept").select(*key("th")).distinct()
    d = docs.select(F.struct(*docs.columns).alias("row"), *key(F.xxhash64("text").alias("th")))
    return d.join(stay, ["k_id", "th"], "left_semi").dropDuplicates(["k_id", "th"]).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     o AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, text_sha256 FROM o
"""


@register("op11_exact_dedup", SQL)
def op11_exact_dedup(spark, sf_dir):
    out = exact_copies(read_table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full").alias("text_sha256"))
