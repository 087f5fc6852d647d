"""Helpers shared by the operators: session limits, shared work folder,
connected components and byte-level text arithmetic for Arrow batches."""
from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 256
CHUNK_BYTES = 1 << 20
SALTS = 16
#: tasks that gather a bitmap, which has a fixed size
WORD_TASKS = 24
WS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored table; Python tasks get Arrow batches of ``BATCH_ROWS`` rows
    so that a batch of very long texts stays small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.set(key, str(BATCH_ROWS))


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` from the struct ``row``, with ``text`` as the text and, where there is
    an ``n_chars``, its length in code points."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))


class Work:
    """A fresh folder under the shared checkpoint folder for tables that cut
    lineage.  Only a local session without ``spark.checkpoint.dir`` may use a
    temp folder."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="lexframe-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def cut(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return the stored table."""
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._stored_at)
            p.getFileSystem(conf).delete(p, True)


def components(work: Work, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, comp)``: each node of a component
    but its smallest one, and that one, by alternating large-star and small-star rounds.
    Each round is two salted joins on the node, so a hub with a third of all edges is
    spread over ``SALTS`` tasks."""
    e, stored = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), []
    while not stored or not _settled(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, both, False)
        e = work.cut(_star(large, large, True).distinct(), "edges")
        work.drop(*stored)
        stored = [e]
    out = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out._stored_at = e._stored_at
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none."""
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(n).alias("hung")) for c, n in (("a", 1), ("b", 0))))).alias("e"))
    per = ends.groupBy("e.node").agg(F.sum("e.hung").alias("hung"), F.count("*").alias("ends"))
    return per.filter("hung > 0 AND ends > 1").agg(F.count("*")).first()[0] == 0


def _star(nbr: DataFrame, rows: DataFrame, small: bool) -> DataFrame:
    """Large star: each neighbour ``b > a`` of ``a`` is hung on ``a``'s smallest
    neighbour.  Small star: each ``b < a`` and ``a`` itself, which goes with the row of
    the smallest one.  At most one row for each of ``rows``."""
    least = nbr.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    spread = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = rows.filter("b < a" if small else "b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hung = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")) if small else F.col("b")
    return salted.join(spread, ["a", "salt"]).select(hung.alias("a"), F.col("m").alias("b"))


# ---- bytes of texts in numpy ------------------------------------------------
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the polynomial base and its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) <= n:
            for name, base in (("up", BASE), ("down", BASE_INV)):
                p = np.full(n + 1, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up, self.down


def prefix_hash(buf: np.ndarray, powers: Powers) -> np.ndarray:
    """``out[j]`` is the sum of ``(byte i + 1) * BASE**i`` for ``i < j``."""
    up, _ = powers.to(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the bytes ``[start, end)``, the same wherever they stand."""
    _, down = powers.to(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


#: longer spans are hashed from their bytes: two that differ in a pattern of 1024 bytes and
#: more can have one polynomial hash modulo 2**64 whatever the base
LONG_SPAN = 256


def text_hash(buf: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """``span_hash`` of words or lines of any length."""
    out = span_hash(prefix, start, end, powers)
    for i in np.flatnonzero(end - start > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chunks(texts: pa.Array):
    """``(first row, last row + 1, bytes, offsets)`` pieces of whole texts of
    about ``CHUNK_BYTES`` (a longer text is a piece of its own); null texts are
    empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    if n == 0:
        return
    _, off_buf, data = texts.buffers()
    off = np.frombuffer(off_buf, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        texts = texts.fill_null(b"")
        yield from chunks(texts)
        return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, off: np.ndarray):
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the first word of
    each text (one more entry than texts)."""
    solid = ~_IS_WS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


class Bitmap:
    """A fixed-size set of 64-bit hashes, by their low bits; it may claim values it
    was not given.  Its words are all that the driver gets, however many values."""

    def __init__(self, values: DataFrame, column: str, bits: int = 23):
        self.bits, self.map = bits, np.zeros(1 << (bits - 6), np.uint64)
        got = bitmap_words(values, column, bits).toArrow()
        self.map[got.column("w").to_numpy()] = got.column("v").to_numpy().astype(np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        slot = x.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.map[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def bitmap_words(values: DataFrame, column: str, bits: int) -> DataFrame:
    """``(w, v)``: the words of a bitmap of ``2**bits`` bits with those of ``values`` set."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    return values.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("s")) \
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("v"))


def maybe_among(rows: DataFrame, key, values: DataFrame, column: str, bits: int = 20) -> DataFrame:
    """The rows whose 64-bit hash ``key`` may be among ``values``: all that are, and a
    few that are not.  The broadcast side has at most ``2**bits / 64`` words."""
    slot = key.bitwiseAND(F.lit((1 << bits) - 1))
    words = bitmap_words(values, column, bits).coalesce(WORD_TASKS).select(F.col("w").alias("_w"), F.col("v").alias("_v"))
    out = rows.join(F.broadcast(words), F.shiftright(slot, 6) == F.col("_w"))
    bit = F.call_function("shiftrightunsigned", F.col("_v"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return out.filter(bit.bitwiseAND(F.lit(1)) == 1).drop("_w", "_v")
