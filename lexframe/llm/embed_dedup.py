"""Embedding near-dedup with randomised-rotation binary codes.

Vectors that are equal bit for bit form a class; what follows works on classes.  A
class's unit vector is turned by a seeded random rotation.  Stored are the signs, one
bit a dimension, the correction factor (the product of the unit vector with its own
code), and the turned vector rounded to ``LEVELS`` steps by a seeded dither, as bit
planes.  Counting common bits of one vector's code and another's planes gives, over the
factor, an unbiased estimate of their cosine with a confidence bound.

Bands of code bits of more rotations choose the pairs to look at; their width grows
with the logarithm of the number of classes and their number keeps the chance to
miss a pair at the threshold under ``MISS``.  The first pass over the buckets moves
codes only and keeps the rows with a partner whose upper bound reaches the threshold.
Only for these rows do the vectors follow to the same buckets, where the pairs that
pass the bound are computed exactly in double precision.  ``exact=True`` leaves bands
and bounds out and computes every pair of a label, in pairs of blocks.

A bucket of more than ``BLOCK`` classes is dealt to pairs of blocks.  A block counts
links and hands on a spanning forest, never its pairs; a pair that meets in more
bands counts in the first.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose label is null, link with nothing; vectors of different length
do not link; rows that repeat a ``vec_id`` are vectors of their own; extra columns
are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, components, read_table
from .registry import register

THRESHOLD = 0.93
MISS = 0.003
#: confidence of the bound, in deviations of the estimate
SURE = 3.5
#: bit planes of a rounded vector
PLANES = 4
LEVELS = (1 << PLANES) - 1
BLOCK = 2048
DENSE = 64
SEED = 11
MIN_BITS, MAX_BITS = 8, 24


def rotation(dim: int, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k``-th random rotation of ``dim`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of bands for ``n`` vectors."""
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(n, 2))) - 3))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """``bands`` keys per row from the signs of as many rotations as it takes."""
    dim = unit.shape[1]
    turns = -(-bits * bands // dim)
    signs = np.concatenate([unit @ rotation(dim, k).T > 0 for k in range(turns)], axis=1)[:, :bits * bands]
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs.reshape(len(unit), bands, bits) @ weights


def factors(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, their codes (+-1 / sqrt(dim)) and correction factors."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 0).T
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
    return turned, code, np.einsum("ij,ij->i", turned, code)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, figures)`` of each row: the words of its code and of its ``PLANES``
    planes; factor, least value and step of the rounding."""
    dim = unit.shape[1]
    turned, code, factor = factors(unit)
    least = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - least, 1e-300) / LEVELS
    dither = np.random.default_rng([SEED, dim, 1 << 20]).random(dim)
    level = np.clip(np.floor((turned - least[:, None]) / step[:, None] + dither), 0, LEVELS).astype(np.uint8)
    words = [packed(code > 0), *(packed((level >> k) & 1) for k in range(PLANES))]
    return np.concatenate(words, axis=1), np.stack([factor, least, step], axis=1)


class Codes:
    """Stored codes of ``dim`` dimensions and the bounds that they give."""

    def __init__(self, words: np.ndarray, figures: np.ndarray, dim: int, threshold: float):
        width = words.shape[1] // (PLANES + 1)
        self.words, self.planes = words[:, :width], words[:, width:].reshape(len(words), PLANES, width)
        self.factor, self.least, self.step = figures.T
        self.dim, self.threshold = dim, threshold
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.levels = (np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64) << np.arange(PLANES)).sum(axis=1)
        deviation = np.maximum(0, 1 - self.factor ** 2) / max(dim - 1, 1)
        self.slack = SURE * np.sqrt(deviation) / self.factor
        if dim < 8:  # too few dimensions for a bound
            self.slack[:] = np.inf

    def estimates(self, a, b) -> np.ndarray:
        """Estimated cosines of the rows ``a`` with ``b``, index arrays that broadcast."""
        common = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.int64)
        for k in range(PLANES):
            for w in range(self.words.shape[1]):
                common += np.bitwise_count(self.words[a, w] & self.planes[b, k, w]).astype(np.int64) << k
        total = self.least[b] * (2 * self.ones[a] - self.dim) + self.step[b] * (2 * common - self.levels[b])
        return total / math.sqrt(self.dim) / self.factor[a]

    def near(self, a, b) -> np.ndarray:
        """Which pairs may reach the threshold."""
        rounding = SURE * self.step[b] / 2 / self.factor[a]
        return self.estimates(a, b) + np.hypot(self.slack[a], rounding) >= self.threshold


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _sign_rows(bits: int, bands: int):
    """Codes and band keys of each vector; no bands put all vectors into one bucket."""
    def run(batches):
        for b in batches:
            vec = b.column("vec")
            lens = np.array([len(v) for v in vec]) if len(vec) else np.zeros(0, int)
            keys: list = [None] * len(vec)
            code: list = [None] * len(vec)
            figures = np.zeros((len(vec), 3))
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                m = _matrix(vec.take(pa.array(at)))
                unit = m / np.linalg.norm(m, axis=1, keepdims=True)
                words, figures[at] = codes(unit)
                band = band_keys(unit, bits, bands) if bands else np.zeros((len(unit), 1), int)
                for i, k, w in zip(at, band, words):
                    keys[i], code[i] = k, w.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("grp"), b.column("n"), vec, pa.array(keys, pa.list_(pa.int32())), pa.array(code, pa.binary()),
                 pa.array(lens, pa.int32()), *(pa.array(f) for f in figures.T)],
                names=["node", "grp", "n", "vec", "keys", "code", "dim", *FIGURES])
    return run


FIGURES = ("factor", "least", "step")
CODE = ["code", "dim", *FIGURES]


def stored_codes(table: pa.Table, threshold: float) -> Codes:
    """The codes of rows of one length."""
    words = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    return Codes(words, np.stack([table.column(f).to_numpy() for f in FIGURES], axis=1), int(table.column("dim")[0].as_py()), threshold)


class Marks:
    """First pass: marks the rows with a partner that passes the bound."""

    def __init__(self, table: pa.Table, threshold: float):
        self.codes, self.table = stored_codes(table, threshold), table
        self.marked = np.zeros(table.num_rows, bool)

    def pairs(self, i, j):
        self.link(*(x[self.codes.near(i, j)] for x in (i, j)))

    def link(self, i, j):
        self.marked[i] = self.marked[j] = True

    def dense(self, a, b, same: bool):
        for lo in range(0, len(a), 256):
            part = a[lo:lo + 256]
            i, j = np.nonzero(self.codes.near(part[:, None], b[None, :]))
            i, j = part[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            self.link(i, j)

    def result(self) -> pa.RecordBatch:
        out = self.table.select(["node", *PLACE]).filter(pa.array(self.marked)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns], names=out.column_names)


class Bucket(Marks):
    """Second pass: the exact cosines of the pairs that pass the bound (of all pairs, where
    ``bound`` is false)."""

    def __init__(self, table: pa.Table, threshold: float, bound: bool = True):
        super().__init__(table, threshold)
        if not bound:
            self.codes.slack[:] = np.inf
        self.threshold = threshold
        self.node = table.column("node").to_numpy()
        self.n = table.column("n").to_numpy()
        self.band = table.column("band").to_numpy()
        self.keys = _ints(table.column("keys"))
        raw = _matrix(table.column("vec").combine_chunks())
        self.unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        self.links = np.zeros(len(self.node), np.int64)
        self.root = np.arange(len(self.node))

    def link(self, i, j):
        """Exact cosine of pairs that may link; a pair counts in its first band."""
        for lo in range(0, len(i), 100_000):
            a, b = i[lo:lo + 100_000], j[lo:lo + 100_000]
            ok = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= self.threshold
            a, b = a[ok], b[ok]
            ok = (self.keys[a] == self.keys[b]).argmax(axis=1) == self.band[a]
            a, b = a[ok], b[ok]
            self.links += np.bincount(a, self.n[b], len(self.n)).astype(np.int64) + np.bincount(b, self.n[a], len(self.n)).astype(np.int64)
            while True:
                low = np.minimum(self.root[a], self.root[b])
                before = self.root.copy()
                for x in (a, b, self.root[a], self.root[b]):
                    np.minimum.at(self.root, x, low)
                self.root = self.root[self.root]
                if (before == self.root).all():
                    break

    def result(self) -> pa.RecordBatch:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        at = np.flatnonzero(self.links)
        return pa.RecordBatch.from_arrays([pa.array(self.node[at]), pa.array(self.links[at]), pa.array(self.node[self.root[at]])], names=["node", "links", "root"])


def _ints(col) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy().reshape(len(col), -1)


#: where a row is compared: its bucket, its block and the pair of blocks
PLACE = ["grp", "band", "key", "bi", "bj", "blk"]


def _compare(make):
    """Walks the buckets of each task and hands their pairs to ``make(rows)``."""
    cols = PLACE[:5]

    def buckets(table: pa.Table):
        ids = np.stack([table.column(c).to_numpy() for c in cols])
        return np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [table.num_rows]])

    def work(table: pa.Table):
        lens = table.column("dim").to_numpy()
        for dim in np.unique(lens):  # a group has one length; groups may differ
            yield from one(table.filter(pa.array(lens == dim)))

    def one(table: pa.Table):
        edge = buckets(table)
        b = make(table)
        bi, bj, blk = (table.column(c).to_numpy() for c in ("bi", "bj", "blk"))
        size = np.repeat(np.diff(edge), np.diff(edge))
        first = np.repeat(edge[:-1], np.diff(edge))
        small = (size <= DENSE) & (bi == bj)
        at = np.arange(table.num_rows)
        for k in range(1, DENSE):
            i = at[small & (at - first + k < size)]
            if not len(i):
                break
            b.pairs(i, i + k)
        for lo, hi in zip(edge[:-1], edge[1:]):
            if not small[lo]:
                rows = at[lo:hi]
                if bi[lo] == bj[lo]:
                    b.dense(rows, rows, True)
                else:
                    b.dense(rows[blk[lo:hi] == bi[lo]], rows[blk[lo:hi] == bj[lo]], False)
        yield b.result()

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * BLOCK:
                table = pa.Table.from_batches(held)
                last = buckets(table)[-2]
                if last:
                    yield from work(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
                    rows = table.num_rows - last
        if rows:
            yield from work(pa.Table.from_batches(held))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of ``vectors(vec_id, embedding, label)``.
    ``exact`` computes every pair of a label: no link can be missed, at quadratic cost."""
    spark = vectors.sparkSession
    work = Work(spark, "vectors")
    v = vectors.select("vec_id", "label", "embedding")
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    solid = F.col("label").isNotNull() & F.coalesce(finite & F.exists(x, lambda e: e != 0), F.lit(False))
    v = v.withColumn("solid", solid).withColumn("node", F.when(F.col("solid"), F.xxhash64("label", "embedding", F.size("embedding"))))
    good = v.filter("solid")
    width = F.size("embedding")
    cls = good.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first(x).alias("vec"),
                                   F.first(F.xxhash64("label", width)).alias("grp"))
    cls = work.cut(cls, "classes")
    bits, bands = (0, 0) if exact else band_plan(cls.count(), threshold)
    signed = work.cut(cls.select("node", "grp", "n", "vec").mapInArrow(
        _sign_rows(bits, bands), "node long, grp long, n long, vec array<double>, keys array<int>, code binary, dim int, "
        + ", ".join(f"{f} double" for f in FIGURES)), "codes")
    keys = signed.select("node", "grp", F.posexplode("keys").alias("band", "key"))
    bucket = ["grp", "band", "key"]
    full = keys.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1")
    met = keys.join(full, bucket).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")) \
        .withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("node", "grp", "band", "key", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*(F.col(c) for c in PLACE[:5])).sortWithinPartitions(*PLACE[:5], "node")

    if not exact:
        kinds = dict(met.dtypes)
        met = dealt(met.join(signed.select("node", *CODE), "node")).mapInArrow(
            _compare(lambda t: Marks(t, threshold)), ", ".join(f"{c} {kinds[c]}" for c in ("node", *PLACE)))
        met = work.cut(met, "marked")
    rows = dealt(met.join(signed.select("node", "n", "vec", "keys", *CODE), "node"))
    found = work.cut(rows.mapInArrow(_compare(lambda t: Bucket(t, threshold, not exact)), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(work, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = cls.select("node", "n", "least").join(links, "node", "left").join(comp, "node", "left") \
        .withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    per = named.join(least, "comp").select("node", "n", "links", "component_id")
    out = v.select("vec_id", "node").join(per, "node", "left").select(
        "vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@register("op10_embed_dedup")
def op10_embed_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
