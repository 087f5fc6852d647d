"""SCL21/22, TXT2-TXT5, JN10/JN11, TOP1, AGG7: vectors and retrieval.

Exact cosine kNN of a question set against a whole corpus: both sides are dealt to
blocks of ``BLOCK_BYTES``, each pair of blocks meets in one task that keeps its top k
per question, and these are merged by question.  Nothing is broadcast and nothing
passes through the driver but two counts, whatever the sizes.  The approximate index
(TXT4) deals the corpus to k-means cells and lets each question meet the nearest ones.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import EMBED_TYPES
from ..functions.text import is_blank

#: doubles of one block of vectors that a task holds
BLOCK_BYTES = 16 << 20
#: scores that a task holds at a time
SCORES = 1 << 22
# scores that agree to so many digits are ties
SCORE_DIGITS = 12
#: the fit of the cells reads that many vectors, the fit of the probes that many questions
FIT_VECTORS = 20_000
FIT_QUESTIONS = 500


# ---------------------------------------------------------------- documents
def embed_docs(sections: DataFrame, laws: DataFrame) -> DataFrame:
    """SCL21/SCL22: sections and subsections with text -> embedding documents.

    ``text = "{law} — Section {ref}\\n{title}: {text}"`` (no ``title: `` when
    the title is empty); metadata of the six keys as a struct.
    """
    s = sections.filter(F.col("section_type").isin(*EMBED_TYPES) & ~is_blank(F.col("text_content")))
    j = s.join(laws.select("law_id", F.col("name").alias("law_name"), "year"), "law_id")
    title = F.when(F.coalesce(F.col("section_title"), F.lit("")) != "",
                   F.concat(F.col("section_title"), F.lit(": "))).otherwise(F.lit(""))
    text = F.concat(F.col("law_name"), F.lit(" — Section "), F.col("section_ref"), F.lit("\n"), title,
                    F.col("text_content"))
    meta = F.struct("law_id", "law_name", "year", "section_ref", "section_type",
                    F.coalesce(F.col("section_title"), F.lit("")).alias("section_title"))
    return j.select("law_id", "seq", text.alias("text"), meta.alias("metadata"))


def chunk_words(docs: DataFrame, text: str, size: int, overlap: int, keys: list[str]) -> DataFrame:
    """TXT2: windows of ``size`` words stepping ``size - overlap``; every word
    of the whole text is in some chunk (no prefix cut)."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    d = docs.select(*keys, words.alias("_w")).withColumn("_n", F.size("_w"))
    last = F.greatest(F.col("_n") - F.lit(overlap), F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last, F.lit(step))
    out = d.filter(F.col("_n") > 0).select(*keys, "_w", F.posexplode(starts).alias("chunk_no", "_s"))
    return out.select(*keys, F.col("chunk_no").cast("bigint").alias("chunk_no"),
                      F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(size)), " ").alias("chunk"),
                      F.least(F.size("_w") - F.col("_s"), F.lit(size)).cast("bigint").alias("n_words"))


# ---------------------------------------------------------------- vectors
def unit(col: Column) -> Column:
    """The vector scaled to length 1, in double; NULL for a zero vector."""
    d = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _topk(scored: DataFrame, k: int, q: str = "q_id", v: str = "vec_id") -> DataFrame:
    w = Window.partitionBy(q).orderBy(F.round("score", SCORE_DIGITS).desc(), F.col(v))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _vectors(df: DataFrame) -> DataFrame:
    """``(vec_id, embedding, dim)`` of the rows that have a direction: not null or empty,
    no null or non-finite component, not zero."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("_d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_d", lambda x: x != 0)
    return df.select("vec_id", d.alias("_d")).filter(F.col("_d").isNotNull() & F.coalesce(ok, F.lit(False))) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("_d").alias("embedding"), F.size("_d").alias("dim"))


def _blocks(vectors: DataFrame) -> int:
    """Number of blocks of ``BLOCK_BYTES`` that the vectors fill."""
    return max(1, -(-(vectors.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0) // BLOCK_BYTES))


def _dealt(vectors: DataFrame, blocks: int, name: str) -> DataFrame:
    """Each vector's block; rows that repeat are spread too."""
    return vectors.withColumn(name, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy()
    m = flat.reshape(table.num_rows, -1)
    return m / np.linalg.norm(m / np.abs(m).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(m).max(axis=1, keepdims=True)


def _block_top(k: int, drop_self: bool):
    """Top k corpus vectors per question of one pair of blocks, by slices of the corpus:
    a slice only adds what reaches the k-th best score so far."""
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("q_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        qid, cid = (t.column("vec_id").to_numpy() for t in (q, c))
        mq, mc = _matrix(q, "embedding"), _matrix(c, "embedding")
        row, vec, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(qid), -np.inf)
        step = max(1, SCORES // len(qid))
        for lo in range(0, len(cid), step):
            s, ids = mq @ mc[lo:lo + step].T, cid[lo:lo + step]
            if drop_self:
                s[qid[:, None] == ids[None, :]] = -np.inf
            near = np.round(s, SCORE_DIGITS)
            if near.shape[1] >= k:
                floor = np.maximum(floor, -np.partition(-near, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((near >= floor[:, None]) & (s > -np.inf))
            row, vec, score = np.concatenate([row, i]), np.concatenate([vec, ids[j]]), np.concatenate([score, s[i, j]])
            order = np.lexsort((vec, -np.round(score, SCORE_DIGITS), row))
            row, vec, score = row[order], vec[order], score[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            row, vec, score = row[keep], vec[keep], score[keep]
        return pa.table([pa.array(qid[row]), pa.array(vec), pa.array(score)], schema=schema)
    return run


def _meet(questions: DataFrame, corpus: DataFrame, on: list[str], k: int, drop_self: bool) -> DataFrame:
    met = questions.groupBy(*on).cogroup(corpus.groupBy(*on)).applyInArrow(
        _block_top(k, drop_self), "q_id long, vec_id long, score double")
    return _topk(met, k)


def cosine_topk(questions: DataFrame, corpus: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """JN11 + TOP1: the ``k`` most similar corpus vectors per question.

    ``(q_id, vec_id, score, rank)``; scores that agree to ``SCORE_DIGITS`` digits are
    ties and go by ``vec_id``.  Vectors without a direction take no part, vectors of
    other widths than the question's are no neighbours; with ``drop_self`` a question
    does not find its own id.  Every corpus row is compared with every question.
    """
    q, c = _vectors(questions), _vectors(corpus)
    nq, nc = _blocks(q), _blocks(c)
    q = _dealt(q, nq, "_qb").withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = _dealt(c, nc, "_cb").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return _meet(q, c, ["dim", "_qb", "_cb"], k, drop_self)


def answers(top: DataFrame) -> DataFrame:
    """AGG7: per question, ``top_k`` (number of sources), scores and source
    ids in rank order (k rows per question: a bounded collect)."""
    g = top.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("_s"))
    return g.select("q_id", F.size("_s").cast("bigint").alias("top_k"),
                    F.transform("_s", lambda x: x["score"]).alias("scores"),
                    F.transform("_s", lambda x: x["vec_id"]).alias("source_ids"))


def sweep(top: DataFrame, ks=range(2, 10)) -> DataFrame:
    """EVL2/JN10: answers for every k from one top-max(k) run: a row of rank r
    serves every k >= r (a generator, not a join)."""
    lo, hi = min(ks), max(ks)
    x = top.filter(F.col("rank") <= hi).select(
        "*", F.explode(F.sequence(F.greatest(F.col("rank"), F.lit(lo)), F.lit(hi))).alias("k"))
    return x.groupBy("q_id", "k").agg(F.count(F.lit(1)).alias("n_sources"),
                                      F.max("score").alias("best"), F.min("score").alias("worst"))


def pack_context(ranked: DataFrame, tokens: str, budget: int, q: str = "q_id") -> DataFrame:
    """TXT5: keep ranked passages while the running token sum fits ``budget``
    (per question; at most k rows each)."""
    w = Window.partitionBy(q).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("cum_tokens", F.sum(F.col(tokens)).over(w)).filter(F.col("cum_tokens") <= budget)


def hashed_embedding(text: Column, dims: int = 256) -> Column:
    """TXT3, without a fit: counts of lower-cased words by a hash, scaled to length 1; a
    text without words has the zero vector.  Built-in functions only."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), 0)
    slots = F.array_sort(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return F.coalesce(unit(counts), counts).cast("array<float>")


def embedded(sections: DataFrame, laws: DataFrame, embed=hashed_embedding) -> DataFrame:
    """SNK4: the embedding documents of ``embed_docs`` with their vectors; ``embed`` maps
    the text column to an ``array<float>`` column (a model's pandas UDF, for example)."""
    docs = embed_docs(sections, laws)
    return docs.withColumn("embedding", embed(F.col("text")))


# ---------------------------------------------------------------- TF-IDF
#: slots that words are hashed to; the model is a table of so many rows
FEATURES = 1 << 12
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"


def word_slots(text: Column) -> Column:
    """The slot of each lower-cased word: the first three hex digits of its MD5."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    return F.transform(words, lambda w: F.conv(F.left(F.md5(w), F.lit(3)), 16, 10).cast("int"))


def slotted(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(key, slots)`` of every row, for ``fit_slots`` and ``weigh_slots``: stored, the
    texts are cut into words once for both."""
    return docs.select(key, word_slots(F.col(text)).alias("slots"))


def tfidf_fit(docs: DataFrame, text: str) -> DataFrame:
    """TXT3: the model ``(feature, n_with, n_docs, idf)``, one row per slot, from all rows;
    ``idf = ln((n_docs + 1) / (n_with + 1))``.  Null and empty texts count as documents.
    Each row is one document, so repeated rows count each.  Store it with ``write_table``."""
    return fit_slots(docs.select(word_slots(F.col(text)).alias("slots")))


def fit_slots(rows: DataFrame) -> DataFrame:
    """``tfidf_fit`` of rows with ``slots``."""
    seen = rows.select(F.explode(F.array_distinct("slots")).alias("feature")) \
        .groupBy("feature").agg(F.count(F.lit(1)).alias("n_with"))
    total = rows.agg(F.count(F.lit(1)).alias("n_docs"))
    slots = rows.sparkSession.range(FEATURES).select(F.col("id").cast("int").alias("feature")).crossJoin(F.broadcast(total))
    return slots.join(seen, "feature", "left").select(
        "feature", F.coalesce("n_with", F.lit(0)).alias("n_with"), "n_docs",
        F.log((F.col("n_docs") + 1) / (F.coalesce("n_with", F.lit(0)) + 1)).alias("idf"))


def tfidf_weights(docs: DataFrame, text: str, key: str, model: DataFrame) -> DataFrame:
    """TXT3: ``(key, feature, n, weight)`` of each row's slots by a stored ``model``: counts
    times idf, scaled to length 1 (0 where every word of the row is in all documents of
    the fit).  Rows without words give none; a key that repeats needs telling apart first.
    The model is broadcast: it has ``FEATURES`` rows, whatever it was fitted on."""
    return weigh_slots(slotted(docs, text, key), key, model)


def weigh_slots(rows: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """``tfidf_weights`` of rows with ``slots``; they are dealt by key once, for the counts
    and for the lengths."""
    counted = rows.repartition(key).select(key, F.explode("slots").alias("feature")).groupBy(key, "feature").agg(F.count(F.lit(1)).alias("n"))
    raw = counted.join(F.broadcast(model.select("feature", "idf")), "feature").withColumn("_w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))  # FEATURES rows a key at most
    return raw.withColumn("_norm", norm).select(key, "feature", "n", F.when(F.col("_norm") > 0, F.col("_w") / F.col("_norm")).otherwise(0.0).alias("weight"))


def tfidf_vectors(weights: DataFrame, key: str) -> DataFrame:
    """TXT3: the weights as ``(key, embedding array<float>)`` of ``FEATURES`` components."""
    g = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return g.select(key, at.cast("array<float>").alias("embedding"))


# ---------------------------------------------------------------- MLlib
def tfidf_embed(docs: DataFrame, text: str, key: str, num_features: int = 1 << 12) -> DataFrame:
    """TXT3 offline default: hashed term frequencies, IDF, L2 norm -> array<float>."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"(?U)\W+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v", p=2.0)]
    model = Pipeline(stages=stages).fit(docs)
    return model.transform(docs).select(key, vector_to_array("_v", "float32").alias("embedding"))


def _close_pairs(threshold: float):
    """Pairs of a question and a vector that share a bucket of some table and lie closer
    than ``threshold``, of rows sorted by pair of blocks, questions first.  The questions
    of the open pair of blocks are held, the corpus streams by."""
    least = 1 - threshold * threshold / 2 - 1e-6  # the product only sorts out, the distance decides

    def parts(b: pa.RecordBatch):
        t = pa.Table.from_batches([b])
        return t, *(t.column(n).combine_chunks().flatten().to_numpy().reshape(len(b), -1) for n in ("v", "h"))

    def pairs(ids, x, hx, b):
        t, y, hy = parts(b)
        cid = t.column("vec_id").combine_chunks()
        step = max(1, SCORES // len(x))
        xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        for lo in range(0, len(y), step):
            i, j = np.nonzero(x @ yt[:, lo:lo + step] > least)
            j += lo
            met = np.zeros(len(i), bool)
            for k in range(hx.shape[1]):
                met |= hx[i, k] == hy[j, k]
            i, j = i[met], j[met]
            square = np.zeros(len(i))
            for u, w in zip(xt, yt):
                square += (u[i] - w[j]) ** 2
            dist = np.sqrt(square)
            near = dist < threshold
            i, j, dist = i[near], j[near], dist[near]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), cid.take(pa.array(j)), pa.array(1 - dist * dist / 2)],
                                             names=["q_id", "vec_id", "score"])

    def run(batches):
        at, held, open_block = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("_qb", "_cb", "side")])
            edge = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(b)]])
            for lo, hi in zip(edge[:-1], edge[1:]):
                if lo == hi:
                    continue
                if at != tuple(keys[:2, lo]):
                    at, held, open_block = tuple(keys[:2, lo]), [], None
                rows = b.slice(lo, hi - lo)
                if keys[2, lo] == 0:
                    held.append(rows)
                elif held or open_block:
                    if held:
                        got = [parts(r) for r in held]
                        open_block = (pa.concat_arrays([c for t, _, _ in got for c in t.column("vec_id").chunks]),
                                      *(np.concatenate([g[k] for g in got]) for k in (1, 2)))
                        held = []
                    yield from pairs(*open_block, rows)
    return run


def lsh_neighbours(questions: DataFrame, corpus: DataFrame, threshold: float,
                   bucket_length: float = 0.5, tables: int = 4) -> DataFrame:
    """TXT4 (approximate): pairs of random-projection LSH on unit vectors (they share a
    bucket of some table) with Euclidean distance below ``threshold``; the graph index of
    the reference is not built, recall is measured against JN11.

    Rows that repeat id and vector are one, vectors without a direction take no part.
    The buckets are MLlib's; blocks of both sides meet as in ``cosine_topk``, and each
    pair of rows is tested by the one task that holds both, so that no candidate pair
    is stored or shuffled."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    q, c = _vectors(questions), _vectors(corpus)
    nq, nc = _blocks(q), _blocks(c)
    q, c = (d.select("vec_id", unit(F.col("embedding")).alias("a")).filter("a IS NOT NULL").distinct()
            .withColumn("v", array_to_vector("a")) for d in (q, c))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=7).fit(c)

    def hashed(rows: DataFrame, side: int, own: str, blocks: int, other: str, others: int) -> DataFrame:
        buckets = F.array(*[vector_to_array(F.col("h")[k])[0] for k in range(tables)])
        return model.transform(rows).select("vec_id", F.col("a").alias("v"), buckets.alias("h"), F.lit(side).alias("side"),
                                            F.pmod(F.xxhash64("vec_id", "a"), F.lit(blocks)).cast("int").alias(own)) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    rows = hashed(q, 0, "_qb", nq, "_cb", nc).unionByName(hashed(c, 1, "_cb", nc, "_qb", nq))
    met = rows.repartition("_qb", "_cb").sortWithinPartitions("_qb", "_cb", "side")
    return met.mapInArrow(_close_pairs(threshold), "q_id long, vec_id long, score double")


class CellIndex:
    """TXT4: k-means cells over unit vectors, searched by probing the nearest ones.

    The centres are fitted on at most ``FIT_VECTORS`` vectors (those of least hash);
    every vector is filed.  A question meets the vectors of its ``probes`` nearest cells
    and ranks them exactly.  A cell of more than ``BLOCK_BYTES`` is dealt to parts, and
    its questions go to each of them.
    """

    def __init__(self, corpus: DataFrame, cells: int, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        vectors = _vectors(corpus)
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_VECTORS)
        fit = KMeans(k=cells, seed=seed, distanceMeasure="cosine", featuresCol="v", maxIter=10) \
            .fit(sample.select(array_to_vector("embedding").alias("v")))
        centres = np.array(fit.clusterCenters())
        self.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        # the salt is drawn before any shuffle, so that a repeated task draws it again
        filed = self.nearest(vectors, 1).withColumn("cell", F.col("cells")[0]).drop("cells") \
            .withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
        per_part = F.lit(BLOCK_BYTES).cast("double") / (F.first("dim") * 8)
        self.sizes = filed.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
        self.filed = filed.join(self.sizes, "cell").withColumn("part", F.pmod("salt", F.col("parts")).cast("int"))

    def nearest(self, vectors: DataFrame, probes: int) -> DataFrame:
        """``vectors`` with their nearest ``cells``, the best first."""
        centres, probes = self.centres, min(probes, len(self.centres))

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = _matrix(pa.Table.from_batches([b]), "embedding")
                    best = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
                    flat = pa.array(best.astype(np.int32).ravel())
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, probes, dtype=np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, "cells"])

        at_width = vectors.filter(F.col("dim") == centres.shape[1])
        return at_width.mapInArrow(run, "vec_id long, embedding array<double>, dim int, cells array<int>")

    def probes_for(self, questions: DataFrame, corpus: DataFrame, k: int, recall: float, drop_self: bool = False) -> int:
        """The least number of probes that finds ``recall`` of the exact top ``k`` of at
        most ``FIT_QUESTIONS`` questions (those of least hash)."""
        some = questions.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUESTIONS)
        exact = cosine_topk(some, corpus, k, drop_self).select("q_id", "vec_id")
        order = self.nearest(_vectors(some), len(self.centres)).select(F.col("vec_id").alias("q_id"), "cells")
        place = exact.join(self.filed.select("vec_id", "cell"), "vec_id").join(order, "q_id") \
            .select(F.array_position("cells", F.col("cell")).alias("place"))
        found = {r["place"]: r["count"] for r in place.groupBy("place").count().collect()}  # one row per cell at most
        total, so_far = sum(found.values()), 0
        for probes in sorted(found):
            so_far += found[probes]
            if so_far >= recall * total:
                return int(probes)
        return len(self.centres)

    def search(self, questions: DataFrame, k: int, probes: int, drop_self: bool = False) -> DataFrame:
        """As ``cosine_topk``, from the probed cells only."""
        q = _vectors(questions)
        nq = _blocks(q)
        q = _dealt(self.nearest(q, probes), nq, "_qb").withColumn("cell", F.explode("cells")).drop("cells")
        parts = self.sizes.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        q = q.join(parts, "cell")
        c = self.filed.drop("n", "parts").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        return _meet(q, c, ["_qb", "cell", "part"], k, drop_self)

    def candidates(self, questions: DataFrame, probes: int) -> DataFrame:
        """``(q_id, n_candidates)``: the vectors that each question is compared with."""
        q = self.nearest(_vectors(questions), probes).select(F.col("vec_id").alias("q_id"), F.explode("cells").alias("cell"))
        return q.join(self.sizes, "cell").groupBy("q_id").agg(F.sum("n").alias("n_candidates"))


# ---------------------------------------------------------------- plug-ins
_MODELS: dict = {}


def make_embedder(load, dim: int, name: str = "embedder"):
    """TXT3: a pandas UDF ``text -> array<float>`` around a user model.

    ``load()`` returns a callable ``list[str] -> array (n, dim)``; it runs
    once per Python worker (cached by ``name``), and texts arrive in Arrow
    batches.  Use as ``df.withColumn("embedding", make_embedder(load, 768)("text"))``.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        model = _MODELS.get(name)
        if model is None:
            model = _MODELS[name] = load()
        vecs = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
        return pd.Series(list(vecs))
    return embed


def recall_at_k(candidates: DataFrame, exact: DataFrame) -> DataFrame:
    """TXT4: per question, the share of the exact top-k (JN11) that an
    approximate candidate set found; an equi-join on (q_id, vec_id)."""
    hit = exact.join(candidates.select("q_id", "vec_id").distinct().withColumn("_hit", F.lit(1)),
                     ["q_id", "vec_id"], "left")
    return hit.groupBy("q_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"),
                                   F.count(F.lit(1)).alias("k"))
