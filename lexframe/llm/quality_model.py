"""Quality classifier with supervised subword embeddings.

Each word, each character n-gram of the text's bytes and a mark for a word that
repeats the one before it is hashed to a row of an embedding table.  A document is
the mean of its rows, a softmax layer scores it, and both are trained by stochastic
gradient descent in numpy.  The mean and the softmax's linear part commute, so a
trained model scores with one number per row of the table.

The fit uses at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_CHARS``
characters, in the order of a hash of the id; scoring reads every whole text.

Defined results: a null or empty text has no rows and gets the score of the bias; a
document labelled twice counts by its labels' minimum; without labels of both
kinds every score is 0.5; extra columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, mix, prefix_hash, read_table, span_hash, words
from .registry import register

SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
BUCKET_BITS = 16
DIM = 8
#: texts whose features are stored together during the fit
BLOCK = 64
EPOCHS = 6
RATE = 20.0
GRAMS = (3, 5)
SEED = 7


def crc_mod(doc_id, m: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def features(buf: np.ndarray, off: np.ndarray, powers: Powers):
    """``(bucket of each feature, first feature of each text)`` arrays, one pair per
    kind of feature."""
    shift = np.uint64(64 - BUCKET_BITS)
    start, end, first = words(buf, off)
    prefix = prefix_hash(buf, powers)
    word = span_hash(prefix, start, end, powers)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    repeat = np.uint64(1) << np.uint64(63)
    ids = np.where(again, repeat >> shift, word >> shift).astype(np.int32)
    yield ids, first
    for n in GRAMS:
        if len(buf) >= n:
            x = buf[:len(buf) - n + 1].astype(np.uint64)
            for k in range(1, n):
                x |= buf[k:len(buf) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
            g = ((x * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> shift).astype(np.int32)
        else:
            g = np.zeros(0, np.int32)
        # a text's n-grams start before its last n - 1 bytes
        cut = np.minimum(off, len(g))
        yield g, cut, np.maximum(cut[:-1], np.minimum(off[1:] - n + 1, len(g)))


def counts(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature rows of one text and their share of all its features."""
    buf = np.frombuffer(text, np.uint8)
    off = np.array([0, len(buf)])
    ids = np.concatenate([f[0] for f in features(buf, off, powers)] or [np.zeros(0, np.int32)])
    rows, n = np.unique(ids, return_counts=True)
    return rows, (n / max(1, len(ids))).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED):
    """``(logit per feature row, bias)`` for class 1, or None without both classes."""
    y = np.asarray(labels)
    if len(np.unique(y)) < 2:
        return None
    powers, rng = Powers(), np.random.default_rng(seed)
    docs = []
    for lo in range(0, len(texts), BLOCK):  # few large arrays, whose memory goes back when the fit is done
        part = [counts(t, powers) for t in texts[lo:lo + BLOCK]]
        rows, share = (np.concatenate([p[k] for p in part]) for k in (0, 1))
        ends = np.cumsum([len(p[0]) for p in part]).tolist()
        docs += [(rows[a:b], share[a:b]) for a, b in zip([0, *ends], ends)]
    table = rng.uniform(-0.1, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)], np.float32)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - step / steps)
            step += 1
            rows, share = docs[i]
            h = share @ table[rows]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            grad = out @ p
            out -= 0.05 * lr * np.outer(h, p)
            bias -= 0.002 * lr * p
            table[rows] -= lr * share[:, None] * grad
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def score_texts(texts: pa.Array, model, powers: Powers) -> np.ndarray:
    """Probability of class 1 for each text of an Arrow array."""
    out = np.full(len(texts), 0.5)
    if model is None:
        return out
    table, bias = model
    for lo, hi, buf, off in chunks(texts):
        total, n = np.zeros(hi - lo), np.zeros(hi - lo)
        for ids, a, *b in features(buf, off, powers):
            s = np.concatenate([[0.0], np.cumsum(table[ids])])
            stop = b[0] if b else a[1:]
            total += s[stop] - s[a[:-1]]
            n += stop - a[:-1]
        out[lo:hi] = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
    return out


def sample_rows(docs: DataFrame, lab: DataFrame, rows: int, chars: int) -> DataFrame:
    """``(y, t)`` of at most ``rows`` rows of ``docs`` labelled by ``lab(doc_id, y)``, of at
    most ``chars`` characters.  Rows are chosen without their texts; the texts of the
    chosen ones follow by a join with that bounded table."""
    sizes = docs.select("doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("th")).filter(F.col("size") <= chars)
    chosen = lab.join(sizes, "doc_id").select("y", "doc_id", "th", F.xxhash64("doc_id").alias("o")).distinct() \
        .orderBy("o", "doc_id", "th").limit(rows)
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return text.join(F.broadcast(chosen), ["doc_id", "th"]).select("y", F.encode("text", "utf-8").alias("t"), "o", "doc_id", "th") \
        .dropDuplicates(["doc_id", "th"])


def sampled_texts(docs: DataFrame, lab: DataFrame, rows: int, chars: int) -> list:
    return sample_rows(docs, lab, rows, chars).collect()


def known_labels(labels: DataFrame, label: str, learn) -> DataFrame:
    """``(doc_id, y)`` of the labels that may be learnt from."""
    return labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min(label).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn) -> tuple[list[bytes], np.ndarray]:
    """At most ``SAMPLE_ROWS`` labelled texts for the fit and their labels."""
    lab = known_labels(labels, label, learn)
    got = sorted(sampled_texts(docs, lab, SAMPLE_ROWS, SAMPLE_CHARS), key=lambda r: (r["o"], r["doc_id"], r["th"]))
    return [bytes(r["t"]) for r in got], np.array([r["y"] for r in got], int)


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn):
    """``train`` on the labelled sample, in one task: the driver gets the model, one number
    per feature row, and never holds the texts and their features."""
    rows = sample_rows(docs, known_labels(labels, label, learn), SAMPLE_ROWS, SAMPLE_CHARS)

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column("t").to_pylist()
            y += b.column("y").to_pylist()
        model = train(texts, np.array(y, int))
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model[0].tolist()]), pa.array([model[1]])], names=["weights", "bias"])

    got = rows.repartition(1).sortWithinPartitions("o", "doc_id", "th").select("y", "t") \
        .mapInArrow(run, "weights array<double>, bias double").toArrow()
    return (got.column("weights").combine_chunks().flatten().to_numpy(), got.column("bias")[0].as_py()) if got.num_rows else None


def score_documents(docs: DataFrame, model, held_out) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        powers = Powers()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score_texts(b.column("text"), model, powers))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32 remainder by 3 is 1
    are held out of the fit."""
    held = lambda i: crc_mod(i, 3) == 1
    model = train(*labelled_sample(docs, labels, "quality", lambda i: ~held(i)))
    return score_documents(docs, model, held)


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the fitted model predicts as class 1."""
    model = fitted(docs, labels, "quality", lambda i: crc_mod(i, 3) != 1)

    def run(batches):
        powers = Powers()
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column("text"), model, powers) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


@register("op8_quality_model")
def op8_quality_model(spark, sf_dir):
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
