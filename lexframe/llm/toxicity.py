"""Counterfactual-regularised toxicity classifier.

A document is the set of its lower-cased words and their beginnings, hashed to
weights of a logistic model.  From each labelled text sentences that name a group give
copies with the other names of the same kind; a text that names none gives one sentence
(chosen by a hash, as are the kind and the place) with a name put in, and its copy with
another name.  The loss adds ``SWAP`` times the squared change of the score from each
sentence to its copy: a mention of a group alone must not move a score, whichever group
and whether the fit's texts name any.  An L1 term keeps long clean texts at the bias.

A sentence counts with ``WINDOW`` words on either side of the name, and a text gives
``PAIRS`` pairs at most: bounds of the fit, whose texts are bounded too.

The fit uses at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_CHARS``
characters, in the order of a hash of the id, all toxic ones first up to half of
it; scoring reads every whole text.

Defined results: a null or empty text gets the score of the bias; a document
labelled twice counts as toxic if any label says so; without labels of both kinds
every score is 0.5; extra columns are not read.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, lower, prefix_hash, read_table, span_hash, words
from .quality_model import crc_mod, sampled_texts
from .registry import register

SAMPLE_ROWS = 4000
SAMPLE_CHARS = 10_000
BITS = 18
PREFIXES = (4, 5, 6)
STEPS = 240
RATE = 0.08
L1 = 2e-4
#: weight of the mean squared change: with less, a name that only toxic texts hold still counts
SWAP = 10.0
WINDOW = 12
PAIRS = 40
#: a parameter: names of groups that may stand for each other, by kind
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"), ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("femmes", "hommes"), ("musulmans", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"))


def word_features(buf: np.ndarray, off: np.ndarray, powers: Powers):
    """``(bucket, text number)`` of each word and word beginning; punctuation at a
    word's end belongs to neither."""
    buf = lower(buf)
    start, end, first = words(buf, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for _ in range(3):  # up to three marks at the end go, and one at the start
        mark = (end > start) & np.isin(buf[np.maximum(end - 1, 0)], _MARKS)
        end = end - mark
    start = start + ((end > start) & np.isin(buf[np.minimum(start, max(len(buf) - 1, 0))], _MARKS))
    keep = end > start
    start, end, text = start[keep], end[keep], text[keep]
    prefix = prefix_hash(buf, powers)
    shift = np.uint64(64 - BITS)
    yield span_hash(prefix, start, end, powers) >> shift, text
    for n in PREFIXES:
        long = end - start > n
        h = span_hash(prefix, start[long], start[long] + n, powers)
        yield (h * np.uint64(2 * n + 1)) >> shift, text[long]


_MARKS = np.frombuffer(b".,;:!?\"'()", np.uint8)


def feature_sets(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(bucket, text number)`` pairs, ordered by text."""
    data = b"".join(texts)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return distinct(np.frombuffer(data, np.uint8), off, powers)


def distinct(buf: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    parts = list(word_features(buf, off, powers))
    key = np.concatenate([(t.astype(np.uint64) << np.uint64(BITS)) | b for b, t in parts])
    key = np.unique(key)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def swaps(text: str, groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """``(sentence, copy)`` pairs of the sentences that name a group, ``PAIRS`` at most."""
    kind = {t: g for g in groups for t in g}
    out: list[tuple[str, str]] = []
    for s in re.split(r"(?<=[.!?])\s+|\n", text.lower()):
        tokens = s.split()
        names = [(i, w) for i, t in enumerate(tokens) for w in re.findall(r"[^\W\d_]+", t) if w in kind]
        for w, i in {w: i for i, w in reversed(names)}.items():
            near = " ".join(tokens[max(0, i - WINDOW):i + WINDOW + 1])
            out += [(near, re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", other, near)) for other in kind[w] if other != w]
            if len(out) >= PAIRS:
                return out[:PAIRS]
    return out


def counterfactuals(text: str, groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """The pairs of ``swaps``; without any, a sentence, the same with a name put in, and
    that with another name.  A text without words gives none."""
    out = swaps(text, groups)
    sentences = [s.split() for s in re.split(r"(?<=[.!?])\s+|\n", text.lower()) if s.split()]
    if out or not sentences:
        return out
    draw = np.random.default_rng(zlib.crc32(text.encode()))
    words = sentences[draw.integers(len(sentences))]
    at = int(draw.integers(len(words)))
    near, at = words[max(0, at - WINDOW):at + WINDOW], min(at, WINDOW)
    kind = groups[draw.integers(len(groups))]
    one, two = (" ".join([*near[:at], kind[k], *near[at:]]) for k in draw.choice(len(kind), 2, replace=False))
    return [(" ".join(near), one), (one, two)]


def train(texts: list[str], labels: np.ndarray, groups=IDENTITY_TERMS, swap: float = SWAP,
          steps: int = STEPS, rate: float = RATE, l1: float = L1):
    """``(weights, bias)``, or None without both classes."""
    y = np.asarray(labels, float)
    if len(np.unique(y)) < 2:
        return None
    powers = Powers()
    col, row = feature_sets([t.encode() for t in texts], powers)
    pairs = [p for t in texts for p in counterfactuals(t, groups)]
    ca, ra = feature_sets([a.encode() for a, _ in pairs], powers)
    cb, rb = feature_sets([b.encode() for _, b in pairs], powers)
    dc, dr = np.concatenate([ca, cb]), np.concatenate([ra, rb])
    ds = np.concatenate([np.ones(len(ca)), -np.ones(len(cb))])
    n, size, m = len(y), 1 << BITS, len(pairs)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, b = np.zeros(size), 0.0
    m1, m2 = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        grad = np.bincount(col, g[row], size)
        if m:
            d = np.bincount(dr, ds * w[dc], m)
            grad += swap * np.bincount(dc, ds * (2 * d / m)[dr], size)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad ** 2
        step = rate / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-4)
        w -= step * m1 / (1 - 0.9 ** t)
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * step, 0)
        b -= 10 * rate * g.sum()
    return w, b


def score_texts(texts: pa.Array, model, powers: Powers) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if model is None:
        return out
    w, bias = model
    for lo, hi, buf, off in chunks(texts):
        # only buckets with a weight can move a score
        parts = [(t.astype(np.uint64) << np.uint64(BITS) | b)[w[b.astype(np.int64)] != 0] for b, t in word_features(buf, off, powers)]
        key = np.unique(np.concatenate(parts))
        z = np.bincount((key >> np.uint64(BITS)).astype(np.int64), w[(key & np.uint64((1 << BITS) - 1)).astype(np.int64)], hi - lo)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z + bias, -500, 500)))
    return out


def toxic_sample(docs: DataFrame, labels: DataFrame, learn) -> tuple[list[str], np.ndarray]:
    lab = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
    got = []
    for y in (1, 0):
        part = sampled_texts(docs, lab.filter(F.col("y") == y), SAMPLE_ROWS // 2, SAMPLE_CHARS)
        got += sorted(part, key=lambda r: (r["o"], r["doc_id"], r["th"]))
    return [bytes(r["t"]).decode() for r in got], np.array([r["y"] for r in got], int)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32 divides by 5 are held
    out of the fit."""
    held = lambda i: crc_mod(i, 5) == 0
    model = train(*toxic_sample(docs, labels, lambda i: ~held(i)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        powers = Powers()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score_texts(b.column("text"), model, powers))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
