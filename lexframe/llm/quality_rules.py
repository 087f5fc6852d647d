"""Quality rules: robust multivariate outliers.

Each text gives a vector of transformed statistics.  Per language and source the
vectors' centre and scatter are estimated by the minimum covariance determinant:
from medians and scaled deviations, ``C_STEPS`` concentration steps each keep the
``H`` share of rows nearest by Mahalanobis distance and estimate anew from them.
The final scatter is made consistent by the median distance, and rows beyond
``CUTOFF`` are rejected.  All estimates are grouped sums over all rows.

A row of a group of under ``MIN_GROUP`` rows is judged by the estimate of all rows
of its language, and where those are under ``MIN_GROUP``, by that of the whole
corpus, whatever its size.  A short text's statistics scatter more, so its squared
distance counts by ``n / (n + SHORT)``.

Defined results: a null or empty text has no words and fails the base rule; a null
language or source is a group of its own; repeated rows count each; extra columns
are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, Powers, Work, chunks, mix, prefix_hash, read_table, text_hash, words
from .registry import register

MIN_WORDS = 50
MIN_GROUP = 100
H = 0.75
C_STEPS = 4
SHORT = 200
#: chi-square of five degrees: the median, and the bound of a rejected row
CHI2_MEDIAN = 4.351
CUTOFF = 100.0
DIMS = ("mean_length", "symbols", "capitals", "repeats", "dup_lines")
#: least standard deviation of each statistic: what differs less says nothing
FLOOR = (0.15, 0.03, 0.03, 0.05, 0.12)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _totals(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(flags)])
    return s[off[1:]] - s[off[:-1]]


def text_counts(buf: np.ndarray, off: np.ndarray, powers: Powers) -> list[np.ndarray]:
    """``COUNTS`` of each text."""
    n = len(off) - 1
    start, end, first = words(buf, off)
    prefix = prefix_hash(buf, powers)
    word = text_hash(buf, prefix, start, end, powers)
    point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(point[end] - point[start])])
    owner = np.repeat(np.arange(n), np.diff(first))
    # words that lie in a three-word window found twice or more in the same text
    if len(word) >= 3:
        inside = owner[2:] == owner[:-2]
        window = mix(word[:-2] + np.uint64(3) * word[1:-1] + np.uint64(9) * word[2:] + mix(owner[:-2].astype(np.uint64)))
        at = np.flatnonzero(inside)
        _, inverse, times = np.unique(window[at], return_inverse=True, return_counts=True)
        at = at[times[inverse] > 1]
        repeated = np.zeros(len(word), bool)
        for k in range(3):
            repeated[at + k] = True
    else:
        repeated = np.zeros(len(word), bool)
    # lines: each text is cut at its line feeds
    feeds = np.flatnonzero(buf == 10)
    l_start = np.sort(np.concatenate([off[:-1], feeds + 1]))
    l_text = np.repeat(np.arange(n), np.searchsorted(feeds, off[1:]) - np.searchsorted(feeds, off[:-1]) + 1)
    # a text that ends with a line feed has its last, empty line where the next text starts
    order = np.lexsort((np.concatenate([off[:-1], feeds + 1]), np.concatenate([np.arange(n), np.searchsorted(off, feeds, "right") - 1])))
    l_start = np.concatenate([off[:-1], feeds + 1])[order]
    l_end = np.concatenate([l_start[1:] - 1, [len(buf)]])
    last = np.concatenate([l_text[1:] != l_text[:-1], [True]]) if n else np.zeros(0, bool)
    l_end[last] = off[1:][l_text[last]]
    has_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_hash, l_owner = mix(text_hash(buf, prefix, l_start, l_end, powers) + mix(l_text.astype(np.uint64)))[has_word], l_text[has_word]
    _, at = np.unique(l_hash, return_index=True)
    again = np.ones(len(l_hash), bool)
    again[at] = False
    return [np.diff(first), chars[first[1:]] - chars[first[:-1]], _totals(_SYMBOL[buf], off),
            np.bincount(l_owner, again, n).astype(np.int64), np.concatenate([[0], np.cumsum(repeated)])[first[1:]] - np.concatenate([[0], np.cumsum(repeated)])[first[:-1]],
            _totals(_UPPER[buf], off), np.bincount(l_owner, minlength=n)]


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, *COUNTS)`` of ``docs(doc_id, text, lang, source)``."""
    kinds = dict(docs.dtypes)

    def run(batches):
        powers = Powers()
        for b in batches:
            parts = [text_counts(buf, off, powers) for _, _, buf, off in chunks(b.column("text"))]
            cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols], names=["doc_id", "lang", "source", *COUNTS])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, source {kinds['source']}, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> list:
    ratio = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [(F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("mean_length"), ratio("n_symbols", "n_words").alias("symbols"),
            ratio("n_upper", "word_chars").alias("capitals"), ratio("n_repeat_words", "n_words").alias("repeats"),
            ratio("n_dup_lines", "n_lines").alias("dup_lines")]


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``grp``, the group whose estimate judges the row (language and source, the
    language, or the corpus), and ``fits``, all groups that the row helps to estimate."""
    lang = F.coalesce("lang", F.lit("\x02"))
    r = rows.withColumn("grp1", F.concat_ws("\x01", F.lit("s"), lang, F.coalesce("source", F.lit("\x02")))) \
        .withColumn("grp2", F.concat_ws("\x01", F.lit("l"), lang))
    n1 = r.groupBy("grp1", "grp2").agg(F.count_if(~F.col("base_failed")).alias("n1"))
    n2 = n1.groupBy("grp2").agg(F.sum("n1").alias("n2"), (F.min("n1") < MIN_GROUP).alias("small1"))
    small2 = n2.agg(F.coalesce(F.min("n2") < MIN_GROUP, F.lit(False)).alias("small2"))
    r = _join(_join(r, n1.drop("grp2"), "grp1"), n2.crossJoin(F.broadcast(small2)), "grp2")
    big1, big2 = F.col("n1") >= MIN_GROUP, F.col("n2") >= MIN_GROUP
    fits = F.array_compact(F.array(F.when(big1, F.col("grp1")), F.when(big2 & F.col("small1"), F.col("grp2")), F.when(F.col("small2"), F.lit("c"))))
    return r.select(*rows.columns, F.when(big1, F.col("grp1")).when(big2, F.col("grp2")).otherwise("c").alias("grp"), fits.alias("fits"))


def _join(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """A left join on a key that a third of the rows may share."""
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")) \
        .join(small.withColumn("_salt", F.explode(salts)), [key, "_salt"], "left").drop("_salt")


def _distance(rows: DataFrame, params: DataFrame):
    d = len(DIMS)
    r = _join(rows, params, "grp")
    dev = [F.col(c) - F.get("centre", F.lit(i)) for i, c in enumerate(DIMS)]
    total = sum((dev[i] * dev[j] * F.get("precision", F.lit(i * d + j)) for i in range(d) for j in range(d)), F.lit(0.0))
    return r.withColumn("d2", total * F.col("n_words") / (F.col("n_words") + SHORT))


def _estimate(rows: DataFrame) -> DataFrame:
    """``(grp, centre, precision)`` from the rows of each group."""
    d = len(DIMS)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(DIMS)]
    sums += [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    g = rows.groupBy("grp").agg(F.count("*").alias("n"), *sums)

    def run(frames):
        for f in frames:
            centre, precision = [], []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                cov = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"] - np.outer(mean, mean)
                precision.append(np.linalg.inv(cov + np.diag(np.square(FLOOR))).ravel().tolist())
                centre.append(mean.tolist())
            yield f[["grp"]].assign(centre=centre, precision=precision)

    return g.mapInPandas(run, "grp string, centre array<double>, precision array<double>")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and scaled median deviations of each statistic."""
    d = len(DIMS)
    med = rows.groupBy("grp").agg(F.array(*[F.percentile_approx(c, 0.5, 5000) for c in DIMS]).alias("centre"))
    dev = _join(rows, med, "grp").groupBy("grp").agg(F.first("centre").alias("centre"), *[
        F.percentile_approx(F.abs(F.col(c) - F.get("centre", F.lit(i))), 0.5, 5000).alias(f"m{i}") for i, c in enumerate(DIMS)])
    zero = F.lit(0.0)
    flat = [1 / (F.pow(1.4826 * F.col(f"m{i}"), 2) + FLOOR[i] ** 2) if i == j else zero for i in range(d) for j in range(d)]
    return dev.select("grp", "centre", F.array(*flat).alias("precision"))


def judge(docs: DataFrame) -> DataFrame:
    """The counts of each row with ``base_failed``, ``distance`` and ``kept``."""
    work = Work(docs.sparkSession, "rules")
    s = statistics(docs).select("*", *vector(), ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))
    s = work.cut(s, "statistics")
    rows = work.cut(_grouped(s), "groups")
    fit = rows.filter("NOT base_failed").withColumn("grp", F.explode("fits")).drop("fits")
    params = work.cut(_start(fit), "centres")
    for _ in range(C_STEPS):
        near = _distance(fit, params)
        bound = near.groupBy("grp").agg(F.percentile_approx("d2", H, 5000).alias("bound"))
        params = work.cut(_estimate(_join(near, bound, "grp").filter("d2 <= bound")), "centres")
    scale = _distance(fit, params).groupBy("grp").agg(
        F.greatest(F.percentile_approx("d2", 0.5, 5000) / CHI2_MEDIAN, F.lit(1e-9)).alias("scale"))
    out = _join(_distance(rows, params), work.cut(scale, "scales"), "grp")
    far = F.coalesce(F.col("d2") / F.greatest("scale", F.lit(1.0)) > CUTOFF, F.lit(False))
    return out.select("doc_id", *COUNTS[:5], "base_failed", (F.col("d2") / F.greatest("scale", F.lit(1.0))).alias("distance"),
                      (~F.col("base_failed") & ~far).alias("kept"))


@register("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")
