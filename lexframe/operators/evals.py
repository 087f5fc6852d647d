"""EVL1-EVL3, WIN9, JN7, SCL25/26/28/29, TOP2: evaluation tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .scan import Running, numbered, running


def pending(questions: DataFrame, results: DataFrame, text: str = "query_text") -> DataFrame:
    """JN7/AGG8/SCL26: trimmed, non-empty questions with ``answered`` telling
    whether an eval row already holds the same trimmed text."""
    q = questions.withColumn(text, strip_ws(F.col(text))).filter(F.col(text) != "")
    done = results.select(strip_ws(F.col(text)).alias(text)).distinct().withColumn("answered", F.lit(True))
    return q.join(done, text, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def unrated(results: DataFrame) -> DataFrame:
    """SCL29: rows still 'unrated'."""
    return results.filter(F.col("rating") == "unrated")


def unrated_queue(results: DataFrame) -> DataFrame:
    """TOP7: the unrated rows with ``list_no``, their place by id."""
    return numbered(unrated(results), [], [F.col("id")])


def next_unrated(results: DataFrame, events: DataFrame, idx: str = "idx") -> DataFrame:
    """WIN9: after the i-th rating event, the lowest id still unrated (the
    reference's queue advance), for a whole batch of ordered events.

    ``t(u)`` is the first event rating id ``u`` (a value past every event
    if none); after
    event ``i`` the unrated ids are those with ``t(u) > i``.  Value rows
    (``t``, min id) at position ``2t`` and event rows at ``2i + 1`` go through
    one reverse chunked running minimum, so each event sees exactly the ids
    with ``t > i``.  Only ids unrated before the batch take part.
    """
    never = F.lit(1 << 60).cast("bigint")
    first = events.groupBy("id").agg(F.min(idx).alias("t"))
    ids = unrated(results).select("id").join(first, "id", "left") \
                          .withColumn("t", F.coalesce(F.col("t"), never))
    vals = ids.groupBy("t").agg(F.min("id").alias("m")).select(
        (-2 * F.col("t")).cast("bigint").alias("_o"), (-F.col("m")).alias("_v"),
        F.lit(None).cast("bigint").alias(idx), F.lit(None).cast("bigint").alias("id"))
    evs = events.select((-(2 * F.col(idx) + 1)).cast("bigint").alias("_o"), F.lit(None).cast("bigint").alias("_v"),
                        F.col(idx).cast("bigint").alias(idx), F.col("id").cast("bigint").alias("id"))
    both = vals.unionByName(evs).withColumn("_k", F.lit(0))
    r = running(both, ["_k"], "_o", [Running("_best", F.col("_v"), "max", inclusive=True)])
    return r.filter(F.col(idx).isNotNull()).select(idx, "id", (-F.col("_best")).alias("next_id"))


def score_bullets(scores: Column) -> Column:
    """SCL25: ``- 0.1234`` lines, or ``_None_`` for no scores."""
    lines = F.transform(scores, lambda s: F.format_string("- %.4f", s))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit("_None_"))


def score_text(score: Column) -> Column:
    """A score as Python writes it (of a size below 10^7), ``N/A`` for none."""
    s = score.cast("string")
    mantissa, exponent = F.split_part(s, F.lit("E-"), F.lit(1)), F.split_part(s, F.lit("E-"), F.lit(2))
    sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"[-.]", "")
    return (F.when(score.isNull(), F.lit("N/A")).when(exponent == "4", F.concat(sign, F.lit("0.000"), digits))
             .when(exponent != "", F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e-"), F.lpad(exponent, F.greatest(F.length(exponent), F.lit(2)), F.lit("0"))))
             .otherwise(s))


def source_block(nodes: Column) -> Column:
    """SCL25: score and text of each source node, parted by rules; empty without nodes."""
    block = F.transform(nodes, lambda n: F.concat(F.lit("**Score:** "), score_text(n["score"]), F.lit("\n\n"), F.coalesce(n["text"], F.lit(""))))
    return F.coalesce(F.array_join(block, "\n\n---\n\n"), F.lit(""))


def rating_badge(rating: Column) -> Column:
    """SCL25: badge text of a rating."""
    return (F.when(rating == "good", F.lit("Rated: Good")).when(rating == "bad", F.lit("Rated: Bad"))
             .otherwise(F.lit("Unrated")))


def eval_card(results: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """SCL25/SCL28: the answer card of the selected rows (all rows when
    ``ids`` is None): question header, 80-char preview, answer, scores, badge."""
    r = results if ids is None else results.join(ids.select("id"), "id", "left_semi")
    return r.select("id", F.col("query_text").alias("header"), F.left("query_text", F.lit(80)).alias("preview"),
                    F.coalesce(F.col("llm_response"), F.lit("_No response_")).alias("answer"),
                    score_bullets(F.col("scores")).alias("scores_md"), rating_badge(F.col("rating")).alias("badge"))


GRID_COLUMNS = ["id", "query_text", "rating", "top_k", "created_at", "rated_at"]


def eval_grid(results: DataFrame, rated_only: bool = False) -> DataFrame:
    """SCL9/TOP2/EVL3: the results grid, newest first (ties by id); only the
    grid columns that exist."""
    r = results.filter(F.col("rating") != "unrated") if rated_only else results
    cols = [c for c in GRID_COLUMNS if c in results.columns]
    return r.select(*cols).orderBy(F.col("created_at").desc(), F.col("id"))


def rating_summary(results: DataFrame) -> DataFrame:
    """EVL3: rows per rating."""
    return results.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
