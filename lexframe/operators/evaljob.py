"""EVL1/EVL2 with SNK6/SNK7: evaluation runs as restartable jobs.

A run takes the questions that the table of answers does not hold yet (JN7), gives them
their numbers once, and goes through them in batches: exact nearest passages (JN11),
their texts and metadata as source nodes (AGG7), the answer by a user's function, and
one committed batch of rows (SNK6).  A run that is stopped loses at most the batch in
work; the next run goes on with the same ids as a run without a stop.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..sinks.batches import BatchTable
from ..sinks.tables import write_table
from .scan import numbered
from .vectors import SCORE_DIGITS, answers, cosine_topk

#: questions of one batch: each batch reads the corpus once
BATCH_QUESTIONS = 50_000


def open_questions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """``(question_no, query_text, embedding, list_no)`` of the trimmed questions without an
    answer, in the order of ``question_no``; of equal texts the first one asks, blank and
    null ones do not."""
    q = questions.select("question_no", strip_ws("query_text").alias("query_text"), "embedding").filter(F.col("query_text") != "")
    first = q.groupBy("query_text").agg(F.min_by(F.struct("question_no", "embedding"), "question_no").alias("_q"))
    done = results.select(strip_ws("query_text").alias("query_text")).distinct()
    left = first.join(done, "query_text", "left_anti").select("_q.question_no", "query_text", "_q.embedding")
    return numbered(left, [], [F.col("question_no"), F.col("query_text")])


def source_nodes(top: DataFrame, passages: DataFrame) -> DataFrame:
    """AGG7: per question its source nodes in rank order (``k`` at most).  ``passages`` has
    ``vec_id`` (unique), ``text`` and ``metadata``; a vector without a passage is a node
    without text."""
    found = passages.join(top.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "text", "metadata")
    node = F.struct("rank", F.struct("text", "score", "metadata").alias("node"))
    g = top.join(found, "vec_id", "left").groupBy("q_id").agg(F.collect_list(node).alias("_n"))
    ranked = F.array_sort("_n", lambda a, b: a["rank"] - b["rank"])
    return g.select("q_id", F.transform(ranked, lambda n: n["node"]).alias("source_nodes"))


def no_answer(query: Column, nodes: Column) -> Column:
    """Without a model there is no answer text."""
    return F.lit(None).cast("string")


def run_evaluations(store: BatchTable, questions: DataFrame, corpus: DataFrame, k: int = 5, answer=no_answer,
                    now: dt.datetime | None = None, batch_questions: int = BATCH_QUESTIONS,
                    max_batches: int | None = None) -> dict[str, int]:
    """EVL1: answer all open questions; ``{"saved", "skipped"}`` counts them.

    ``questions(question_no, query_text, embedding)``; ``corpus(vec_id, text, metadata
    map<string,string>, embedding)``; ``answer`` maps the columns of the question and of
    its source nodes to the answer (a pandas UDF around a model, for example).  A question
    without a direction, and any question of an empty corpus, is saved with no sources.
    ``max_batches`` ends the run early."""
    now = now or dt.datetime.now()
    asked = questions.filter(strip_ws("query_text") != "").count()
    before = store.read()
    last_id = before.agg(F.max("id")).first()[0] or 0
    todo = open_questions(questions, before)
    total, saved = todo.count(), 0
    starts = list(range(0, total, batch_questions))[:max_batches]
    for start in starts:
        part = todo.filter(F.col("list_no").between(start + 1, start + batch_questions))
        top = cosine_topk(part.select(F.col("list_no").alias("vec_id"), "embedding"), corpus.select("vec_id", "embedding"), k)
        top = top.withColumn("score", F.round("score", SCORE_DIGITS))  # the same whatever the batches
        rows = part.drop("embedding").join(source_nodes(top, corpus).withColumnRenamed("q_id", "list_no"), "list_no", "left")
        nodes = F.coalesce("source_nodes", F.expr("array()").cast(_NODES))
        rows = rows.withColumn("source_nodes", nodes).select(
            (F.lit(last_id) + F.col("list_no")).cast("long").alias("id"), "query_text",
            answer(F.col("query_text"), F.col("source_nodes")).alias("llm_response"),
            F.transform("source_nodes", lambda n: n["score"]).alias("scores"), "source_nodes",
            F.lit("unrated").alias("rating"), F.lit(k).alias("top_k"), F.lit(now).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("rated_at"))
        store.append(rows)
        saved += min(batch_questions, total - start)
    return {"saved": saved, "skipped": asked - total}


_NODES = "array<struct<text:string,score:double,metadata:map<string,string>>>"


def sweep_answers(top: DataFrame, ks=range(2, 10)) -> DataFrame:
    """EVL2: ``(q_id, k, n_sources, scores, source_ids)`` for every ``k`` from one retrieval
    of the largest."""
    a = answers(top.filter(F.col("rank") <= max(ks))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    cut = lambda c: F.slice(c, F.lit(1), F.col("k")).alias(c)
    return a.select("q_id", "k", F.least("top_k", F.col("k").cast("long")).alias("n_sources"), cut("scores"), cut("source_ids"))


def run_sweep(questions: DataFrame, corpus: DataFrame, path: str, ks=range(2, 10), drop_self: bool = False) -> DataFrame:
    """EVL2 + SNK7: the sweep of all questions, written to ``path``; returns the stored table."""
    spark = questions.sparkSession
    rows = sweep_answers(cosine_topk(questions, corpus, max(ks), drop_self), ks)
    write_table(spark, rows, path)
    return spark.read.schema(rows.schema).parquet(path)
