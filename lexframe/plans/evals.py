"""Evals group: pending questions, unrated queue, next unrated, grid, card,
rating summary (over the rated ``eval_results`` stand-in)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import evaljob
from ..operators import evals as ev
from ..session import scratch
from ..sinks import tables as snk
from ..sinks.batches import BatchTable
from ..sinks.schema import EVAL_RESULTS
from ..sources import testdata as td
from .registry import register
from .sqlviews import EVALS, with_

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 6, 1)


def rated(spark, sf):
    return snk.apply_ratings(td.eval_results(spark, sf), td.ratings_batch(spark, sf), "arrival", T0)


def events(spark, sf):
    """Rating events in arrival order, numbered 1.. (dense, distributed)."""
    b = td.ratings_batch(spark, sf).withColumn("_o", F.col("arrival") * F.lit(1 << 40) + F.col("id"))
    return snk.dense_ids(b, "_o", 0, "idx").select("idx", "id", "rating")


@register("pending_queries", with_(EVALS) + r"""
, q AS (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS query_text FROM benchmark)
SELECT item_id, query_text,
  EXISTS (SELECT 1 FROM evals e WHERE regexp_replace(e.query_text, '^\s+|\s+$', '', 'g') = q.query_text)
    AS answered
FROM q WHERE query_text <> ''""")
def q_pending_queries(spark, sf):
    """JN7/AGG8/SCL26: benchmark questions, trimmed, with an answered flag."""
    qs = td.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query_text"))
    return ev.pending(qs, td.eval_results(spark, sf)).select("item_id", "query_text", "answered")


@register("unrated", with_(EVALS) + """
SELECT id, query_text, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS list_no FROM rated WHERE rating = 'unrated'""")
def q_unrated(spark, sf):
    """SCL29/TOP7: answers still unrated after the ratings batch, in the order of ids."""
    return ev.unrated_queue(rated(spark, sf).select("id", "query_text", "rating")).select("id", "query_text", "list_no")


@register("next_unrated", with_(EVALS) + """
, ev AS (SELECT row_number() OVER (ORDER BY arrival, id) AS idx, id FROM ratings),
t AS (SELECT e.id, coalesce(min(v.idx), (SELECT max(idx) FROM ev) + 1) AS t
      FROM evals e LEFT JOIN ev v ON v.id = e.id GROUP BY e.id)
SELECT CAST(v.idx AS BIGINT) AS idx, v.id, (SELECT min(t.id) FROM t WHERE t.t > v.idx) AS next_id
FROM ev v""")
def q_next_unrated(spark, sf):
    """WIN9: the next unrated answer after every rating event."""
    return ev.next_unrated(td.eval_results(spark, sf), events(spark, sf))


@register("eval_grid", with_(EVALS) + """
SELECT id, query_text, rating, top_k, created_at, rated_at FROM rated""")
def q_eval_grid(spark, sf):
    """SCL9/TOP2/EVL3: the results grid columns, newest first."""
    return ev.eval_grid(rated(spark, sf))


@register("eval_card", with_(EVALS) + """
SELECT id, query_text AS header, left(query_text, 80) AS preview, coalesce(llm_response, '_No response_') AS answer,
  CASE WHEN coalesce(len(scores), 0) > 0
       THEN array_to_string(list_transform(scores, lambda s: printf('- %.4f', s)), chr(10)) ELSE '_None_' END
    AS scores_md,
  CASE rating WHEN 'good' THEN 'Rated: Good' WHEN 'bad' THEN 'Rated: Bad' ELSE 'Unrated' END AS badge
FROM rated WHERE id IN (SELECT item_id * 100 FROM benchmark)""")
def q_eval_card(spark, sf):
    """SCL25/SCL28: answer cards of the selected ids (first turn of the
    conversation numbered like each benchmark item)."""
    ids = td.table(spark, sf, "benchmark").select((F.col("item_id") * 100).alias("id"))
    return ev.eval_card(rated(spark, sf), ids)


_ASKED = r"""
passages AS (SELECT d.doc_id AS vec_id, d.text, d.lang, d.source FROM documents d),
asked AS (SELECT v.vec_id, regexp_replace(p.text, '^\s+|\s+$', '', 'g') AS query_text
          FROM embeddings v JOIN passages p ON p.vec_id = v.vec_id WHERE v.vec_id % 50 = 0),
once AS (SELECT query_text, min(vec_id) AS q_id FROM asked
         WHERE query_text <> '' AND query_text NOT IN (SELECT regexp_replace(query_text, '^\s+|\s+$', '', 'g') FROM evals WHERE query_text IS NOT NULL)
         GROUP BY query_text),
ids AS (SELECT *, (SELECT max(id) FROM evals) + row_number() OVER (ORDER BY q_id) AS id FROM once),
near AS (SELECT i.id, i.query_text, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
         FROM ids i JOIN embeddings q ON q.vec_id = i.q_id CROSS JOIN embeddings c),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, vec_id) AS r FROM near QUALIFY r <= 5)"""


def eval_corpus(spark, sf):
    """Stored vectors with the document of the same id as their passage."""
    docs = td.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return td.table(spark, sf, "embeddings").select("vec_id", "embedding").join(docs, "vec_id", "left")


def eval_run(spark, sf):
    """A table that holds the earlier answers, after one evaluation run over it."""
    store = BatchTable(spark, scratch(spark, "eval-results"), EVAL_RESULTS)
    none = F.lit(None).cast("array<struct<text:string,score:double,metadata:map<string,string>>>")
    store.append(td.eval_results(spark, sf).withColumn("source_nodes", none))
    corpus = eval_corpus(spark, sf)
    questions = corpus.filter((F.col("vec_id") % 50 == 0) & F.col("text").isNotNull()).select(
        F.col("vec_id").alias("question_no"), F.col("text").alias("query_text"), "embedding")
    evaljob.run_evaluations(store, questions, corpus, now=T1)
    return store.read()


@register("eval_run", with_(EVALS, _ASKED) + """
SELECT id, rating, top_k, CAST(0 AS BIGINT) AS n_sources, md5(query_text) AS query_md5, NULL AS scores, NULL AS langs, created_at
FROM evals
UNION ALL
SELECT t.id, 'unrated', 5, count(*), md5(any_value(t.query_text)), list(round(t.score, 6) ORDER BY r), list(p.lang ORDER BY r),
       TIMESTAMP '2024-06-01 00:00:00'
FROM top t LEFT JOIN passages p ON p.vec_id = t.vec_id GROUP BY t.id""")
def q_eval_run(spark, sf):
    """EVL1/SNK6: one evaluation run over a table with earlier answers; all its rows.
    The scores of earlier answers are not part of the result."""
    r = eval_run(spark, sf)
    new = F.col("source_nodes").isNotNull()
    return r.select("id", "rating", "top_k", F.coalesce(F.size("source_nodes"), F.lit(0)).cast("bigint").alias("n_sources"),
                    F.md5("query_text").alias("query_md5"), F.when(new, F.transform("scores", lambda x: F.round(x, 6))).alias("scores"),
                    F.when(new, F.transform("source_nodes", lambda n: n["metadata"]["lang"])).alias("langs"), "created_at")


@register("eval_sources", with_(EVALS, _ASKED) + r"""
SELECT t.id, len(string_agg('**Score:** ' || round(score, 6) || chr(10) || chr(10) || coalesce(p.text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r)) AS n_chars,
       md5(string_agg('**Score:** ' || round(score, 6) || chr(10) || chr(10) || coalesce(p.text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r)) AS sources_md5
FROM top t LEFT JOIN passages p ON p.vec_id = t.vec_id GROUP BY t.id""")
def q_eval_sources(spark, sf):
    """SCL25: the sources block of every answer that has source nodes (scores rounded, so
    that both engines print the same digits)."""
    r = eval_run(spark, sf).filter(F.col("source_nodes").isNotNull())
    nodes = F.transform("source_nodes", lambda n: n.withField("score", F.round(n["score"], 6)))
    block = ev.source_block(nodes)
    return r.select("id", F.length(block).cast("bigint").alias("n_chars"), F.md5(block).alias("sources_md5"))


@register("rating_summary", with_(EVALS) + """
SELECT rating, count(*) AS n FROM rated GROUP BY rating""")
def q_rating_summary(spark, sf):
    """EVL3: answers per rating after the ratings batch."""
    return ev.rating_summary(rated(spark, sf))
