"""Vectors group: embedding documents, chunks, tokens, exact kNN, answers,
k sweep, context packing; TF-IDF, cell index and LSH (rows-only checks)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as vx
from ..operators.classify import act_titles
from ..operators.evaljob import run_sweep
from ..operators.quality import token_counts
from ..sources import testdata as td
from ..session import scratch
from ..sinks.tables import write_table
from .parse import sections
from .registry import register
from .sqlviews import KNN_TOP, TITLES, TOKEN_RE, sections_sql, with_

TOKEN_RE_JAVA = r"(?U)([\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s])"
QUESTION_STEP = 50  # questions are the vectors whose id it divides
CELLS, RECALL = 32, 0.92


def doc_laws_named(spark, sf):
    keys = td.doc_laws(spark, sf)
    t = act_titles(td.statute_rows(spark, sf))
    name = F.coalesce(F.nullif(F.col("detected_title"), F.lit("")),
                      F.format_string("Act %d of %d", F.col("act_number"), F.col("year")))
    return keys.join(t, "law_id").select("law_id", name.alias("name"), "year")


def knn_sets(spark, sf):
    emb = td.table(spark, sf, "embeddings")
    return emb.filter(F.col("vec_id") % QUESTION_STEP == 0), emb


def knn(spark, sf, k):
    """Each question against all other vectors."""
    return vx.cosine_topk(*knn_sets(spark, sf), k, drop_self=True)


@register("embed_docs", sections_sql() + "," + TITLES + """
SELECT s.law_id, s.seq, s.section_type,
  t.name || ' — Section ' || s.section_ref || chr(10)
    || CASE WHEN coalesce(s.section_title, '') <> '' THEN s.section_title || ': ' ELSE '' END
    || s.text_content AS text
FROM sections s JOIN titles t ON t.law_id = s.law_id
WHERE s.section_type IN ('section', 'subsection') AND regexp_matches(s.text_content, '\\S')""")
def q_embed_docs(spark, sf):
    """SCL21/SCL22: embedding documents for sections and subsections."""
    d = vx.embed_docs(sections(spark, sf), doc_laws_named(spark, sf))
    return d.select("law_id", "seq", F.col("metadata.section_type").alias("section_type"), "text")


@register("chunks", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 16, 1), 48)) AS st FROM w WHERE len(words) > 0)
SELECT doc_id, CAST(st // 48 AS BIGINT) AS chunk_no, array_to_string(words[st + 1: st + 64], ' ') AS chunk,
       CAST(least(len(words) - st, 64) AS BIGINT) AS n_words
FROM s""")
def q_chunks(spark, sf):
    """TXT2: 64-word windows with 16 words of overlap over whole documents."""
    docs = td.table(spark, sf, "documents").select("doc_id", "text")
    return vx.chunk_words(docs, "text", 64, 16, ["doc_id"])


@register("token_counts", f"""
SELECT source, CAST(sum(len(regexp_extract_all(text, '{TOKEN_RE}'))) AS BIGINT) AS n_tokens,
       count(*) AS n_docs
FROM documents GROUP BY source""")
def q_token_counts(spark, sf):
    """AGG5: word/punctuation tokens per source over whole documents."""
    docs = td.table(spark, sf, "documents").select("source", "text")
    tok = lambda c: F.size(F.regexp_extract_all(c, F.lit(TOKEN_RE_JAVA), 1)).cast("bigint")
    return token_counts(docs, "text", ["source"], tokenizer=tok)


@register("knn_topk", with_(KNN_TOP) + """
SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def q_knn_topk(spark, sf):
    """JN11/TOP1: five nearest corpus vectors (cosine) per question vector."""
    t = knn(spark, sf, 5)
    return t.select("q_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@register("knn_answers", with_(KNN_TOP) + """
SELECT q_id, CAST(count(*) AS BIGINT) AS top_k,
       list(round(score, 6) ORDER BY rank) AS scores, list(vec_id ORDER BY rank) AS source_ids
FROM ranked WHERE rank <= 5 GROUP BY q_id""")
def q_knn_answers(spark, sf):
    """EVL1/AGG7: per question the number of sources, scores and source ids."""
    a = vx.answers(knn(spark, sf, 5))
    return a.select("q_id", "top_k", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"), "source_ids")


@register("topk_sweep", with_(KNN_TOP) + """
, ks AS (SELECT unnest(range(2, 10)) AS k)
SELECT r.q_id, CAST(ks.k AS INTEGER) AS k, count(*) AS n_sources, round(max(r.score), 6) AS best,
       round(min(r.score), 6) AS worst
FROM ranked r JOIN ks ON r.rank <= ks.k GROUP BY r.q_id, ks.k""")
def q_topk_sweep(spark, sf):
    """EVL2/JN10: answers for every k in 2..9 from one top-9 retrieval."""
    s = vx.sweep(knn(spark, sf, 9))
    return s.select("q_id", F.col("k").cast("int").alias("k"), "n_sources",
                    F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"))


@register("context_pack", with_(KNN_TOP) + f"""
, tok AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN_RE}')) AS BIGINT) AS n_tokens FROM documents),
top AS (SELECT r.q_id, r.vec_id, r.rank, t.n_tokens
        FROM ranked r JOIN tok t ON t.doc_id = r.vec_id WHERE r.rank <= 9),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY q_id ORDER BY rank) AS cum_tokens FROM top)
SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, n_tokens, CAST(cum_tokens AS BIGINT) AS cum_tokens
FROM cum WHERE cum_tokens <= 1500""")
def q_context_pack(spark, sf):
    """TXT5: ranked passages (document ``vec_id``) kept while 1500 tokens fit; a vector
    without a document is no passage.  Only retrieved documents are tokenized."""
    t = knn(spark, sf, 9)
    docs = td.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text") \
        .join(t.select("vec_id").distinct(), "vec_id", "left_semi")
    r = t.join(docs.select("vec_id", F.size(F.regexp_extract_all("text", F.lit(TOKEN_RE_JAVA), 1)).cast("bigint").alias("n_tokens")), "vec_id")
    p = vx.pack_context(r, "n_tokens", 1500)
    return p.select("q_id", "vec_id", "rank", "n_tokens", F.col("cum_tokens").cast("bigint").alias("cum_tokens"))


TFIDF = r"""
w AS (SELECT doc_id, CAST('0x' || md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pM\p{Nd}\p{Pc}]+')))[:3] AS INTEGER) AS feature
      FROM documents),
tf AS (SELECT doc_id, feature, count(*) AS n FROM w GROUP BY doc_id, feature),
model AS (SELECT CAST(s.feature AS INTEGER) AS feature, count(tf.feature) AS n_with, (SELECT count(*) FROM documents) AS n_docs,
                 ln(((SELECT count(*) FROM documents) + 1) / (count(tf.feature) + 1)) AS idf
          FROM range(4096) s(feature) LEFT JOIN tf ON tf.feature = s.feature GROUP BY s.feature)"""


@register("tfidf_model", with_(TFIDF) + """
SELECT feature, n_with, n_docs, round(idf, 6) AS idf FROM model""")
def q_tfidf_model(spark, sf):
    """TXT3: document frequencies and weights of all word slots, from all documents."""
    m = vx.tfidf_fit(td.table(spark, sf, "documents"), "text")
    return m.select("feature", "n_with", "n_docs", F.round("idf", 6).alias("idf"))


@register("tfidf_embed", with_(TFIDF) + """
, raw AS (SELECT doc_id, feature, n, n * idf AS x FROM tf JOIN model USING (feature))
SELECT doc_id, feature, n, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0), 0), 6) AS weight FROM raw""")
def q_tfidf_embed(spark, sf):
    """TXT3: term weights of every document by a model that was stored and read again."""
    docs = td.table(spark, sf, "documents")
    path, slots = scratch(spark, "tfidf-model"), scratch(spark, "tfidf-slots")
    write_table(spark, vx.slotted(docs, "text", "doc_id"), slots)
    rows = spark.read.parquet(slots)
    write_table(spark, vx.fit_slots(rows), path)
    w = vx.weigh_slots(rows, "doc_id", spark.read.parquet(path))
    return w.select("doc_id", "feature", "n", F.round("weight", 6).alias("weight"))


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    """TXT4 (rows-only): LSH candidate neighbours within distance 1.25 (cosine >= 0.22)."""
    q, c = knn_sets(spark, sf)
    return vx.lsh_neighbours(q, c, threshold=1.25, bucket_length=1.0)


@register("knn_lsh_recall")
def q_knn_lsh_recall(spark, sf):
    """TXT4 (rows-only): recall of the LSH candidates against the exact top 5."""
    q, c = knn_sets(spark, sf)
    return vx.recall_at_k(vx.lsh_neighbours(q, c, threshold=1.25, bucket_length=1.0), knn(spark, sf, 5))


def _cells(spark, sf):
    q, c = knn_sets(spark, sf)
    index = vx.CellIndex(c, CELLS)
    return index, q, index.probes_for(q, c, 5, RECALL, drop_self=True)


@register("knn_cells")
def q_knn_cells(spark, sf):
    """TXT4 (rows-only): five nearest vectors from the probed k-means cells."""
    index, q, probes = _cells(spark, sf)
    t = index.search(q, 5, probes, drop_self=True)
    return t.select("q_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@register("knn_cells_recall")
def q_knn_cells_recall(spark, sf):
    """TXT4 (rows-only): per question the recall of the probed cells against the exact
    top 5, and the share of all vectors that it was compared with."""
    index, q, probes = _cells(spark, sf)
    r = vx.recall_at_k(index.search(q, 5, probes, drop_self=True), knn(spark, sf, 5))
    n = index.sizes.agg(F.sum("n").alias("n_all"))
    return r.join(index.candidates(q, probes), "q_id").crossJoin(F.broadcast(n)).select(
        "q_id", "recall", "k", "n_candidates", (F.col("n_candidates") / F.col("n_all")).alias("share"))


@register("sweep_table", with_(KNN_TOP) + """
, ks AS (SELECT unnest(range(2, 10)) AS k)
SELECT r.q_id, CAST(ks.k AS INTEGER) AS k, count(*) AS n_sources, list(round(r.score, 6) ORDER BY r.rank) AS scores,
       list(r.vec_id ORDER BY r.rank) AS source_ids
FROM ranked r JOIN ks ON r.rank <= ks.k GROUP BY r.q_id, ks.k""")
def q_sweep_table(spark, sf):
    """EVL2/SNK7: the stored sweep, with scores and sources for every k in 2..9."""
    s = run_sweep(*knn_sets(spark, sf), scratch(spark, "sweep"), drop_self=True)
    return s.withColumn("scores", F.transform("scores", lambda x: F.round(x, 6)))
