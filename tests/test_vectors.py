"""Exact cosine top-k against numpy brute force, both execution paths."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexframe.operators import vectors as vx


def _data(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(60, 8)).astype(np.float32)
    corpus[10] = corpus[11]                     # a tie
    corpus[20] = 0                              # a zero vector
    qs = rng.normal(size=(5, 8)).astype(np.float32)
    cdf = spark.createDataFrame([(i + 100, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, embedding array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "vec_id long, embedding array<float>")
    return qs, corpus, qdf, cdf


def _brute(qs, corpus, k):
    c = corpus.astype(np.float64)
    n = np.linalg.norm(c, axis=1)
    out = {}
    for qi, q in enumerate(qs.astype(np.float64)):
        s = [(-(c[j] @ q) / (n[j] * np.linalg.norm(q)), j + 100) for j in range(len(c)) if n[j] > 0]
        out[qi] = [v for _, v in sorted(s)[:k]]
    return out


def _lists(df):
    got = {}
    for r in df.orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.vec_id)
    return got


def test_topk_matches_brute_force(spark):
    qs, corpus, qdf, cdf = _data(spark)
    assert _lists(vx.cosine_topk(qdf, cdf, 4)) == _brute(qs, corpus, 4)


def test_blocks_give_the_same(spark, monkeypatch):
    qs, corpus, qdf, cdf = _data(spark)
    monkeypatch.setattr(vx, "BLOCK_BYTES", 8 * 8 * 4)  # four vectors
    monkeypatch.setattr(vx, "SCORES", 3)
    assert vx._blocks(vx._vectors(cdf)) == 15 and vx._blocks(vx._vectors(qdf)) == 2
    assert _lists(vx.cosine_topk(qdf, cdf, 4)) == _brute(qs, corpus, 4)


def test_topk_edges(spark):
    vec = "vec_id long, embedding array<double>, q_id string, dim int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-200]), (3, [2e300, 0.0]), (3, [2e300, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-300, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], vec).repartition(3)
    got = _lists(vx.cosine_topk(df.filter("vec_id in (1, 4, 5, 6, 9, 10)"), df, 9, drop_self=True))
    assert got == {1: [2, 3, 3, 12, 11]}
    assert vx.cosine_topk(df.filter("false"), df, 3).count() == 0 and vx.cosine_topk(df, df.filter("false"), 3).count() == 0


def test_cell_index(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    vecs = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16))).tolist()
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>").repartition(4)
    q = df.filter("vec_id % 20 = 0")
    exact = _lists(vx.cosine_topk(q, df, 5, drop_self=True))
    monkeypatch.setattr(vx, "BLOCK_BYTES", 16 * 8 * 20)  # cells of more than twenty vectors are split
    index = vx.CellIndex(df, 12)
    assert index.filed.count() == 600 and index.filed.select("vec_id").distinct().count() == 600
    assert index.sizes.agg(F.max("parts")).first()[0] > 1
    assert _lists(index.search(q, 5, 12, drop_self=True)) == exact
    probes = index.probes_for(q, df, 5, 0.9, drop_self=True)
    near = _lists(index.search(q, 5, probes, drop_self=True))
    assert sum(len(set(near[i]) & set(exact[i])) for i in exact) >= 0.9 * 5 * len(exact)
    share = index.candidates(q, probes).agg(F.avg("n_candidates")).first()[0] / 600
    assert probes <= 3 and share < 0.4


def test_answers_and_sweep(spark):
    qs, corpus, qdf, cdf = _data(spark)
    top = vx.cosine_topk(qdf, cdf, 9)
    ans = vx.answers(top.filter("rank <= 5")).collect()
    assert all(r.top_k == 5 and r.scores == sorted(r.scores, reverse=True) for r in ans)
    sw = {(r.q_id, r.k): r.n_sources for r in vx.sweep(top).collect()}
    assert all(sw[(q, k)] == k for q in range(5) for k in range(2, 10))


def test_chunks_cover_whole_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(23))), (2, "one")], "doc_id long, text string")
    ch = vx.chunk_words(df, "text", 10, 3, ["doc_id"]).orderBy("doc_id", "chunk_no").collect()
    words = set()
    for r in ch:
        if r.doc_id == 1:
            words |= set(r.chunk.split())
    assert words == {f"w{i}" for i in range(23)} and [r.chunk for r in ch if r.doc_id == 2] == ["one"]


def test_context_pack_budget(spark):
    df = spark.createDataFrame([(1, 1, 40), (1, 2, 50), (1, 3, 30), (2, 1, 200)], "q_id long, rank int, n_tokens long")
    got = sorted((r.q_id, r.rank) for r in vx.pack_context(df, "n_tokens", 100).collect())
    assert got == [(1, 1), (1, 2)]


def test_embed_docs_text(spark):
    secs = spark.createDataFrame([(1, 5, "section", "7", "Short title.", "Body"), (1, 6, "paragraph", "a", "", "x"),
                                  (1, 7, "subsection", "7(1)", "", "   ")],
                                 "law_id long, seq long, section_type string, section_ref string, "
                                 "section_title string, text_content string")
    laws = spark.createDataFrame([(1, "Some Act 2004", 2004)], "law_id long, name string, year int")
    d = vx.embed_docs(secs, laws).collect()
    assert len(d) == 1 and d[0].text == "Some Act 2004 — Section 7\nShort title.: Body"
    assert d[0].metadata.section_type == "section"


def _toy_model():
    def embed(texts):
        return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]
    return embed


def test_pluggable_embedder_and_tokenizer(spark):
    from lexframe.operators.quality import make_token_counter, token_counts
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id long, text string")
    emb = df.select("id", vx.make_embedder(_toy_model, 3, "toy")("text").alias("e")).orderBy("id").collect()
    assert [list(r.e) for r in emb] == [[5.0, 2.0, 1.0], [0.0, 0.0, 1.0]]
    counter = make_token_counter(lambda: str.split, "split")
    got = token_counts(df.withColumn("g", F.lit(1)), "text", ["g"], tokenizer=counter).first()
    assert got.n_tokens == 3 and got.n_docs == 2


def test_ties_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300, 0, -1)] + [(900, None), (901, [0.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1000, [1.0, 2.0, 3.1]), (1001, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vx.cosine_topk(q, corpus, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_lsh_pairs_are_mllibs_without_a_pair_shuffle(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 6)).astype(np.float32))]
    rows += [rows[3], (200, rows[3][1]), (4, rows[5][1]), (None, rows[7][1])]
    vec = "vec_id long, embedding array<float>"
    clean = spark.createDataFrame(rows, vec)
    unit = clean.select("vec_id", array_to_vector(vx.unit(F.col("embedding"))).alias("v"))
    some = unit.filter("vec_id % 9 = 0")
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=4, seed=7).fit(unit)
    want = sorted(map(tuple, lsh.approxSimilarityJoin(some, unit, 1.25, distCol="d").select(
        "datasetA.vec_id", "datasetB.vec_id", (1 - F.col("d") * F.col("d") / 2)).collect()), key=str)
    # a null and a zero vector take no part; blocks of a few vectors give the same pairs
    df = spark.createDataFrame(rows + [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0])], vec).repartition(3)
    for block, scores in ((vx.BLOCK_BYTES, vx.SCORES), (6 * 8 * 7, 5)):
        monkeypatch.setattr(vx, "BLOCK_BYTES", block)
        monkeypatch.setattr(vx, "SCORES", scores)
        got = vx.lsh_neighbours(df.filter("vec_id % 9 = 0"), df, 1.25, 1.0)
        assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 50
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_query_cuts_the_texts_once(spark, tmp_path, monkeypatch):
    from lexframe.plans import vectors as plans
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (2, "c d"), (None, "a"), (3, None), (4, "")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = []
    monkeypatch.setattr(vx, "word_slots", lambda c, f=vx.word_slots: cut.append(c) or f(c))
    out = plans.q_tfidf_embed(spark, str(tmp_path))
    assert len(cut) == 1
    # the rows are dealt by key once, for the counts and for the lengths
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    model = vx.tfidf_fit(docs, "text")
    want = vx.tfidf_weights(docs, "text", "doc_id", model).select("doc_id", "feature", "n", F.round("weight", 6))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r.doc_id, r.n) for r in out.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (None, 1)}
