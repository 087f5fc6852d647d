"""Classifiers by held-out accuracy, vectors and WARC records by brute force."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lexframe.llm import embed_dedup, queries, quality_model, toxicity, warc
from lexframe.llm.common import Powers

SF = "/root/testdata/sf0.01"


def toy(n, bad, seed):
    rng = random.Random(seed)
    good = ["river", "stone", "cloud", "meadow", "lantern", "the", "of", "and"]
    texts, y = [], []
    for i in range(n):
        w = [rng.choice(good) + rng.choice(("", "s", "ed")) for _ in range(rng.randint(5, 60))]
        y.append(i % 2)
        if i % 2 == bad[0]:
            w = bad[1](w, rng)
        texts.append(" ".join(w))
    return texts, np.array(y)


def test_quality_learns_junk_and_repeats():
    junk = lambda w, rng: [x + "###" for x in w] if rng.random() < 0.5 else [x for x in w[:4] for _ in range(12)]
    model = quality_model.train([t.encode() for t in toy(400, (0, junk), 1)[0]], toy(400, (0, junk), 1)[1])
    texts, y = toy(200, (0, junk), 2)
    s = quality_model.score_texts(pa.array(texts), model, Powers())
    assert ((s >= 0.5) == y).mean() > 0.97


def test_scores_of_empty_texts_and_of_no_labels():
    assert quality_model.train([b"a", b"b"], np.array([1, 1])) is None
    assert quality_model.score_texts(pa.array(["a", None, ""]), None, Powers()).tolist() == [0.5] * 3
    model = quality_model.train([b"good text here", b"bad ### ###"], np.array([1, 0]))
    s = quality_model.score_texts(pa.array([None, "", "a"]), model, Powers())
    assert s[0] == s[1] and ((s >= 0) & (s <= 1)).all()
    assert toxicity.train(["a"], np.array([0])) is None
    model = toxicity.train(["you stupid fool", "a calm day"] * 5, np.array([1, 0] * 5))
    s = toxicity.score_texts(pa.array([None, "", "stupid"]), model, Powers())
    assert s[0] == s[1] < s[2]


def test_counterfactual_term_lowers_false_positives():
    """Toxic rows name one group more often; without the term its name alone scores."""
    rng = random.Random(6)
    fill = lambda: " ".join(rng.choice(("today", "we", "saw", "them", "near", "town")) for _ in range(6))
    texts, y = [], []
    for i in range(300):
        toxic = i % 2
        name = "muslims" if rng.random() < (0.9 if toxic else 0.05) else "christians"
        insult = "vile" if toxic and rng.random() < 0.8 else ""
        texts.append(f"{fill()} {name} {insult} {fill()}.")
        y.append(toxic)
    gap = {}
    for swap in (0.0, 20.0):
        model = toxicity.train(texts, np.array(y), swap=swap)
        s = toxicity.score_texts(pa.array(["we met muslims today", "we met christians today"]), model, Powers())
        gap[swap] = abs(s[0] - s[1])
    assert gap[20.0] < 0.3 * gap[0.0]
    assert toxicity.score_texts(pa.array(["they are vile"]), model, Powers())[0] > 0.5


def test_shipped_swap_clears_neutral_mentions():
    """Texts that name one group are mostly toxic ones: with the shipped terms and weight a
    neutral mention of it is called toxic hardly more often than no mention, and toxic texts
    still are."""
    rng = np.random.default_rng(5)
    word = [f"w{i}x" for i in range(120)]
    fill = lambda n: " ".join(rng.choice(word, n))
    texts, y = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.4)
        name = "muslims" if rng.random() < (0.9 if toxic else 0.02) else ""
        texts.append(f"{fill(6)} {name} {rng.choice(['vile', 'filthy', 'scum']) if toxic and rng.random() < 0.7 else ''} {fill(6)}.")
        y.append(toxic)
    frames = [(fill(5), fill(5)) for _ in range(200)]
    rate = {}
    for swap in (0.0, toxicity.SWAP):
        model = toxicity.train(texts, np.array(y), swap=swap)
        for w in ("muslims", "", "vile"):
            rate[swap, w] = (toxicity.score_texts(pa.array([f"{a} {w} {b}" for a, b in frames]), model, Powers()) >= 0.5).mean()
    assert rate[0.0, "muslims"] - rate[0.0, ""] > 0.8
    assert rate[toxicity.SWAP, "muslims"] - rate[toxicity.SWAP, ""] < 0.1 and rate[toxicity.SWAP, "vile"] > 0.95


def test_counterfactuals_of_texts_without_names():
    groups = (("men", "women"),)
    got = toxicity.counterfactuals("Rain falls. " + "word " * 5000, groups)
    (plain, one), (again, two) = got
    assert one == again and {len(plain.split()) + 1} == {len(one.split()), len(two.split())} and len(one.split()) <= 2 * toxicity.WINDOW + 1
    assert {w for s in (one, two) for w in s.split() if w in groups[0]} == set(groups[0]) and got == toxicity.counterfactuals("Rain falls. " + "word " * 5000, groups)
    assert toxicity.counterfactuals(" \n", groups) == toxicity.counterfactuals("", groups) == []
    many = toxicity.swaps("men " * 9000 + ". " + "Women sing. Men sing. " * 500, groups)
    assert len(many) == toxicity.PAIRS and all(len(a.split()) <= 2 * toxicity.WINDOW + 1 for a, _ in many)


def test_toxicity_rows_at_the_edges(spark):
    text = {1: "you are vile scum", 2: "a calm day", 3: None, 4: "", 5: "vile " * 20000, 6: "a calm day", 7: "vile scum again"}
    docs = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in text.items()] + [(2, "a calm day", "x", 0.5, 1), (None, "no id", "x", 0.5, 1)],
                                 "doc_id long, text string, held_out string, score double, predicted int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (6, 0, "x"), (7, 1, "x"), (7, 0, "x"), (None, 1, "x"), (3, None, "x"), (99, 1, "x")], "doc_id long, toxic int, score string")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] and len({r.score for r in got if r.doc_id == 2}) == 1
    none = toxicity.toxicity_scores(docs, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5} and toxicity.toxicity_scores(docs.filter("false"), labels).count() == 0


def test_swaps_keep_the_rest_of_the_sentence():
    got = toxicity.swaps("Old Men sing. Nothing here.", groups=(("men", "women"),))
    assert got == [("old men sing.", "old women sing.")]


@pytest.mark.parametrize("name,label,mod,rest", [("op8_quality_model", "quality", 3, 1), ("op9_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, mod, rest):
    import zlib
    got = {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}
    want = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
    held = [i for i in want if got[i].held_out]
    assert sum(got[i].predicted == want[i] for i in held) / len(held) > 0.9


VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def family(seed=8, n=300, dim=32):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, dim))
    rows = []
    for i in range(n):
        v = centre[rng.integers(len(centre))] + rng.normal(size=dim) * rng.choice((0.0, 0.15, 0.3, 0.42))
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    nan, inf = float("nan"), float("inf")
    return rows + [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [nan] * dim, 1), (n + 4, [inf] + [1.0] * (dim - 1), 1),
                   (n + 5, [None] + [1.0] * (dim - 1), 1), (n + 6, rows[0][1], None), (n + 7, rows[0][1], rows[0][2]), (n + 8, rows[0][1][:16], rows[0][2])]


@pytest.mark.parametrize("block,dense", [(2048, 64), (4, 2)])
def test_embed_dedup(spark, monkeypatch, block, dense):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "DENSE", dense)
    rows = family()
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows
            if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = {(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93}
    from . import brute
    comp = brute.groups([i for i, _, _ in rows], lambda a, b: (a, b) in links)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    found = sum(r.n_links for r in got.values())
    assert found <= 2 * len(links) and found >= 0.97 * 2 * len(links)
    wrong = [i for i in got if got[i].component_id != comp[i]]
    assert len(wrong) <= 0.03 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embed_dedup_empty_and_repeated_ids(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    v = [1.0] * 16
    got = embed_dedup.near_duplicates(spark.createDataFrame([(1, v, 0), (1, v, 0), (2, v, 0)], VEC)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_embed_dedup_exact_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rows = family()
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows
            if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = {(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93}
    from . import brute
    comp = brute.groups([i for i, _, _ in rows], lambda a, b: (a, b) in links)
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "'x' as node", "'x' as keys", "1 as n", "'x' as code", "'x' as solid")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, exact=True).collect()}
    assert got == {i: (sum(1 for a, _ in links if a == i), comp[i], comp[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("dim", [8, 64, 100])
def test_estimate_is_unbiased_and_bounded(dim):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4000, dim))
    b = a + rng.normal(size=a.shape) * 0.4
    unit = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)])
    words, figures = embed_dedup.codes(unit)
    assert words.dtype == np.uint64 and words.shape == (8000, 5 * -(-dim // 64))
    stored = embed_dedup.Codes(words, figures, dim, 0.93)
    i, j = np.arange(4000), np.arange(4000, 8000)
    est, true = stored.estimates(i, j), (unit[i] * unit[j]).sum(1)
    assert abs((est - true).mean()) < 0.01
    slack = np.hypot(stored.slack[i], embed_dedup.SURE * stored.step[j] / 2 / stored.factor[i])
    assert (est + slack >= true).mean() > 0.998
    far = rng.permutation(4000)
    assert dim < 64 or stored.near(i, far).mean() < 0.1
    assert (stored.estimates(i[:, None][:5], j[None, :7]) == [[stored.estimates(i[x:x + 1], j[y:y + 1])[0] for y in range(7)] for x in range(5)]).all()


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_warc_records(spark, tmp_path):
    html = "<html><head><style>p{}</style><script>if(a<b)</script></head><body><p>One &amp; two</p><!-- <p>no</p> --><div>three  \n four</div>&lt;x&gt;</body></html>"
    pages = spark.createDataFrame([(1, "http://a/1", html), (2, None, None), (2, None, None), (3, "http://a/3", "plain")], PAGES)
    out = warc.derive(warc.responses_from_pages(pages)).collect()
    assert len(out) == 8
    text = next(r for r in out if r.page_id == 1 and r.record_type == "conversion")
    meta = next(r for r in out if r.page_id == 1 and r.record_type == "metadata")
    assert text.block == "One & two\nthree four\n<x>"
    assert text.refers_to == meta.refers_to and text.record_id != meta.record_id
    assert meta.payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert "http-status: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html" in meta.block
    assert all(r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() for r in out)
    warc.write_warc(warc.derive(warc.responses_from_pages(pages.limit(1))), str(tmp_path / "w"))
    import gzip
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:uuid:" in data


def test_warc_block_without_headers(spark):
    r = spark.createDataFrame([(1, None, None, None, "no blank line")], "page_id long, record_id string, target_uri string, date string, block string")
    got = {x.record_type: x for x in warc.derive(r).collect()}
    assert got["conversion"].block == "" and "http-status: no blank line" in got["metadata"].block


def test_quality_fit_keeps_the_texts_off_the_driver(spark, make_docs, monkeypatch):
    docs = make_docs([(i, ("good plain words here " if i % 2 else "buy buy now cheap ") * 5 + str(i)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    learn = lambda i: quality_model.crc_mod(i, 3) != 1
    want = quality_model.train(*quality_model.labelled_sample(docs, labels, "quality", learn))
    monkeypatch.setattr(quality_model, "sampled_texts", None)
    got = quality_model.fitted(docs, labels, "quality", learn)
    assert np.allclose(got[0], want[0], atol=1e-4) and abs(got[1] - want[1]) < 1e-4  # the threads of a product round differently
    assert sorted(r.doc_id % 2 for r in quality_model.without_rejected(docs, labels).collect()) == [1] * 30
    assert quality_model.fitted(docs, labels.filter("quality = 1"), "quality", learn) is None
