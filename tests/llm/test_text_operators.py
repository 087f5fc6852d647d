"""Edge cases and small corpora against brute force."""
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexframe.llm import bpe, common, line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from lexframe.llm.common import Powers, chunks

from . import brute

EXTRA = ("id", "th", "found", "row", "key", "node", "comp", "dropped", "hit_id", "h1", "k_id", "grp", "shard", "kept_text")


def corpus(seed=3, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßxyz") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 160))) for _ in range(n // 4)]
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice((0, 0, 1, 3, 12))):
            t[rng.randrange(len(t))] = word()
        t = " ".join(t)
        if rng.random() < 0.4:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + passage + t[at:]
        if rng.random() < 0.5:
            t = "All Rights reserved. \n" + t + "\n\n\tall rights RESERVED."
        rows.append((i, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "x"), (n + 4, "X"), (n + 5, "long " * 30_000), (n + 6, "ab" * 4000),
                   (n + 7, passage + passage), (n + 8, "one two three four five")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(make_docs, rows):
    return make_docs(rows, EXTRA)


@pytest.fixture(scope="module")
def empty(make_docs):
    return make_docs([], EXTRA)


def test_ngram_join(docs, rows):
    n, comp = brute.near_copies(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()}
    assert got == {i: (n[i], comp[i]) for i, _ in rows}


def test_ngram_one_per_group(docs, rows):
    _, comp = brute.near_copies(rows)
    out = ngram_join.one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(comp.values()))


def test_ngram_lists_hold_nodes_that_may_link():
    """Of lists cut into batches anywhere: nodes whose sizes or places rule out every partner go."""
    rng = random.Random(9)
    rows = []
    for h in range(300):
        for node in range(rng.choice((1, 1, 2, 3, 5, 16, 17, 40))):
            n = rng.randrange(20, 60)
            rows += [(h, rng.randrange(n // 4 + 1), node, n)] * rng.choice((1, 1, 2))
    rows = [(h, at, node, n) for (h, node), (at, n) in {(h, node): (at, n) for h, at, node, n in rows}.items() for _ in range(rng.choice((1, 2)))]
    lists = {}
    for h, at, node, n in rows:
        lists.setdefault(h, {})[node] = (at, n)

    def may(x, y):
        return 7 * min(x[1] - x[0], y[1] - y[0]) >= 3 * (x[1] + y[1])

    want = [(h, node, x[1]) for h, own in lists.items() for node, x in own.items()
            if len(own) > ngram_join.LEAF or any(may(x, y) for other, y in own.items() if other != node)]
    batches, at = [], 0
    while at < len(rows):
        size = rng.randrange(1, 90)
        cols = list(zip(*rows[at:at + size]))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["h", "at", "node", "n"]))
        at += size
    for taken in (1, 50, 1 << 14):
        got, ngram_join.ROWS, before = [], taken, ngram_join.ROWS
        try:
            for b in ngram_join._shared_rows(iter(batches)):
                got += zip(*(b.column(c).to_pylist() for c in ("h", "node", "n")))
        finally:
            ngram_join.ROWS = before
        assert got == want
    assert len(want) < sum(len(own) for own in lists.values() if len(own) > 1)


def test_ngram_leaves_no_working_tables(spark, make_docs):
    """Lists, points, pairs and draws go as soon as no later step reads them."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:30] + [f"v{rng.randrange(10 ** 6)}"] + base[31:])) for i in range(40)]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("ngrams-*"))
    assert {r.component_id for r in ngram_join.near_copies(make_docs(rows)).collect()} == {0}
    left = {p.name.split("-", 1)[1] for d in set(shared.glob("ngrams-*")) - before for p in d.iterdir()}
    assert left and left <= {"sets", "groups", "edges"}


def test_ngram_groups_meet_by_their_closest_pairs(make_docs, monkeypatch):
    """Two large groups that leaders did not join: not each pair between them is verified."""
    star, verified, asked = ngram_join._star, ngram_join.verified, []

    def counted(work, pairs, *rest):
        asked.append(pairs.count())
        return verified(work, pairs, *rest)

    monkeypatch.setattr(ngram_join, "_star", lambda lists, *order: star(lists, *order).filter("(a < 0) = (b < 0)"))
    monkeypatch.setattr(ngram_join, "verified", counted)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:2 * i] + [f"x{i}"] + base[2 * i + 1:])) for i in range(80)]
    assert {r.component_id for r in ngram_join.near_copies(make_docs(rows)).collect()} == {0}
    assert sum(asked) < 1000, asked


@pytest.mark.parametrize("edges, rounds", [([(50, i) for i in range(100) if i != 50], 1), ([(5, 3), (3, 5), (5, 3), (3, -9), (7, 7)], 1), ([(i, i + 1) for i in range(12)], 9)])
def test_components_end_when_each_node_hangs_on_its_least(spark, monkeypatch, edges, rounds):
    """No round of shuffles runs to confirm the last one."""
    cut, cuts = common.Work.cut, []
    monkeypatch.setattr(common.Work, "cut", lambda *a: cuts.append(a[2]) or cut(*a))
    got = [tuple(r) for r in common.components(common.Work(spark, "stars"), spark.createDataFrame(edges, "a long, b long")).collect()]
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(got) == sorted((x, min(ends)) for x in ends if x != min(ends))
    assert len(cuts) <= rounds


def test_ngram_family_of_near_copies(make_docs):
    """A base of which hundreds of copies differ in a word or two, in long lists."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            t[rng.randrange(60)] = f"v{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(t)))
    _, comp = brute.near_copies(rows)
    assert {r.doc_id: r.component_id for r in ngram_join.near_copies(make_docs(rows)).collect()} == comp


def test_ngram_repeated_and_null_ids(make_docs):
    t = " ".join(f"a{i}" for i in range(20))
    out = ngram_join.near_copies(make_docs([(5, t), (5, t), (3, t + " b"), (None, t), (5, "other words here")]))
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in out.collect() if r.n_shingles > 1) == \
        [(False, 3, 3), (False, 5, 3), (False, 5, 3), (True, None, 3)]


def test_count_tree_bound_loses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(120)]
    points = np.stack([np.bincount((s >> np.uint64(56)).astype(int), minlength=256) for s in sets]).astype("<u2")
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(points, sizes, np.arange(len(sets)))
    got = {tuple(sorted(p)) for i, j in ngram_join.tree_join(tree, tree) for p in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 7 * both >= 3 * (len(sets[a]) + len(sets[b])):
                assert (b, a) in got


def test_suffix_dedup(docs, rows):
    want = brute.without_repeats(rows)
    got = {r.row.doc_id: (bytes(r.kept), [list(s) for s in r.spans]) for r in suffix_dedup.cut_repeats(docs).select("row", "kept", "spans").collect()}
    assert got == want


def test_suffix_dedup_split_of_frequent_anchors(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    got = {r.row.doc_id: bytes(r.kept) for r in suffix_dedup.cut_repeats(docs).select("row", "kept").collect()}
    assert got == {i: t for i, (t, _) in brute.without_repeats(rows).items()}


def test_suffix_dedup_batches_and_levels(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 7)
    got = {r.row.doc_id: bytes(r.kept) for r in suffix_dedup.cut_repeats(docs).select("row", "kept").collect()}
    assert got == {i: t for i, (t, _) in brute.without_repeats(rows).items()}


def test_suffix_repeated_rows_keep_their_text(make_docs):
    t = "".join(chr(97 + i % 23) + str(i) for i in range(80))
    out = suffix_dedup.cut_repeats(make_docs([(1, t), (1, t), (2, t), (None, "q" * 250)]))
    assert sorted((r.row.doc_id or 0, r.n_removed) for r in out.collect()) == [(0, 249), (1, 0), (1, 0), (2, len(t))]  # all but the first byte of the run of q


def test_line_dedup(docs, rows):
    got = {r.row.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute.without_lines(rows)


def test_line_dedup_counts_documents_not_lines(make_docs):
    rows = [(i, "same\nsame\nsame") for i in range(9)] + [(9, "other\n" * 12)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(make_docs(rows)).collect())
    rows.append((10, " SAME\t"))
    got = {r.row.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got[0] == (3, "") and got[10] == (1, "") and got[9][0] == 0


def test_rule_counts(docs, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
    assert got == {i: brute.counts(t) for i, t in rows}


def test_rules_reject_the_outlier(make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("river", "stone", "cloud", "meadow", "lantern", "a", "of")) + str(rng.randrange(9999)) for _ in range(120))) for i in range(150)]
    rows += [(1000, " ".join("###%%%" + str(rng.randrange(9999)) for _ in range(120))), (1001, "few words")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(make_docs(rows)).collect()}
    assert got[1000] == (False, False) and got[1001] == (True, False)
    assert all(got[i] == (False, True) for i in range(150))


def test_a_lone_row_past_the_base_rule_is_kept(make_docs):
    got = quality_rules.judge(make_docs([(1, "a b c " + " ".join(map(str, range(60)))), (2, None)])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (2, False)]


LIB = Tokenizer.from_file(bpe.vocabulary_path())
TEXTS = ["", "I'm sure we'll don't O'CLOCK 's 'S", "<|endoftext|>a<|startoftext|> b<|endoftext|", "Σίσυφος ΟΔΟΣ İ ﬁ ½ Ⅷ 日本 🙂👩‍👩 é",
         "a\x1cb\x85c d", "z" * 3000, "ab" * 500, "x.,;:!? y... (z)", "tab\tfeed\n\n 123 4567"]


def test_bpe_matches_the_library():
    enc, rng = bpe.Bpe(bpe.vocabulary_path(), cache_entries=50), random.Random(9)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x330), *range(0x2000, 0x2070), 0x130, 0xfb01, 0x1f642]]
    for t in TEXTS + ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(400)]:
        ids = LIB.encode(t, add_special_tokens=False).ids
        got = enc.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert enc.decode(got) == LIB.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_only_where_no_token_joins():
    enc = bpe.Bpe(bpe.vocabulary_path())
    for w in (b"hello", b"zxqj", "naïveté".encode(), b"a"):
        assert b"".join(enc.fragments(w))[:-1] == w


def test_bpe_documents(docs, rows):
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in bpe.encode_documents(docs).collect()}
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), np.array(ids, "<u4").tobytes())


def test_packing(docs, rows):
    out = packing.pack(docs).collect()
    ids = {i: LIB.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    per_doc, per_seq = {}, {}
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        per_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for s, n in sorted(per_doc[i]):
            assert s == at
            at += n
        assert at == len(x)
    for parts in per_seq.values():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at <= 2048


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 64) for _ in range(300)), reverse=True)
    seqs, offs = packing.best_fit_decreasing(sizes, 64)
    room = []
    for n, q, o in zip(sizes, seqs, offs):
        fit = [r for r in room if r >= n]
        if fit:
            assert 64 - o == min(fit)
            room.remove(min(fit))
        else:
            assert o == 0
        if 64 - o - n:
            room.append(64 - o - n)


def test_empty_tables(empty):
    assert ngram_join.near_copies(empty).count() == 0
    assert ngram_join.one_per_group(empty).columns == empty.columns
    assert suffix_dedup.without_repeats(empty).columns == empty.columns
    assert line_dedup.without_frequent_lines(empty).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert bpe.encode_documents(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_chunks_hold_whole_texts():
    import pyarrow as pa
    texts = ["", None, "é" * 700_000, "b", "c" * 2_000_000, "d"]
    for arr in (pa.array(texts), pa.array(["skip"] + texts)[1:]):
        got = [bytes(buf[off[k]:off[k + 1]]).decode() for _, _, buf, off in chunks(arr) for k in range(len(off) - 1)]
        assert got == [t or "" for t in texts]
    assert Powers().to(10)[0][1] * Powers().to(10)[1][1] == 1


def test_pipeline_stages_against_brute_force(spark, make_docs, rows):
    """Every stage but the classifier, each on what its predecessor kept."""
    docs = make_docs(rows, ("extra",))
    now = dict(rows)
    for (_, stage), step in zip(corpus_pipeline.STAGES[1:4], ("lines", "copies", "passages")):
        docs = stage(spark, docs, None)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        items = list(now.items())
        if step == "lines":
            now = {i: t for i, (t, _, _) in brute.without_lines(items).items()}
        elif step == "copies":
            comp = brute.near_copies(items)[1]
            now = {i: t for i, t in items if comp[i] == i}
        else:
            now = {i: t.decode("utf-8", "ignore") for i, (t, _) in brute.without_repeats(items).items()}
        got = {r.doc_id: r.text or "" for r in docs.collect()}
        assert got == {i: t or "" for i, t in now.items()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, docs, None).collect()} == set(now)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_words_and_lines_that_mirror_each_other_differ(make_docs, n):
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    near = {r.doc_id: r.component_id for r in ngram_join.near_copies(make_docs([(1, x), (2, y), (3, x)])).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    text = f"{x}\n{y}\n{x} {y}\n{y} {x}\n{x}"
    row, = quality_rules.judge(make_docs([(1, text)])).collect()
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words) == (7, 1, brute.counts(text)[4])
