"""Exact dedup, fill-in-middle and collocations against plain Python, with the edge cases."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexframe.llm import collocations as co
from lexframe.llm import exact_dedup, fill_middle
from tests.llm.brute import LOW

WS = re.compile(r"[\x20\x09-\x0D]")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# ---- exact dedup --------------------------------------------------------------
def copies(rows):
    """``{(id, text): [(keep_id, group size, kept), ...]}``"""
    groups = defaultdict(list)
    for i, t in rows:
        groups[WS.sub("", t or "")].append((i, t))
    out = defaultdict(list)
    for members in groups.values():
        most = max(len(t or "") for _, t in members)
        keep = min((i is None, i or 0) for i, t in members if len(t or "") == most)
        keep = None if keep[0] else keep[1]
        for i, t in members:
            out[i, t].append((keep, len(members), i == keep and len(t or "") == most))
    return out


COPIES = [(1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, "a\tb \x0bc"), (5, None), (6, ""), (7, " \n"), (8, "abd"), (9, "a b c é"),
          (10, "abcé"), (11, "x" * 3_000_000), (12, "x" * 2_999_999 + " x"), (None, "a  b  c"), (None, "lone"), (13, "y" * 500 + "1"),
          (14, "y" * 500 + "2"), (15, "y" * 500 + " 2"), (16, "a b")]


def test_exact_copies(make_docs):
    got = exact_dedup.exact_copies(make_docs(COPIES, extra=("keep_id", "full", "rid", "size")), digests=True).collect()
    want = copies(COPIES)
    text = {i: t for i, t in COPIES if i is not None}
    assert len(got) == len(COPIES)
    for r in got:
        options = want[r.doc_id, text[r.doc_id]] if r.doc_id is not None else [*want[None, "a  b  c"], *want[None, "lone"]]
        assert (r.keep_id, r.group_size, r.kept) in options
        if r.doc_id is not None:
            assert r.full == hashlib.sha256(WS.sub("", text[r.doc_id] or "").encode()).hexdigest()


def test_exact_copies_hash_only_what_is_open(make_docs):
    full = {r.doc_id: r.full for r in exact_dedup.exact_copies(make_docs([(1, "one"), (2, "other"), (3, "thing"), (4, "thi ng")])).collect()}
    assert full[1] is None and full[2] is None and full[3] == full[4] == hashlib.sha256(b"thing").hexdigest()


def test_exact_copies_repeated_rows(make_docs):
    rows = [(1, "same text"), (1, "same text"), (2, "same text"), (3, "other")] + [(4, "sametext")] * 3
    got = exact_dedup.exact_copies(make_docs(rows)).collect()
    assert [r.group_size for r in got if r.doc_id != 3] == [6] * 6
    assert sum(r.kept for r in got if r.doc_id != 3) == 1 and {r.keep_id for r in got if r.doc_id != 3} == {1}


def test_one_per_text(make_docs):
    out = exact_dedup.one_per_text(make_docs(COPIES + [(3, "a  b  c")], extra=("row", "th")))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "th"]
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 3, 7, 8, 9, 12, 13, 15, 16]


def test_exact_copies_empty_table(make_docs):
    assert exact_dedup.exact_copies(make_docs([])).count() == 0
    assert exact_dedup.one_per_text(make_docs([])).count() == 0


def test_large_group_and_full_bitmap(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 6)
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 6)
    rows = [(i, " ".join("hot")) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(400)] + [(2000 + i, f"tex t{i}") for i in range(0, 400, 3)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_copies(make_docs(rows)).collect()}
    want = copies(rows)
    assert got == {i: want[i, t][0] for i, t in rows}


# ---- fill in the middle -------------------------------------------------------
def middle(i, t):
    t = t or ""
    n = TOKEN.findall(t)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    x, y = sorted((h[0] % (len(n) + 1), h[1] % (len(n) + 1)))
    p, m, s = "".join(n[:x]), "".join(n[x:y]), "".join(n[y:])
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(n), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(n), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(n), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "one", " one", "one ", "é ü  ß\n", "<P>", "a <S> b", "a <M", "< P>", "<", "P> x <", "a b c d e f g", "\n\n\n", "x" * 2_000_000,
         "word " * 300_000, "日本 語 テキスト 🦀 end\r\n", "<X> <<P <S", "\x0b\x0ca\x1cb"]


def test_fill_in_middle(make_docs):
    rows = [(k * 100 + j, t) for j, t in enumerate(TEXTS) for k in range(1, 9)] + [(None, "null id here"), (7, "twice a b"), (7, "twice a b")]
    out = fill_middle.restored(fill_middle.fill_in_middle(make_docs(rows, extra=("output", "form", "h0", "n"))))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect()]
    want = [(i, *middle(i, t), t or "") for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_empty_table(make_docs):
    assert fill_middle.restored(fill_middle.fill_in_middle(make_docs([]))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab<PSM> \n\té日", max_size=12), max_size=6), st.integers(0, 2**32))
def test_scatter_and_gather(texts, seed):
    coded = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(coded), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    draws = np.random.default_rng(seed).integers(0, 2**32, (len(texts), 4))
    out, out_off, (n, form, a, b) = fill_middle.transform(buf, off, draws, rate=90)
    for k, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        assert n[k] == len(tokens)
        x, y = sorted(draws[k, :2] % (len(tokens) + 1))
        p, m, s = ("".join(v).encode() for v in (tokens[:x], tokens[x:y], tokens[y:]))
        made = out[out_off[k]:out_off[k + 1]].tobytes()
        assert made == [t.encode(), b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][form[k]]
    back, back_off = fill_middle.restore(out, out_off, form)
    assert back.tobytes() == buf.tobytes() and back_off.tolist() == off.tolist()


# ---- collocations -------------------------------------------------------------
PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def phrases_of(rows, min_count, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECES.split((text or "").translate(LOW)):
            w = WORD.findall(piece)
            total[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= min_count}
    out = defaultdict(list)
    for (lang, *w), a in cand.items():
        if any(g[0] == lang and len(g) == 4 and len(w) == 2 and tuple(w) in (g[1:3], g[2:4]) and 100 * b >= 50 * a for g, b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def some_texts(seed, n=120):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "a", "é", "日", "new", "york", "city", "x\x01", "x", "<b>", "état", "a b"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", " ", "\r\n", "!", "\x0b"]
    return [("".join(rnd.choice(vocab[:rnd.randrange(3, 15)]) + rnd.choice(ends) for _ in range(rnd.randrange(60))), rnd.choice(["en", "fr", None, "und", "a\tb", ""]))
            for _ in range(n)]


def lang_docs(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in extra))


@pytest.mark.parametrize("seed,min_count,top", [(1, 3, 2000), (2, 10, 2000), (3, 2, 7)])
def test_collocations(spark, monkeypatch, seed, min_count, top):
    monkeypatch.setattr(co, "SHARD_BYTES", 300)
    monkeypatch.setattr(co, "RANGE_BYTES", 900)
    rows = some_texts(seed) + [(None, "en"), ("", "en"), (None, None)]
    got = [tuple(r) for r in co.collocations(lang_docs(spark, rows, ("rank", "phrase", "n", "rng", "data")), min_count, top).collect()]
    want = phrases_of(rows, min_count, top)
    assert len(want) > 5 and sorted(got) == want


def test_collocations_repeats_and_overlaps(spark):
    rows = [("b b b b b b b b b b b b", "en")] + [("new york city", "en")] * 10 + [("york", "en")] * 5
    got = [tuple(r) for r in co.collocations(lang_docs(spark, rows)).collect()]
    assert sorted(got) == phrases_of(rows, 10, 2000)
    assert {g[2]: g[3] for g in got} == {"new york city": 10, "b b b": 10}


def test_collocations_empty(spark):
    for rows in ([], [(None, None)], [(" . ", "en")], [("one", "en")]):
        assert co.collocations(lang_docs(spark, rows)).count() == 0


def test_long_text_is_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", 1000)
    text = "to be or not to be, that is the question. " * 300
    rows = [(text, "en"), ("word " * 2000, "en")]
    assert b"".join(co._parts(text.encode())) == text.encode() and len(list(co._parts(text.encode()))) > 5
    assert sorted(tuple(r) for r in co.collocations(lang_docs(spark, rows)).collect()) == phrases_of(rows, 10, 2000)


def transducer(counts):
    names = sorted({w for p in counts for w in p})
    rows = sorted([names.index(w) for w in p] + [co.NONE] * (3 - len(p)) for p in counts)
    weight = [counts[tuple(names[w] for w in r if w != co.NONE)] for r in rows]
    return co.Transducer.build(pa.array(names, pa.binary()), np.array(rows, np.int64).reshape(-1, 3).T, np.array(weight, np.int64))


def weights(symbols, phrases, n):
    return {tuple(symbols[w].as_py() for w in p if w != co.NONE): c for p, c in zip(phrases.T.tolist(), n.tolist())}


COUNTS = st.dictionaries(st.lists(st.sampled_from([b"a", b"ab", b"b", "é".encode()]), min_size=1, max_size=3).map(tuple), st.integers(1, 3), max_size=40)


@settings(max_examples=150, deadline=None)
@given(COUNTS, COUNTS, COUNTS)
def test_transducer(x, y, z):
    s, t, u = map(transducer, (x, y, z))
    assert weights(s.symbols, *s.phrases()) == x
    again = co.Transducer.load(s.dump())
    assert weights(again.symbols, *again.phrases()) == x
    assert weights(*co.union([s, t, u])) == Counter(x) + Counter(y) + Counter(z)
    asked, _ = t.phrases()
    assert dict(zip(weights(t.symbols, *t.phrases()), s.compose(t).tolist())) == {p: x.get(p, 0) for p in weights(t.symbols, *t.phrases())}
    assert asked.shape[1] == len(y)


def test_transducer_stores_equal_states_once():
    t = transducer({(a, b, c): 1 for a in (b"p", b"q", b"r") for b in (b"x", b"y") for c in (b"1", b"2")})
    assert [len(level[1]) for level in t.levels] == [3, 2, 2]


# ---- packing ------------------------------------------------------------------
def test_packing_of_repeated_rows_and_null_ids(make_docs):
    from lexframe.llm import packing
    rows = [(1, "a few words")] * 30 + [(None, "no id")] * 3 + [(None, None), (2, "word " * 5000), (2, "word " * 5000)]
    out = packing.pack(make_docs(rows, extra=("rid", "shard", "length"))).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 30 * next(r.doc_tokens for r in out if r.doc_id == 1)
    assert sum(r.start == 0 for r in out) == len(rows) and sum(r.length == 2048 for r in out) == 4
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 2048
