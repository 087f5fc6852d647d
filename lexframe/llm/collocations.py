"""Phrase collocation mining with weighted acyclic automata.

A count transducer maps phrases to weights.  Its labels are words (with their
language), its states are stored once for all prefixes that continue alike.  A phrase
belongs to one of ``ranges`` ranges of its prefix (language and first two words), so
a frequent first word is spread over all of them.

1. Shards: a task reads about ``SHARD_BYTES`` of text at a time, sorts the phrases of 1
   to 3 words with their counts and builds one transducer per range from them.
2. Union: each range sums the weights of its shard transducers; phrases of
   ``MIN_COUNT`` occurrences stay and are the range's stored transducer.  (Each part of
   a phrase occurs as often as the phrase at least, so no part of a candidate goes.)
3. Part lookups: each range builds, for every other one, the transducer of the parts
   of its candidates that the other owns; its weights are the largest count of a candidate
   that holds the part.  The owner composes it with its counts, and sends back the
   transducer of the answers.  So a frequent word is asked for once per range, however
   many phrases hold it.
4. Each range scores its candidates in whole numbers and drops the dominated ones; the
   first ``top`` per language are a window whose partial limit comes before the shuffle.

The number of ranges follows the bytes of text (``RANGE_BYTES`` each), so what a task
holds does not grow with the corpus.

Defined results: null texts are empty and have no phrases; a null language is ``und``;
repeated rows count each; a very long text is read in parts that end between two
pieces; an empty table gives no rows; extra columns are not read.
"""
from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Work, lower, mix, read_table
from .registry import register

MIN_COUNT = 10
TOP = 2000
#: a longer candidate with this share (of 100) of a phrase's occurrences drops it
DOMINATED = 50
SCALE = 1_000_000
SHARD_BYTES = 8 << 20
RANGE_BYTES = 6 << 20
#: phrases that a union holds at a time
OPEN = 6_000_000
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
NONE = -1


# ---- the transducer ---------------------------------------------------------
def _order(*cols: np.ndarray) -> np.ndarray:
    """The order of rows of labels (``NONE`` first)."""
    bits = max((int(c.max()) + 2).bit_length() for c in cols) if len(cols[0]) else 1
    if bits * len(cols) > 63:
        return np.lexsort(cols[::-1])
    return np.argsort(_pack(bits, *cols))


def _pack(bits: int, *cols: np.ndarray) -> np.ndarray:
    key = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        key = (key << bits) | (c.astype(np.int64) + 1)
    return key


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Which sorted rows differ from the row before."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _shared(state: np.ndarray, n_states: int, *arcs: np.ndarray):
    """Store equal states once.  ``state`` (rising) is each arc's state; gives the place
    of each state among the stored ones, their first arcs and their arcs."""
    size = np.bincount(state, minlength=n_states)
    first = np.concatenate([[0], np.cumsum(size)])
    to, chosen = np.zeros(n_states, np.int64), []
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        if not length:
            stored, to[rows] = rows[:1], 0
        elif length <= 4:  # states of few arcs, side by side
            at = first[rows][:, None] + np.arange(length)
            cols = [a[at[:, k]] for k in range(length) for a in arcs]
            order = np.lexsort(cols)
            new = _starts(*(c[order] for c in cols))
            to[rows[order]] = np.cumsum(new) - 1
            stored = rows[order][new]
        else:
            seen: dict[bytes, int] = {}
            stored = []
            for r in rows.tolist():
                key = b"".join(a[first[r]:first[r + 1]].tobytes() for a in arcs)
                if key not in seen:
                    seen[key] = len(stored)
                    stored.append(r)
                to[r] = seen[key]
        to[rows] += sum(map(len, chosen))
        chosen.append(np.asarray(stored, np.int64))
    chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    arcs_at = _spans(first[chosen], size[chosen])
    return to, np.concatenate([[0], np.cumsum(size[chosen])]), [a[arcs_at] for a in arcs]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans ``[start, start + size)``."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Transducer:
    """Sorted ``symbols``; on each of three levels arcs ``(label, weight, next state)``
    and the first arc of each state.  Weight 0: no phrase ends there."""

    def __init__(self, symbols: pa.Array, levels: list):
        self.symbols, self.levels = symbols, levels

    @classmethod
    def build(cls, symbols: pa.Array, phrases: np.ndarray, weight: np.ndarray) -> Transducer:
        """From distinct sorted ``phrases`` (three labels each, ``NONE`` behind the last)."""
        w1, w2, w3 = phrases
        at1, at2 = _starts(w1), _starts(w1, w2)
        two, three = at2 & (w2 != NONE), w3 != NONE
        n1, n2 = int(at1.sum()), int(two.sum())
        node2 = np.cumsum(two) - 1
        to3, first3, (label3, weight3) = _shared(node2[three], n2, w3[three], weight[three])
        own2 = np.where(w3 == NONE, weight, 0)[two]  # a node's own phrase sorts before its longer ones
        to2, first2, (label2, weight2, next2) = _shared((np.cumsum(at1) - 1)[two], n1, w2[two], own2, to3)
        own1 = np.where(w2 == NONE, weight, 0)[at1]
        return cls(symbols, [(np.array([0, n1]), w1[at1], own1, to2), (first2, label2, weight2, next2), (first3, label3, weight3, None)])

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases in order, and their weights."""
        (_, l1, x1, n1), (f2, l2, x2, n2), (f3, l3, x3, _) = self.levels
        size2 = np.diff(f2)[n1] if len(n1) else np.zeros(0, np.int64)
        a2 = _spans(f2[n1], size2) if len(n1) else np.zeros(0, np.int64)
        top2 = np.repeat(np.arange(len(l1)), size2)
        t2 = n2[a2]
        size3 = np.diff(f3)[t2] if len(t2) else np.zeros(0, np.int64)
        a3 = _spans(f3[t2], size3) if len(t2) else np.zeros(0, np.int64)
        top3 = np.repeat(np.arange(len(a2)), size3)
        none1, none2 = np.full(len(l1), NONE), np.full(len(a2), NONE)
        cols = [np.concatenate([l1, l1[top2], l1[top2[top3]]]), np.concatenate([none1, l2[a2], l2[a2][top3]]),
                np.concatenate([none1, none2, l3[a3]])]
        weight = np.concatenate([x1, x2[a2], x3[a3]])
        keep = np.flatnonzero(weight)
        cols = [c[keep].astype(np.int64) for c in cols]
        order = _order(*cols)
        return np.stack([c[order] for c in cols]), weight[keep][order].astype(np.int64)

    def compose(self, other: Transducer) -> np.ndarray:
        """For each phrase of ``other``, in its order, the weight here (0: not there)."""
        asked, _ = other.phrases()
        here = pc.fill_null(pc.index_in(other.symbols, value_set=self.symbols), NONE - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        label = np.where(asked == NONE, NONE, here[asked])
        state, alive = np.zeros(asked.shape[1], np.int64), np.ones(asked.shape[1], bool)
        weight = np.zeros(asked.shape[1], np.int64)
        for k, (first, labels, weights, nxt) in enumerate(self.levels):
            if not len(labels):
                weight[alive & (label[k] != NONE)] = 0
                break
            go = alive & (label[k] != NONE)
            key = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 32 | labels.astype(np.int64)
            want = state[go] << 32 | np.maximum(label[k][go], 0)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = (key[at] == want) & (label[k][go] >= 0)
            weight[go] = np.where(hit, weights[at], 0)
            if nxt is not None:
                state[go] = nxt[at]
            rows = np.flatnonzero(go)
            alive = np.zeros(len(alive), bool)
            alive[rows[hit]] = True
        return weight

    def dump(self) -> bytes:
        small = [tuple(None if a is None else a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in level) for level in self.levels]
        return pickle.dumps((self.symbols.to_pylist(), small), 5)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        symbols, levels = pickle.loads(data)
        return cls(pa.array(symbols, pa.binary()), [tuple(None if a is None else a.astype(np.int64) for a in level) for level in levels])


def union(parts: list[Transducer]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Symbols, phrases and summed weights of the union, in order."""
    names = pa.chunked_array([t.symbols for t in parts], pa.binary()).combine_chunks()
    symbols, new = _ranked(names)
    ends = np.cumsum([0, *(len(t.symbols) for t in parts)])
    got = [t.phrases() for t in parts]
    cols = np.concatenate([np.where(p == NONE, NONE, np.append(new[a:b], NONE)[p]) for (p, _), a, b in zip(got, ends, ends[1:])], axis=1)
    weight = np.concatenate([w for _, w in got])
    return symbols, *_summed(cols, weight)


def _ranked(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct names in byte order, and each name's place among them."""
    coded = names.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)


def _summed(cols: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases in order with the sum of their weights (None: 1 each)."""
    if not cols.shape[1]:
        return cols, np.zeros(0, np.int64)
    bits = (int(cols.max()) + 2).bit_length()
    if weight is None and bits * len(cols) <= 63:
        key = np.sort(_pack(bits, *cols))
        at = np.flatnonzero(_starts(key))
        mask = (1 << bits) - 1
        return np.stack([(key[at] >> bits * k & mask) - 1 for k in (2, 1, 0)]), np.diff(at, append=len(key))
    order = _order(*cols)
    cols = cols[:, order]
    at = np.flatnonzero(_starts(*cols))
    return cols[:, at], np.diff(at, append=cols.shape[1]) if weight is None else np.add.reduceat(weight[order], at)


def _subset(symbols: pa.Array, phrases: np.ndarray, weight: np.ndarray) -> Transducer:
    """The transducer of some phrases in order, with the symbols that they use."""
    used = np.zeros(len(symbols) + 1, bool)
    used[phrases.ravel()] = True
    used[NONE] = False
    rank = np.append(np.cumsum(used[:-1]) - 1, NONE)
    return Transducer.build(symbols.filter(pa.array(used[:-1])), rank[phrases], weight)


def owner(symbols: pa.Array, phrases: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each phrase: by language and first two words."""
    h = np.append(np.array([xxhash.xxh3_64_intdigest(s) for s in symbols.to_pylist()], np.uint64), np.uint64(0))
    return (mix(h[phrases[0]] * np.uint64(3) + mix(h[phrases[1]])) >> np.uint64(11)).astype(np.int64) % ranges


def by_owner(symbols: pa.Array, phrases: np.ndarray, weight: np.ndarray, ranges: int):
    """``(range, transducer)`` of each range that owns some of the phrases."""
    rng = owner(symbols, phrases, ranges)
    order = np.argsort(rng, kind="stable")
    cut = np.flatnonzero(_starts(rng[order]))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        rows = order[a:b]
        yield int(rng[rows[0]]), _subset(symbols, phrases[:, rows], weight[rows])


# ---- shards -----------------------------------------------------------------
def _parts(text: bytes):
    """A text in parts of about ``SHARD_BYTES`` that end between two pieces."""
    while len(text) > SHARD_BYTES and (cut := _BREAKS.search(text, SHARD_BYTES)):
        yield text[:cut.end()]
        text = text[cut.end():]
    yield text


def shard_counts(texts: list[bytes], langs: list[str]):
    """Symbols ``lang TAB word``, phrases of 1 to 3 words in order, and their counts."""
    buf = lower(np.frombuffer(b"".join(texts), np.uint8))
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    solid, edge = ~_GAP[buf], np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1])) if len(buf) else np.zeros(0, np.int64)
    if not len(start):
        return pa.array([], pa.binary()), np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(solid, out=inside[1:])
    bounds = np.append(inside[start], inside[-1]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(buf[solid])]).dictionary_encode()
    text = np.searchsorted(off, start, "right") - 1
    lang = pa.array(langs, pa.string()).dictionary_encode()
    pair = lang.indices.to_numpy().astype(np.int64)[text] * len(words.dictionary) + words.indices.to_numpy()
    pairs, place = np.unique(pair, return_inverse=True)
    names = pc.binary_join_element_wise(lang.dictionary.cast(pa.binary()).take(pa.array(pairs // len(words.dictionary))),
                                        words.dictionary.take(pa.array(pairs % len(words.dictionary))), pa.scalar(b"\t", pa.binary()))
    symbols, rank = _ranked(names)
    w = rank[place]
    piece = np.cumsum(_BREAK[buf], dtype=np.int32)[start] + text  # rises from piece to piece
    next1 = np.append(piece[1:] == piece[:-1], False)
    next2 = next1 & np.append(next1[1:], False)
    i1, i2 = np.flatnonzero(next1), np.flatnonzero(next2)
    none = np.full(len(w), NONE)
    found = [_summed(np.stack(c), None) for c in ((w, none, none), (w[i1], w[i1 + 1], none[i1]), (w[i2], w[i2 + 1], w[i2 + 2]))]
    cols, n = np.concatenate([c for c, _ in found], axis=1), np.concatenate([x for _, x in found])
    order = _order(*cols)
    return symbols, cols[:, order], n[order]


def _shard_rows(ranges: int):
    def flush(texts, langs):
        return pa.RecordBatch.from_pylist([{"rng": r, "src": r, "kind": 0, "data": t.dump()}
                                           for r, t in by_owner(*shard_counts(texts, langs), ranges)], ROW)

    def run(batches):
        texts, langs, size = [], [], 0
        for b in batches:
            for text, lang in zip(b.column("text").cast(pa.binary()), b.column("lang")):
                for part in _parts(text.as_py() or b""):
                    texts.append(part)
                    langs.append(lang.as_py())
                    size += len(part)
                    if size >= SHARD_BYTES:
                        yield flush(texts, langs)
                        texts, langs, size = [], [], 0
        if texts:
            yield flush(texts, langs)
    return run


ROW = pa.schema([("rng", pa.int64()), ("src", pa.int64()), ("kind", pa.int64()), ("data", pa.binary())])
ROW_SQL = "rng long, src long, kind long, data binary"


def _by_range(batches):
    """``(range, rows)`` of rows sorted by range; ``rows`` must be read to its end."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("rng", "src", "kind")), (x.as_py() for x in b.column("data"))))
    row = next(rows, None)

    def group(rng):
        nonlocal row
        while row is not None and row[0] == rng:
            now, row = row, next(rows, None)
            yield now

    while row is not None:
        yield row[0], group(row[0])


# ---- ranges -----------------------------------------------------------------
def _union_rows(min_count: int):
    """Of the shard transducers of a range: the phrases with ``min_count`` occurrences
    (kind 0), and the words of each language counted here."""
    def run(batches):
        for rng, rows in _by_range(batches):
            parts, size, total = [], 0, None
            for *_, data in rows:
                parts.append(Transducer.load(data))
                size += len(parts[-1].levels[2][1]) + len(parts[-1].levels[1][1])
                if size > OPEN:
                    total = union([total, *parts] if total else parts)
                    total, parts, size = Transducer.build(*total), [], 0
            symbols, phrases, n = union([total, *parts] if total else parts)
            words = phrases[1] == NONE
            lang = pa.array([s[:s.rindex(b"\t")].decode() for s in symbols.take(pa.array(phrases[0][words])).to_pylist()], pa.string())
            sums = pa.table({"lang": lang, "n": pa.array(n[words])}).group_by("lang").aggregate([("n", "sum")])
            keep = n >= min_count
            data = _subset(symbols, phrases[:, keep], n[keep]).dump()
            yield pa.RecordBatch.from_pylist(
                [{"rng": rng, "data": data, "lang": None, "n": None}] +
                [{"rng": rng, "data": None, "lang": r["lang"], "n": r["n_sum"]} for r in sums.to_pylist()],
                pa.schema([("rng", pa.int64()), ("data", pa.binary()), ("lang", pa.string()), ("n", pa.int64())]))
    return run


def cuts_of(phrases: np.ndarray):
    """``(candidates, k, first parts, rest)`` for each number of words and each cut."""
    w1, w2, w3 = phrases
    none = np.full(len(w1), NONE)
    two, three = (w2 != NONE) & (w3 == NONE), w3 != NONE
    for rows, k, first, rest in ((two, 1, (w1, none, none), (w2, none, none)), (three, 1, (w1, none, none), (w2, w3, none)),
                                 (three, 2, (w1, w2, none), (w3, none, none))):
        yield np.flatnonzero(rows), k, np.stack(first)[:, rows], np.stack(rest)[:, rows]


def _ask_rows(ranges: int):
    """The stored transducer of each range and, per owner, that of the parts its
    candidates need; the weight is one more than the largest count of a phrase of
    three words that asks."""
    def run(batches):
        for rng, rows in _by_range(batches):
            for *_, data in rows:
                t = Transducer.load(data)
                phrases, n = t.phrases()
                parts, weight = [], []
                for at, _, first, rest in cuts_of(phrases):
                    for part in (first, rest):
                        parts.append(part)
                        weight.append(np.where(phrases[2][at] != NONE, n[at], 0) + 1)
                cols, weight = np.concatenate(parts, axis=1), np.concatenate(weight)
                out = [{"rng": rng, "src": rng, "kind": 0, "data": data}]
                if len(weight):
                    order = _order(*cols)
                    cols = cols[:, order]
                    at = np.flatnonzero(_starts(*cols))
                    asked = cols[:, at], np.maximum.reduceat(weight[order], at)
                    out += [{"rng": r, "src": rng, "kind": 1, "data": q.dump()} for r, q in by_owner(t.symbols, *asked, ranges)]
                for lo in range(0, len(out), BATCH_ROWS):
                    yield pa.RecordBatch.from_pylist(out[lo:lo + BATCH_ROWS], ROW)
    return run


def _answer_rows(batches):
    """For each asking range its parts with their counts (kind 1), and for the owner
    its phrases that a longer candidate dominates (kind 2)."""
    for rng, rows in _by_range(batches):
        own = None
        for _, src, kind, data in rows:
            if kind == 0:
                own = Transducer.load(data)
                continue
            asked = Transducer.load(data)
            count = own.compose(asked)
            phrases, longest = asked.phrases()
            out = [{"rng": src, "src": rng, "kind": 1, "data": Transducer.build(asked.symbols, phrases, count).dump()}]
            gone = (phrases[1] != NONE) & (100 * (longest - 1) >= DOMINATED * count)
            if gone.any():
                out.append({"rng": rng, "src": src, "kind": 2, "data": _subset(asked.symbols, phrases[:, gone], count[gone]).dump()})
            yield pa.RecordBatch.from_pylist(out, ROW)


SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])


def _score_rows(batches):
    for _, rows in _by_range(batches):
        own, answers, gone = None, [], []
        for _, _, kind, data in rows:
            if kind == 0:
                own = Transducer.load(data)
            else:
                (answers if kind == 1 else gone).append(Transducer.load(data))
        phrases, n = own.phrases()
        if not answers:
            continue
        known = Transducer.build(*union(answers))
        drop = Transducer.build(*union(gone)).compose(own) > 0 if gone else np.zeros(len(n), bool)
        words = [s[s.rindex(b"\t") + 1:].decode() for s in own.symbols.to_pylist()]
        langs = [s[:s.rindex(b"\t")].decode() for s in own.symbols.to_pylist()]
        best: dict[int, tuple] = {}
        for at, k, first, rest in cuts_of(phrases):
            l, r = (_weights(known, own.symbols, p) for p in (first, rest))
            for i, x, y in zip(at.tolist(), l.tolist(), r.tolist()):
                if not drop[i]:
                    a = int(n[i])
                    cut = (SCALE * a * a // (x * y), k, a, x, y)
                    if i not in best or cut < best[i]:
                        best[i] = cut
        out = []
        for i, (score, _, a, l, r) in best.items():
            labels = [w for w in phrases[:, i].tolist() if w != NONE]
            out.append({"lang": langs[labels[0]], "phrase": " ".join(words[w] for w in labels), "a": a, "l": l, "r": r, "score": score})
        yield pa.RecordBatch.from_pylist(out, SCORED)


def _weights(t: Transducer, symbols: pa.Array, phrases: np.ndarray) -> np.ndarray:
    """The weight in ``t`` of each of ``phrases``, which may repeat."""
    if not phrases.shape[1]:
        return np.zeros(0, np.int64)
    order = _order(*phrases)
    new = _starts(*phrases[:, order])
    at = np.flatnonzero(new)
    distinct = phrases[:, order][:, at]
    out = np.empty(phrases.shape[1], np.int64)
    out[order] = t.compose(Transducer.build(symbols, distinct, np.ones(len(at), np.int64)))[np.cumsum(new) - 1]
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("rng")).sortWithinPartitions("rng", "kind", "src")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``docs(text, lang)``."""
    work = Work(docs.sparkSession, "phrases")
    text = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    shards = text.mapInArrow(_shard_rows(ranges), ROW_SQL)
    kept = work.cut(_dealt(shards).mapInArrow(_union_rows(min_count), "rng long, data binary, lang string, n long"), "ranges")
    own = kept.filter("data IS NOT NULL").select("rng", F.col("rng").alias("src"), F.lit(0).cast("long").alias("kind"), "data")
    asked = work.cut(_dealt(own).mapInArrow(_ask_rows(ranges), ROW_SQL), "parts")
    answers = work.cut(_dealt(asked).mapInArrow(_answer_rows, ROW_SQL), "answers")
    scored = _dealt(own.unionByName(answers)).mapInArrow(_score_rows, "lang string, phrase string, a long, l long, r long, score long")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= top)
    words = kept.filter("data IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
     g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM p
           UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM p WHERE len(w) > 1
           UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM p WHERE len(w) > 2),
     f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
     n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
     c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
     k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest FROM c, generate_series(1, 2) t(k) WHERE k < m),
     s AS (SELECT k.lang, k.phrase, k.k, k.a, l.a AS l, r.a AS r, (1000000 * k.a * k.a) // (l.a * r.a) AS score
           FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.first JOIN f r ON r.lang = k.lang AND r.phrase = k.rest),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, a, array_to_string(w[1:2], ' ') AS x, array_to_string(w[2:3], ' ') AS y FROM c WHERE m = 3) t
           ON t.lang = c.lang AND c.m = 2 AND c.phrase IN (t.x, t.y) AND 100 * t.a >= 50 * c.a),
     o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT o.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op13_collocations", SQL)
def op13_collocations(spark, sf_dir):
    return collocations(read_table(spark, sf_dir, "documents"))
