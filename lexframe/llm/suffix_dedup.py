"""Suffix-array dedup with a logarithmic index family.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
smaller document, or earlier in the same one.

1. Each window of ``LENGTH`` bytes is filed under its anchor, the ``GRAM``-byte gram
   of least hash in it, so equal windows share the anchor and its place in them.
   Runs of windows with one anchor are one row: the sparse suffixes of the corpus.
2. Anchors seen once cannot match.  A fixed-size bitmap, filled from the counts of
   all anchors, drops most of them; what it lets through by chance only costs time.
3. Rows are dealt to shards by their anchor and read in the order of documents.  A
   shard takes them in batches of ``BATCH`` rows.  A batch gets its suffix array (its
   windows, ordered by a fingerprint of their ``LENGTH`` bytes, the earliest of each),
   is merge-scanned against every level of the shard's index, and what is new
   becomes a level; levels of like size merge, so there are logarithmically many.
4. The spans found are joined to the documents and their union is cut out.

An anchor that stands in ``HOT`` places or more is split: each task resolves the rows
that repeat an earlier one of its own, so that a passage in a third of all documents
leaves a row per task, and its windows go to shards by their place in steps of 8.

Defined results: null texts are empty; texts under ``LENGTH`` bytes lose nothing; rows
with equal ``doc_id`` and text are one document, with equal ``doc_id`` and other texts
they come in the order of a hash of the text; a null id is the smallest; extra
columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Powers, Work, chunks, mix, prefix_hash, read_table, span_hash, with_text
from .registry import register

LENGTH = 100
GRAM = 32
MAP_BITS = 24
HOT = 2000
HOT_STEP = 8
HOT_ROWS = 200_000
BATCH = 20_000
LEAST_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def anchors(buf: np.ndarray, off: np.ndarray, powers: Powers, length: int = LENGTH):
    """``(text number, first window, last window, anchor place, anchor hash)`` of each
    run of windows; places count from the start of ``buf``."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64)
    prefix = prefix_hash(buf, powers)
    at = np.arange(len(buf) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM, powers)
    # hash and place in one number: the least is the leftmost of the least hashes
    low = np.uint64(28)
    best = _sliding_min((gram >> low << low) | at.astype(np.uint64), length - GRAM + 1)
    start = np.arange(len(best))
    text = np.searchsorted(off, start, "right") - 1
    ok = start + length <= off[text + 1]
    start, text = start[ok], text[ok]
    place = (best[start] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else none
    return text[first], start[first], start[last], place[first], gram[place[first]]


def _key_rows(length: int):
    def run(batches):
        powers = Powers()
        for b in batches:
            for _, _, buf, off in chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(buf, off, powers, length)[4].astype(np.int64))], names=["key"])
    return run


_ROWS = "shard long, key long, id long, th long, start long, windows int, bytes binary"


def _suffix_rows(shared: Bitmap, hot: Bitmap, length: int):
    """One row for each run of windows whose anchor may be shared; ``bytes`` is null in
    rows that are known to repeat an earlier one."""
    def run(batches):
        powers, seen = Powers(), {}
        for b in batches:
            ids, ths = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for lo, _, buf, off in chunks(b.column("text")):
                text, first, last, place, key = anchors(buf, off, powers, length)
                keep = shared(key)
                text, first, last, place, key = (x[keep] for x in (text, first, last, place, key))
                often = hot(key)
                if often.any():  # cut runs of frequent anchors at multiples of HOT_STEP of the anchor's place
                    step = np.where(often, HOT_STEP, 1 << 30)
                    a, z = (place - last) // step, (place - first) // step
                    n = z - a + 1
                    row = np.repeat(np.arange(len(n)), n)
                    part = a[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    text, place, key, often = text[row], place[row], key[row], often[row]
                    s = step[row]
                    first, last = np.maximum(first[row], place - (part + 1) * s + 1), np.minimum(last[row], place - part * s)
                    shard = np.where(often, mix(key + part.astype(np.uint64)), key)
                else:
                    shard = key
                data = buf.tobytes()
                body: list = [data[i:j + length] for i, j in zip(first.tolist(), last.tolist())]
                doc, th, begin = ids[lo + text], ths[lo + text], first - off[text]
                for i in np.flatnonzero(often):
                    mine = (int(doc[i]), int(th[i]), int(begin[i]))
                    seg = (int(place[i] - first[i]), body[i])
                    before = seen.get(seg)
                    if before is None or mine < before:
                        if len(seen) >= HOT_ROWS:
                            seen.clear()
                        seen[seg] = mine
                    elif mine > before:  # settled, so any shard will do
                        body[i], shard[i] = None, mix(np.array([mine[1] ^ mine[2]], np.int64).astype(np.uint64))[0]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(doc), pa.array(th), pa.array(begin),
                    pa.array((last - first + 1).astype(np.int32)), pa.array(body, pa.binary())],
                    names=["shard", "key", "id", "th", "start", "windows", "bytes"])
    return run


class Levels:
    """Sorted levels of window fingerprints, each with the anchors beside them."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, print_: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which of the sorted fingerprints some level holds under the same anchor."""
        hit = np.zeros(len(print_), bool)
        for p, k in self.levels:
            at = np.minimum(np.searchsorted(p, print_), len(p) - 1)
            hit |= (p[at] == print_) & (k[at] == key)
        return hit

    def add(self, print_: np.ndarray, key: np.ndarray) -> None:
        if len(print_):
            self.levels.append((print_, key))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (p, k), (q, m) = self.levels.pop(), self.levels.pop()
            p, k = np.concatenate([q, p]), np.concatenate([m, k])
            order = np.argsort(p, kind="stable")
            self.levels.append((p[order], k[order]))


def _span_rows(length: int):
    """Spans of repeated windows of rows sorted by document and place."""
    def one(t: pa.Table, index: Levels, powers: Powers):
        key, doc, th, start, windows = (t.column(c).to_numpy() for c in ("key", "id", "th", "start", "windows"))
        body = t.column("bytes").combine_chunks()
        buf, off = np.frombuffer(b"".join(body.to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(windows + length - 1)])
        row = np.repeat(np.arange(len(key)), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = off[row] + place
        print_ = span_hash(prefix_hash(buf, powers), at, at + length, powers)
        # the suffix array of the batch: by fingerprint, the earliest first
        order = np.argsort(print_, kind="stable")
        p, k = print_[order], key[row[order]].astype(np.uint64)
        lead = np.ones(len(p), bool)
        lead[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        known = index.scan(p[lead], k[lead])
        group = np.cumsum(lead) - 1
        again = np.zeros(len(p), bool)
        again[order] = ~lead | known[group]
        index.add(p[lead][~known], k[lead][~known])
        edge = np.ones(len(again) + 1, bool)
        edge[1:-1] = (again[1:] != again[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(edge)
        lo, hi = cut[:-1][again[cut[:-1]]], cut[1:][again[cut[:-1]]] - 1
        return doc[row[lo]], th[row[lo]], start[row[lo]] + place[lo], start[row[hi]] + place[hi] + length

    def run(batches):
        index, powers, held, rows, last = Levels(), Powers(), [], 0, None

        def flush():
            t = pa.Table.from_batches(held)
            cols = one(t, index, powers)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["id", "th", "s", "e"])

        for b in batches:
            if not b.num_rows:
                continue
            sure = b.filter(b.column("bytes").is_null())
            if sure.num_rows:
                s = sure.column("start").to_numpy()
                yield pa.RecordBatch.from_arrays([sure.column("id"), sure.column("th"), pa.array(s),
                                                  pa.array(s + sure.column("windows").to_numpy() + length - 1)], names=["id", "th", "s", "e"])
            b = b.filter(b.column("bytes").is_valid())
            # rows that repeat a document's own row (the same id, text and place)
            ids = np.stack([b.column(c).to_numpy() for c in ("id", "th", "start", "key")]) if b.num_rows else np.zeros((4, 0), np.int64)
            new = np.ones(b.num_rows, bool)
            if b.num_rows:
                new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
                new[0] = last is None or (ids[:, 0] != last).any()
                last = ids[:, -1]
                held.append(b.filter(pa.array(new)))
                rows += held[-1].num_rows
            if rows >= BATCH:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def cut_spans(text: str | None, found) -> tuple[bytes, list[list[int]], int]:
    """The bytes left of a text without its spans, their union's runs, and the text's length."""
    data, runs = (text or "").encode(), []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return b"".join(kept) + data[at:], runs, len(data)


def _cut_rows(batches):
    """``row`` with what is left of its text."""
    for b in batches:
        got = [cut_spans(t.as_py(), f.as_py()) for t, f in zip(b.column("text"), b.column("found"))]
        yield pa.RecordBatch.from_arrays([
            b.column("row"), pa.array([x[2] for x in got], pa.int64()), pa.array([x[2] - len(x[0]) for x in got], pa.int64()),
            pa.array([x[1] for x in got], pa.list_(pa.list_(pa.int64()))), pa.array([x[0] for x in got], pa.binary()),
            pa.array([x[0].decode("utf-8", "ignore") for x in got], pa.string())],
            names=["row", "n_bytes", "n_removed", "spans", "kept", "kept_text"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(id, th, found)``: the spans ``(s, e)`` that rows of ``docs(doc_id, text)``
    lose, by id (null: ``LEAST_ID``) and hash of the text."""
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    work = Work(docs.sparkSession, "suffixes")
    often = work.cut(text.select("text").mapInArrow(_key_rows(length), "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    shared, hot = Bitmap(often, "key", MAP_BITS), Bitmap(often.filter(F.col("n") >= HOT), "key", MAP_BITS)
    work.drop(often)
    rows = text.mapInArrow(_suffix_rows(shared, hot, length), _ROWS)
    spans = rows.repartition(F.col("shard")).sortWithinPartitions("id", "th", "start", "key").mapInArrow(_span_rows(length), "id long, th long, s long, e long")
    return work.cut(spans.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("found")), "spans")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row`` (all columns of ``docs`` but ``text``), ``n_bytes``, ``n_removed``, the runs
    ``spans``, the bytes ``kept`` and ``kept_text`` (these without the characters that a
    cut splits) of every row."""
    found = repeated_spans(docs, length)
    row = F.struct("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text")))
    d = docs.select(row.alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64("text").alias("th"))
    d = d.join(found, ["id", "th"], "left").select("row", "text", "found")
    kind = d.schema["row"].dataType.simpleString()
    return d.mapInArrow(_cut_rows, f"row {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_text string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what is left as text."""
    return with_text(cut_repeats(docs, length), docs.columns, "kept_text")


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    out = cut_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
