"""Fill-in-middle transformation by displacement scatter.

A text is cut at token bounds into prefix, middle and suffix, which are put in
another order behind marks.  A whole Arrow batch is one byte array.  One scan finds
the tokens, marks and cuts of all its texts; each segment moves by one distance, so
the distances are written as differences at the starts of the segments, their running
sum is the shift of every byte, and one numpy scatter builds all outputs.  ``restored``
scans outputs for the marks, builds the shifts of the way back in the same manner and
gathers the bytes.

Defined results: a null text is empty; empty texts and texts that hold a mark stay
plain; the draws depend on ``seed`` and ``doc_id`` alone (a null id draws as an empty
one), so repeated rows get equal outputs; texts may have any length; an empty table
gives no rows; extra columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_WS, chunks, read_table, words
from .registry import register

SEED = 42
#: of 100 texts that many are transformed, of 100 of these that many suffix first
RATE, SUFFIX_FIRST = 50, 80
PLAIN, PSM, SPM = range(3)
FORMS = ["plain", "psm", "spm"]
MARK = 3  # bytes of a mark
_MARKS = np.frombuffer(b"<P><S><M>", np.uint8).reshape(3, MARK)
P, S, M = range(3)
_LETTER = np.full(256, -1, np.int8)
_LETTER[[ord("P"), ord("S"), ord("M")]] = [P, S, M]
#: the order of prefix, suffix and middle by form
_ORDER = {PSM: (P, S, M), SPM: (S, P, M)}


def marks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and text number of each ``<P>``, ``<S>`` and ``<M>`` inside one text."""
    at = np.flatnonzero((buf[:-2] == ord("<")) & (buf[2:] == ord(">")) & (_LETTER[buf[1:-1]] >= 0)) if len(buf) >= MARK else np.zeros(0, np.int64)
    text = np.searchsorted(off, at, "right") - 1
    inside = at + MARK <= off[text + 1]
    return at[inside], text[inside]


def token_bounds(buf: np.ndarray, off: np.ndarray):
    """Ends of the tokens of all texts, and the first token of each text (one more
    entry than texts).  A token is a word with the white space before it; white space
    at a text's end is one more."""
    _, end, first = words(buf, off)
    last = np.where(first[1:] > first[:-1], end[np.maximum(first[1:] - 1, 0)] if len(end) else 0, off[:-1])
    tail = np.flatnonzero(last < off[1:])
    ends = np.insert(end, first[1:][tail], off[1:][tail])
    extra = np.zeros(len(off), np.int64)
    extra[1:][tail] = 1
    return ends, first + np.cumsum(extra)


def shifts(start: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """The shift of each of ``size`` bytes, for segments in their order."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start, np.diff(shift, prepend=0))
    return np.cumsum(step[:-1])


def transform(buf: np.ndarray, off: np.ndarray, draws: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """Outputs of the texts as ``(bytes, offsets)``, and ``(tokens, form, prefix end,
    middle end)`` of each; ``draws`` holds four whole numbers per text."""
    n_texts = len(off) - 1
    ends, first = token_bounds(buf, off)
    n = np.diff(first)
    form = np.where(draws[:, 2] % 100 >= rate, PLAIN, np.where(draws[:, 3] % 100 < suffix_first, SPM, PSM))
    form[n == 0] = PLAIN
    form[marks(buf, off)[1]] = PLAIN
    units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    cuts = [np.where(u > 0, ends[np.maximum(first[:-1] + u - 1, 0)] if len(ends) else 0, off[:-1]) for u in units.T]
    a, b, o, e = cuts[0], cuts[1], off[:-1], off[1:]
    out_off = off + MARK * 3 * np.concatenate([[0], np.cumsum(form != PLAIN)])
    size = np.stack([a - o, e - b, b - a])  # of prefix, suffix, middle
    to, mark_at = np.empty((3, n_texts), np.int64), np.empty((3, n_texts), np.int64)
    to[P], to[M], to[S] = out_off[:-1], out_off[:-1] + a - o, out_off[:-1] + b - o
    for kind, order in _ORDER.items():
        t = form == kind
        at = out_off[:-1][t]
        for part in order:
            mark_at[part, t] = at
            to[part, t] = at + MARK
            at = at + MARK + size[part, t]
    segment = np.stack([o, a, b], axis=1).ravel()
    shift = np.stack([to[P] - o, to[M] - a, to[S] - b], axis=1).ravel()
    out = np.empty(out_off[-1], np.uint8)
    out[np.arange(len(buf)) + shifts(segment, shift, len(buf))] = buf
    moved = form != PLAIN
    for part in (P, S, M):
        out[mark_at[part, moved][:, None] + np.arange(MARK)] = _MARKS[part]
    return out, out_off, (n, form, a, b)


def restore(out: np.ndarray, off: np.ndarray, form: np.ndarray):
    """``(bytes, offsets)`` of the texts, from outputs and forms alone."""
    at, text = marks(out, off)
    at = at[form[text] != PLAIN].reshape(-1, 3)  # an output that is not plain holds each mark once
    moved = form != PLAIN
    text_off = off - MARK * 3 * np.concatenate([[0], np.cumsum(moved)])
    start, size = np.empty((3, len(form)), np.int64), np.zeros((3, len(form)), np.int64)
    start[P], size[P], start[M], start[S] = off[:-1], np.diff(off), off[1:], off[1:]
    end = np.concatenate([at[:, 1:], off[1:][moved][:, None]], axis=1)
    for kind, order in _ORDER.items():
        t, rows = form == kind, form[moved] == kind
        for k, part in enumerate(order):
            start[part, t] = at[rows, k] + MARK
            size[part, t] = end[rows, k] - at[rows, k] - MARK
    begin = np.stack([text_off[:-1], text_off[:-1] + size[P], text_off[:-1] + size[P] + size[M]], axis=1).ravel()
    shift = np.stack([start[P], start[M], start[S]], axis=1).ravel() - begin
    return out[np.arange(text_off[-1]) + shifts(begin, shift, text_off[-1])], text_off


def strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(buf)).cast(pa.string())


def _draws(seed: int):
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of ``docs(doc_id, text)``."""
    def run(batches):
        for batch in batches:
            draws = np.stack([batch.column(f"h{i}").to_numpy() for i in range(4)], axis=1) if batch.num_rows else None
            for lo, hi, buf, off in chunks(batch.column("text")):
                out, out_off, (n, form, a, b) = transform(buf, off, draws[lo:hi], rate, suffix_first)
                chars = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()),
                     pa.array(chars[a] - chars[off[:-1]], mask=plain), pa.array(chars[b] - chars[a], mask=plain), strings(out, out_off)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", *_draws(seed)).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _restored_rows(batches):
    for batch in batches:
        form = np.array([FORMS.index(f) for f in batch.column("form").to_pylist()], np.int64)
        for lo, hi, buf, off in chunks(batch.column("output")):
            text = strings(*restore(buf, off, form[lo:hi]))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), text], names=[*batch.schema.names, "restored"])


def restored(rows: DataFrame) -> DataFrame:
    """``rows(form, output, ...)`` of ``fill_in_middle`` with the text rebuilt."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_restored_rows, f"{fields}, restored string")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
     u AS (SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
     s AS (SELECT *, array_to_string(t[1:x], '') AS p, array_to_string(t[x + 1:y], '') AS m, array_to_string(t[y + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


@register("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark, sf_dir):
    out = restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
