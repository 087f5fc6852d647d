"""Sequence packing by best-fit decreasing.

A document (its token ids and an end id) that is longer than the window is first
cut into full windows, each a sequence of its own, numbered without packing.  What is
left of it is a piece of less than a window.  These are dealt by a hash of their stored
row number (so repeated rows spread too) to shards of about ``SHARD_ROWS``; in a shard they are placed from the longest to the shortest, each
into the open window with the least room that still holds it.  A segment tree
over the possible room (``0..window``) finds that window in ``log(window)`` steps.

Defined results: a null or empty text is a document of the end id alone; equal
lengths go by ``doc_id``, start and checksum; repeated rows are packed each on
its own; extra columns are not read; an empty table has no pieces.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import Work, read_table
from .registry import register

WINDOW = 2048
END_ID = 1
SHARD_ROWS = 1000


class RoomTree:
    """Open windows by room left; ``take(need)`` gives the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, seq: int, room: int) -> None:
        self.open[room].append(seq)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """``(sequence, room)`` with the least room of at least ``need``."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and not (i & 1 == 0 and count[i + 1]):  # up to the first filled right neighbour
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece; ``lengths`` fall."""
    tree, seqs, offs, new = RoomTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            seq, room, new = new, window, new + 1
        else:
            seq, room = found
        seqs.append(seq)
        offs.append(window - room)
        if room > n:
            tree.put(seq, room - n)
    return seqs, offs


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: the full windows of each
    document and the piece that is left."""
    path = path or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        bpe, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(bpe.encode_all(t.as_py() for t in batch.column("text"))):
                ids += end
                for a in range(0, len(ids), 4 * window):
                    part = ids[a:a + 4 * window]
                    row.append(i)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with ``sequence_id`` and ``offset``."""
    p = pieces(docs, window, end_id, path).withColumn("rid", F.monotonically_increasing_id())
    p = Work(docs.sparkSession, "packing").cut(p, "pieces")
    whole = F.col("length") == window
    columns = [c for c in p.columns if c != "rid"]
    full = p.filter(whole).select(*columns, (F.col("rid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    p = p.filter(~whole)
    shards = max(1, -(-p.count() // SHARD_ROWS))
    p = p.select(*columns, F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        seqs, offs = best_fit_decreasing(table.column("length").to_pylist(), window)
        base = table.column("shard")[0].as_py() << 32
        seqs = pa.array(2 * (np.array(seqs, np.int64) + base))
        return table.drop_columns(["shard"]).append_column("sequence_id", seqs).append_column("offset", pa.array(offs, pa.int64()))

    return full.unionByName(p.groupBy("shard").applyInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


@register("op7_packing")
def op7_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))
