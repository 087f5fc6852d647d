"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct ``SHINGLE``-word shingles; equal sets are one
node.  The shingles of a node are hashed to ``GROUPS`` groups, and the counts per
group are its point.  The sum of the coordinate minima of two points bounds their
overlap, and so do, for two boxes of an R-tree, the minima of their upper corners.

1. Two sets of Jaccard similarity t share one of the first ``n - ceil(t n) + 1``
   shingles in any order that holds for all sets.  The order puts frequent shingles
   last: a fixed-size bitmap, filled from the counts of all documents, says which
   are; whatever it says, the order is the same for all sets, so nothing is lost.
2. Nodes that share such a shingle meet in its posting list.  At the first shingle that
   two sets share in that order, what is left of each set bounds their overlap; a node
   leaves a list of up to ``LEAF`` nodes where sizes and this bound rule out all others,
   so a list of nodes that share it by chance is not stored.  Each node is compared
   with one leader per list, and in lists of more than ``LEAF`` nodes ``STARS`` times,
   with a leader from the largest group so far, until a turn finds few links; links found
   so join nodes to groups, so that a list of thousands of near copies needs few pairs.
3. In each list that still holds several groups, an R-tree packed by size is joined
   with itself; pairs of boxes or points are dropped when they belong to one group,
   when their sizes differ too much or when the bound is under the overlap needed.
   A list of more than ``BLOCK`` nodes is dealt to pairs of blocks.  Of all lists that
   two nodes share only the first hands the pair on.
4. Surviving pairs are verified on the full sets.  Of the pairs of two groups the closest
   one goes first, until a turn finds few links: two groups that it joins need no other.

Defined results: texts without words (null too) have no shingles and link with
nothing; a text of fewer words is one shingle; repeated rows and rows that share an
id are documents of their own with one set each; a null id takes part but names no
component; extra columns are not read.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Powers, Work, chunks, components, lower, maybe_among, mix, prefix_hash, read_table, text_hash, words
from .registry import register

SHINGLE = 5
#: similarity of 3/4, as (over, under): linked if under * shared >= over * (all)
NUM, DEN = 3, 4
GROUPS = 256
#: of the shingles each document draws this share; HOT draws make a shingle frequent
DRAW = np.uint64((1 << 64) // 10)
HOT = 2
STARS = 5
LEAF = 16
BLOCK = 2048
FRONT = 500
PAIRS = 100_000
MOST = 65_535
#: sets of more shingles have a finer point
FINE_FROM = 1024
#: a set in more lists than this does not tell its pairs their first common list
LISTS = 512
#: leaders are tried until a turn finds less than this part of the links; the next one finds far fewer
LAST = 5
#: less than this part of the links is few
ENOUGH = 20
#: pairs of two groups on average that are verified all at once
FEW = 4
#: postings taken at a time
ROWS = 1 << 14


def shingle_sets(buf: np.ndarray, off: np.ndarray, powers: Powers, size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    buf = lower(buf)
    start, end, first = words(buf, off)
    word = text_hash(buf, prefix_hash(buf, powers), start, end, powers)
    n = len(word)
    if n >= size:
        grams = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            grams = (grams * np.uint64(0x100000001B3)) ^ mix(word[k:n - size + 1 + k] + np.uint64(k))
        grams = mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            place = np.arange(b - a, dtype=np.uint64)
            yield mix((mix(word[a:b] + place) * (place + place + np.uint64(3))).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int((mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) ^ mix(np.array([len(s)], np.uint64))[0]).astype(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _longs(arrays) -> pa.Array:
    arrays = [a.astype(np.int64) for a in arrays]
    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sets(batches, column="text"):
    powers = Powers()
    for b in batches:
        out: list[np.ndarray] = []
        for _, _, buf, off in chunks(b.column(column)):
            out += shingle_sets(buf, off, powers)
        yield b, out


def _name_rows(batches):
    """Id, size and name of each set, and a share of its shingles that each document
    draws anew, so that a shingle's draws follow its number of documents."""
    for b, sets in _sets(batches):
        n = pa.array([len(s) for s in sets], pa.int64())
        node = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
        probe = _longs([s[mix(s ^ np.uint64(set_id(s) & (1 << 64) - 1)) < DRAW] if len(s) else s for s in sets])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), n, node, probe], names=["doc_id", "th", "n", "node", "probe"])


def _posting_rows(hot: Bitmap):
    def run(batches):
        for b, sets in _sets(batches):
            h, node, n, at = [], [], [], []
            for s in sets:
                if len(s):
                    k = prefix_length(len(s))
                    late = hot(s)
                    first = s[~late][:k]
                    h.append(np.concatenate([first, s[late][:k - len(first)]]))
                    node.append(set_id(s))
                    n.append(len(s))
                    at.append(np.arange(k, dtype=np.int32))
            reps = np.array([len(x) for x in h], np.int64)
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            at = np.concatenate(at) if at else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(at), pa.array(np.repeat(np.array(node, np.int64), reps)),
                                              pa.array(np.repeat(np.array(n, np.int32), reps))], names=["h", "at", "node", "n"])
    return run


def partnered(h: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of whole lists, one after the other: the rows that may link with another one of
    their list, if this is the first shingle that the two share.  ``at`` is its place in
    the set; a list of more than ``LEAF`` rows is not tried and stays."""
    edge = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    size = np.repeat(np.diff(edge), np.diff(edge))
    end = np.repeat(edge[1:], np.diff(edge))
    out, row, n, left = size > LEAF, np.arange(len(h)), n.astype(np.int64), n.astype(np.int64) - at
    row = row[~out & (size > 1)]
    for k in range(1, LEAF):
        row = row[row + k < end[row]]
        if not len(row):
            break
        i, j = row, row + k
        ok = (NUM + DEN) * np.minimum(left[i], left[j]) >= need(n[i], n[j])
        out[i[ok]] = out[j[ok]] = True
    return out


def _shared_rows(batches):
    """Of postings sorted by shingle and node: the distinct ones of the lists with two
    nodes or more that may link (see ``partnered``).  At most ``ROWS`` rows of a batch
    and more than that, and of the open list ``LEAF`` rows, are held."""
    cols = ("h", "node", "n", "at")
    held, rows = [], 0
    long = None  # the open list and its last node, if it is a long one and its rows are handed on

    def lists(last: bool):
        nonlocal held, rows, long
        h, node, n, at = (np.concatenate([b[k] for b in held]) for k in range(4))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        if long is not None:
            new[0] &= (h[0], node[0]) != long
        h, node, n, at = h[new], node[new], n[new], at[new]
        open_at = len(h) if last else int(np.searchsorted(h, h[-1])) if len(h) else 0
        more = int(np.searchsorted(h, long[0], "right")) if long is not None else 0
        keep = np.ones(len(h), bool)
        if more < open_at:
            keep[more:open_at] = partnered(h[more:open_at], n[more:open_at], at[more:open_at])
        if len(h) == more or len(h) - open_at > LEAF:  # the open list is a long one
            open_at = len(h)
            long = (h[-1], node[-1]) if len(h) else long
        else:
            long = None
        held, rows = [(h[open_at:], node[open_at:], n[open_at:], at[open_at:])], len(h) - open_at
        keep = np.flatnonzero(keep[:open_at])
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(node[keep]), pa.array(n[keep])], names=["h", "node", "n"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in cols))
            rows += b.num_rows
            if rows >= ROWS:
                yield lists(False)
    if rows:
        yield lists(True)


def fine_bits(n: int) -> int:
    """Bits of the finer point: about four shingles a group; up to ``FINE_FROM`` shingles
    it is the point of the tree."""
    return 8 + max(0, ((max(n, 1) - 1) // FINE_FROM).bit_length())


def _counts(s: np.ndarray, bits: int) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), MOST).astype("<u2").tobytes()


def _point_rows(batches):
    """The point of each set for the tree, and the finer one for pairs."""
    for b, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([_counts(s, 8) for s in sets], pa.binary()),
                                          pa.array([_counts(s, fine_bits(len(s))) for s in sets], pa.binary())], names=["node", "point", "fine"])


def _hash_rows(batches):
    for b, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), _longs(sets)], names=["node", "hashes"])


def points_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), GROUPS)


def _bound_rows(batches):
    """Pairs whose sizes and coordinate minima allow a link, by the coarser of the two
    fine points (a group of it is a run of groups of the other)."""
    for b in batches:
        na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        ok = (DEN * na >= NUM * nb) & (DEN * nb >= NUM * na)
        for i in np.flatnonzero(ok):
            p, q = (np.frombuffer(b.column(c)[i].as_buffer(), "<u2").astype(np.int64) for c in ("p_a", "p_b"))
            if max(p.max(), q.max()) < MOST:
                size = min(len(p), len(q))
                low = np.minimum(p.reshape(size, -1).sum(axis=1), q.reshape(size, -1).sum(axis=1)).sum()
                ok[i] = (NUM + DEN) * low >= need(na[i], nb[i])
        yield b.select(["a", "b"]).filter(pa.array(ok))


def _verify_rows(batches):
    for b in batches:
        x, y = b.column("hashes_a"), b.column("hashes_b")
        ok = []
        for i in range(len(b)):
            p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
            shared = len(np.intersect1d(p, q, assume_unique=True))
            ok.append((NUM + DEN) * shared >= NUM * (len(p) + len(q)))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def need(na, nb):
    """Linked if the overlap times ``NUM + DEN`` reaches this."""
    return NUM * (na + nb)


class CountTree:
    """A packed R-tree over count vectors: boxes by upper corner, least and most size,
    and the group they belong to if it is one (-1 if not)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comp: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.rows, self.points, self.sizes, self.comp = order, points[order], sizes[order], comp[order]
        self.levels = []
        top, lo, hi, one = self.points, self.sizes, self.sizes, self.comp
        while True:
            cut = np.arange(0, len(lo), LEAF)
            top = np.maximum.reduceat(top, cut, axis=0)
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            least, most = np.minimum.reduceat(one, cut), np.maximum.reduceat(one, cut)
            one = np.where(least == most, least, -1)
            self.levels.append((top, lo, hi, one))
            if len(lo) == 1:
                break

    def boxes(self, level: int):
        """``(upper corner, least size, most size, group)`` of a level; -1: the points."""
        return self.levels[level] if level >= 0 else (self.points, self.sizes, self.sizes, self.comp)


def may_link(a, i: np.ndarray, b, j: np.ndarray) -> np.ndarray:
    """Which pairs ``(i, j)`` of the boxes ``a`` and ``b`` may hold a link.  Corners are
    gathered for a few pairs at a time, and only where sizes and groups allow."""
    (top_a, low_a, high_a, one_a), (top_b, low_b, high_b, one_b) = a, b
    ok = (DEN * high_b[j] >= NUM * low_a[i]) & (DEN * high_a[i] >= NUM * low_b[j]) & ((one_a[i] != one_b[j]) | (one_a[i] == -1))
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 4_000):
        k = at[lo:lo + 4_000]
        low = np.minimum(top_a[i[k]], top_b[j[k]])
        # a count at the end of its range may stand for more
        full = (low == MOST).any(axis=1)
        out[k] = full | ((NUM + DEN) * low.sum(axis=1, dtype=np.int64) >= need(low_a[i[k]], low_b[j[k]]))
    return out


def nearness(point: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bound of the overlap of the rows ``i`` and ``j``, in thousandths of both sizes."""
    out = np.zeros(len(i), np.int32)
    for lo in range(0, len(i), 4_000):
        a, b = i[lo:lo + 4_000], j[lo:lo + 4_000]
        out[lo:lo + 4_000] = 1000 * np.minimum(point[a], point[b]).sum(axis=1, dtype=np.int64) // (n[a] + n[b])
    return out


def tree_join(s: CountTree, t: CountTree):
    """Row pairs of two trees that may link, in pieces; a tree with itself gives each
    pair once.  Pairs of boxes wait on a stack, so what is open at a time is bounded."""
    same = s is t
    todo = [(len(s.levels) - 1, len(t.levels) - 1, np.array([0]), np.array([0]))]
    while todo:
        ls, lt, i, j = todo.pop()
        if len(i) > FRONT:
            todo += [(ls, lt, i[k:k + FRONT], j[k:k + FRONT]) for k in range(0, len(i), FRONT)]
            continue
        if ls >= 0 and ls >= lt:
            i, j = _children(i, j, len(s.levels[ls - 1][1]) if ls else len(s.sizes))
            ls -= 1
        if lt >= 0 and lt > ls:
            j, i = _children(j, i, len(t.levels[lt - 1][1]) if lt else len(t.sizes))
            lt -= 1
        if same and ls == lt:
            i, j = i[i <= j], j[i <= j]
        keep = may_link(s.boxes(ls), i, t.boxes(lt), j)
        i, j = i[keep], j[keep]
        if ls >= 0 or lt >= 0:
            if len(i):
                todo.append((ls, lt, i, j))
        else:
            if same:
                i, j = i[i < j], j[i < j]
            yield s.rows[i], t.rows[j]


def _children(i: np.ndarray, j: np.ndarray, below: int):
    kids = np.minimum(LEAF, below - i * LEAF)
    out = np.repeat(i * LEAF, kids) + np.arange(kids.sum()) - np.repeat(np.cumsum(kids) - kids, kids)
    return out, np.repeat(j, kids)


def first_common(h: np.ndarray, own: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the list ``h[i]`` is the least one that the rows ``i`` and ``j`` share, so
    that a pair is handed on by one of its lists.  ``own`` holds the lists of each row
    up to ``ends`` (sorted; none: not known, so the pair is handed on)."""
    names, place = np.unique(own, return_inverse=True)
    begin = np.concatenate([[0], ends[:-1]])
    key = np.repeat(np.arange(len(ends)), ends - begin) << 32 | place
    at_h = np.searchsorted(names, h[i])
    out = np.ones(len(i), bool)
    for lo in range(0, len(i), 4_000):
        a, b, limit = i[lo:lo + 4_000], j[lo:lo + 4_000], at_h[lo:lo + 4_000]
        before = np.searchsorted(key, a << 32 | limit) - begin[a]  # lists of ``a`` before this one
        before = np.where(ends[a] > begin[a], before, 0)
        pair = np.repeat(np.arange(len(a)), before)
        other = place[np.repeat(begin[a] - np.cumsum(before) + before, before) + np.arange(before.sum())]
        want = b[pair] << 32 | other
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        out[lo + pair[key[at] == want]] = False
    return out


def _tree_rows(batches):
    """Pairs that may link, of rows sorted by list and pair of blocks."""
    cols = ("h", "bi", "bj")

    def edges(t):
        ids = np.stack([t.column(c).to_numpy() for c in cols])
        return np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [t.num_rows]])

    def pairs(t: pa.Table):
        edge = edges(t)
        node, n, comp, bi, bj, blk = (t.column(c).to_numpy() for c in ("node", "n", "comp", "bi", "bj", "blk"))
        point = points_of(t.column("point"))
        n = n.astype(np.int64)
        size = np.repeat(np.diff(edge), np.diff(edge))
        first = np.repeat(edge[:-1], np.diff(edge))
        at, small, found = np.arange(len(node)), (size <= LEAF) & (bi == bj), []
        rows, waiting = (point, n, n, comp), 0
        h, lists = t.column("h").to_numpy(), t.column("lists").combine_chunks()
        own, ends = pc.list_flatten(lists).to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))

        def batch():
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            mine = first_common(h, own, ends, i, j)
            i, j = i[mine], j[mine]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if len(a):
                (a, b), one = np.unique(np.stack([a, b]), axis=1, return_index=True)
                i, j = i[one], j[one]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(nearness(point, n, i, j), pa.int32()),
                                               pa.array(np.minimum(n[i], n[j]) <= FINE_FROM)], names=["a", "b", "near", "tried"])

        for k in range(1, LEAF):  # lists of one leaf, all at once
            i = at[small & (at - first + k < size)]
            ok = may_link(rows, i, rows, i + k)
            found.append((i[ok], i[ok] + k))
        for lo, hi in zip(edge[:-1], edge[1:]):
            if not small[lo]:
                x = at[lo:hi][blk[lo:hi] == bi[lo]]
                y = at[lo:hi][blk[lo:hi] == bj[lo]]
                if len(x) and len(y):
                    s = CountTree(point[x], n[x], comp[x])
                    t = s if bi[lo] == bj[lo] else CountTree(point[y], n[y], comp[y])
                    for i, j in tree_join(s, t):
                        found.append((x[i], y[j]))
                        waiting += len(i)
                        if waiting > PAIRS:
                            yield batch()
                            found, waiting = [], 0
        if found:
            yield batch()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * BLOCK:
            t = pa.Table.from_batches(held)
            last = edges(t)[-2]
            if last:
                yield from pairs(t.slice(0, last))
                held, rows = t.slice(last).combine_chunks().to_batches(), rows - last
    if rows:
        yield from pairs(pa.Table.from_batches(held))


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, th, n, node)`` of every row, ``th`` a hash of its text, and ``(node, comp)`` of the linked
    nodes but the one that names their group."""
    work = Work(docs.sparkSession, "ngrams")
    kind = dict(docs.dtypes)["doc_id"]
    text = docs.select("doc_id", "text")
    drawn = work.cut(text.select("*", F.xxhash64("text").alias("th")).mapInArrow(
        _name_rows, f"doc_id {kind}, th long, n long, node long, probe array<long>"), "draws")
    hot = drawn.select(F.explode("probe").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT)
    hot = Bitmap(hot, "h")
    named = work.cut(drawn.drop("probe"), "sets")
    work.drop(drawn)
    postings = text.mapInArrow(_posting_rows(hot), "h long, at int, node long, n int")
    shared = work.cut(postings.repartition(F.col("h")).sortWithinPartitions("h", "node").mapInArrow(_shared_rows, "h long, node long, n int"), "lists")
    # one document for each node that some list holds
    met = shared.select("node").distinct()
    reps = work.cut(named.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.expr(ROW_HASH)).alias("k"), F.min("n").alias("n"))
                    .join(met, "node", "left_semi"), "nodes")
    points = _asked_texts(text, reps).mapInArrow(_point_rows, "node long, point binary, fine binary")
    points = work.cut(points.join(reps, "node").select("node", "n", "point", "fine").dropDuplicates(["node"]), "points")
    # every list, then the long ones again: a list of two is done after the first turn
    new = verified(work, _star(shared, F.xxhash64("node")), points, text, reps)
    links, comp, waiting = new.count(), _joined(work, None, new), []
    more = shared.groupBy("h").agg(F.count("*").alias("size")).filter("size > 2")
    rest = work.cut(shared.join(more, "h"), "long-lists")
    work.drop(shared)
    for turn in range(1, STARS):
        size = comp.groupBy("comp").agg(F.count("*").alias("members"))
        members = F.coalesce("members", F.lit(0))
        known = rest.filter(F.col("size") > LEAF).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(size, "comp", "left")
        star = _apart(_star(known, -members, F.xxhash64("node", F.lit(turn))), comp)
        new = verified(work, star, points, text, reps)
        n = new.count()
        links += n
        if n * ENOUGH < links:  # so few wait for the next links
            waiting = [new]
        else:
            comp = _joined(work, comp, new)
        if n * LAST < links:  # other leaders may still find some; the trees find all
            break
    rows = rest.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    many = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    rows = rows.join(many, "h")
    lists = rows.groupBy("node").agg(F.when(F.count("*") <= LISTS, F.sort_array(F.collect_list("h"))).alias("lists"))
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")) \
        .withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("h", "node", F.col("n").cast("long").alias("n"), "comp", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    rows = rows.join(points.select("node", "point").join(lists, "node"), "node").repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj", "node")
    found = rows.mapInArrow(_tree_rows, "a long, b long, near int, tried boolean").distinct()
    pairs = work.cut(_grouped(found, comp), "tree-pairs")
    for turn in range(STARS):
        best = work.cut(_closest(pairs), "closest")
        asked = best.count()
        if pairs.count() <= FEW * asked:
            work.drop(best)
            break
        new = verified(work, best.select("a", "b", "near", "tried"), points, text, reps)
        n = new.count()
        waiting.append(new)
        left = work.cut(_unsettled(pairs, best, new), "tree-pairs")
        work.drop(pairs, best)
        pairs = left
        if n * ENOUGH < asked or pairs.count() <= FEW * (asked - n):
            break
        comp, waiting = _joined(work, comp, *waiting), []
        left = work.cut(_grouped(pairs.select("a", "b", "near", "tried"), comp).filter("comp_a <> comp_b"), "tree-pairs")
        work.drop(pairs)
        pairs = left
    new = verified(work, pairs.select("a", "b", "near", "tried"), points, text, reps)
    comp = _joined(work, comp, *waiting, new)
    work.drop(rest, points, reps, pairs)
    return named, comp


def _joined(work: Work, comp: DataFrame | None, *links: DataFrame) -> DataFrame:
    """The groups ``comp(node, comp)`` joined by ``links``; all these tables go."""
    if comp is not None and all(x.isEmpty() for x in links):
        work.drop(*links)
        return comp
    edges = [x.select("a", "b") for x in links] + ([] if comp is None else [comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))])
    out = components(work, reduce(DataFrame.unionByName, edges))
    work.drop(*links, *([] if comp is None else [comp]))
    return out


def _star(lists: DataFrame, *order) -> DataFrame:
    """Each node of a list with the list's leader, the least by ``order``."""
    lead = lists.groupBy("h").agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), "node")).alias("o"))
    both = lists.select("h", "node").join(lead.select("h", F.col("o.node").alias("lead")), "h").filter("node <> lead")
    return both.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _grouped(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs with the groups of both nodes; a node without one is a group."""
    for side in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left") \
            .withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
    return pairs


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one group yet."""
    return _grouped(pairs, comp).filter("comp_a <> comp_b").select(*pairs.columns)


def _closest(pairs: DataFrame) -> DataFrame:
    """Of the pairs between any two groups the one with the highest bound."""
    best = F.max(F.struct("near", "a", "b", "tried", "comp_a", "comp_b")).alias("p")
    return pairs.groupBy(F.least("comp_a", "comp_b"), F.greatest("comp_a", "comp_b")).agg(best).select("p.*")


def _unsettled(pairs: DataFrame, best: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that were not tried as ``best``, of groups that none of ``links`` joins."""
    tried = best.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left") \
        .select(F.least("comp_a", "comp_b").alias("lo"), F.greatest("comp_a", "comp_b").alias("hi"), "a", "b", "linked")
    on = (F.least("comp_a", "comp_b") == F.col("lo")) & (F.greatest("comp_a", "comp_b") == F.col("hi"))
    settled = F.col("linked") | ((pairs["a"] == F.col("x")) & (pairs["b"] == F.col("y")))
    return pairs.join(tried.withColumnsRenamed({"a": "x", "b": "y"}), on & settled, "left_anti")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of ``(a, b)`` that may link by their points; only asked points move."""
    asked = maybe_among(points.select("node", "n", "fine"), F.col("node"), _ends(pairs), "node")
    for side in ("a", "b"):
        pairs = pairs.join(asked.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("fine").alias(f"p_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(_bound_rows, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


#: names a row by its id and text (null-safe)
ROW_HASH = "xxhash64(doc_id, th)"


def _asked_texts(text: DataFrame, reps: DataFrame) -> DataFrame:
    """The texts of the rows named by ``reps.k``, and a few more."""
    return maybe_among(text, F.xxhash64("doc_id", F.xxhash64("text")), reps, "k").select("text")


def verified(work: Work, pairs: DataFrame, points: DataFrame, text: DataFrame, reps: DataFrame) -> DataFrame:
    """The linked ones of ``pairs(a, b)``: first by their points, then by the full sets.
    Pairs that a column ``tried`` marks have passed the points."""
    met = work.cut(pairs, "met")
    if "tried" in met.columns:
        pairs = met.filter("tried").select("a", "b").unionByName(bounded(met.filter("NOT tried"), points))
    else:
        pairs = bounded(met, points)
    pairs = work.cut(pairs, "pairs")
    work.drop(met)
    asked = work.cut(reps.join(_ends(pairs).distinct(), "node", "left_semi"), "asked")
    sets = _asked_texts(text, asked).mapInArrow(_hash_rows, "node long, hashes array<long>")
    both = pairs
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)
    out = work.cut(both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_verify_rows, "a long, b long").distinct(), "links")
    work.drop(pairs, asked)
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of ``docs(doc_id, text)``."""
    named, comp = linked_sets(docs)
    rows = named.select("doc_id", "n", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the smallest id (then the least hash
    of the text); rows that repeat id and text are one."""
    named, comp = linked_sets(docs)
    rows = named.join(comp, "node", "left").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), "doc_id", "th", F.coalesce("comp", "node").alias("comp"))
    best = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "k_id")).alias("b"))
    stay = best.select("b.k_id", "b.th").unionByName(rows.filter("comp IS NULL").select("k_id", "th")).distinct()
    d = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), F.xxhash64("text").alias("th"))
    return d.join(stay, ["k_id", "th"], "left_semi").dropDuplicates(["k_id", "th"]).select("row.*")


@register("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    return near_copies(read_table(spark, sf_dir, "documents"))
