"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be joined by a
merge, so it marks a certain cut.  A text is cut at special tokens, white space,
the pre-tokenizer's pieces and then at every such pair; the fragments are encoded
independently, many side by side in numpy, and their ids concatenated.  Words met
before come from a cache of bounded size.  Decoding joins the tokens of the ids.

Defined results: null and empty texts have no ids and decode to ``""``; repeated
rows are encoded each on its own; extra columns are not read.
"""
from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import read_table
from .registry import register

CACHE_ENTRIES = 800_000
VOCABULARY = "word_bpe_49k.json"
SHORT = 64
GROUP_CHARS = 1 << 20
ROWS = 1 << 13
ID_BITS = 20
NO_MERGE = 1 << 62


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the others count up from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else extra))
        extra += b not in keep
    return out


class Bpe:
    """Encoder of one vocabulary file (byte-level BPE with word ends)."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        steps = {s["type"]: s for s in spec["normalizer"]["normalizers"]}
        if set(steps) != {"NFC", "Replace", "Lowercase"}:
            raise ValueError("the vocabulary's normalizer is not supported")
        alphabet = byte_alphabet()
        code = {c: b for b, c in enumerate(alphabet)}
        self.tokens = [""] * (1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])))
        for t, i in vocab.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = rank << ID_BITS | vocab[a + b]
        pairs = np.array([a << ID_BITS | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], np.array([*self.merges.values()], np.int64)[order]
        # token of each byte, then of each byte at a word's end, and the ranks of two such
        self.symbol = np.array([vocab[c] for c in alphabet] + [vocab[c + end] for c in alphabet], np.int64)
        self.first_rank = self._rank(*np.broadcast_arrays(self.symbol[:256, None], self.symbol))
        # byte pairs that some token holds: anywhere but at a word's end, and there
        self.inside, self.ending = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for t in vocab:
            final = t.endswith(end) and len(t) > len(end)
            bs = bytes(code[c] for c in (t[:-len(end)] if final else t))
            for a, b in zip(bs, bs[1:-1] if final else bs[1:]):
                self.inside[a << 8 | b] = True
            if final and len(bs) > 1:
                self.ending[bs[-2] << 8 | bs[-1]] = True
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.space = regex.compile(r"\p{White_Space}+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache, self.older, self.known, self.cache_entries = {}, {}, {}, cache_entries

    # -- encoding
    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts):
        """The ids of each text in turn.  Words that the cache lacks are encoded
        together for about ``GROUP_CHARS`` characters of texts."""
        group, chars = [], 0
        for text in texts:
            group.append(self._words(text))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" in text and self.marks.search(text):
            return [w for p in self.marks.split(text) if p for w in ([p] if p in self.special else self._split(p))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        # str.split also cuts at U+001C..U+001F, which are not white space here
        return self.space.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _group(self, group: list[list[str]]):
        if len(self.cache) > self.cache_entries // 2:  # two generations: what is used again stays
            self.cache, self.older = {}, self.cache
        if len(self.known) > self.cache_entries // 2:
            self.known = {}
        cache, older, known, new, fresh = self.cache, self.older, self.known, {}, set()
        unmet = []
        for w in set().union(*group).difference(cache):
            if w in older:
                cache[w] = older[w]
            elif w in self.special:
                cache[w] = self.special[w].to_bytes(4, "little")
            else:
                unmet.append(w)
        ascii_only = [w for w in unmet if w.isascii()]
        lowered = " ".join(ascii_only).lower().split(" ") if ascii_only else []
        for w, low in zip(ascii_only, lowered):  # as _pieces would cut them
            new[w] = (low,) if low.isalpha() else (low[:-1], low[-1]) if low[-1:] in ".,;:!?" and low[:-1].isalpha() else self.pieces(low)
        for w in unmet:
            if w not in new:
                new[w] = self._pieces(w)
        fresh.update(*new.values())
        fresh = list(fresh.difference(known))
        known.update(zip(fresh, self._encode_pieces(fresh)))
        for w, pieces in new.items():
            cache[w] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])
        for p in fresh:
            if len(p) > SHORT:
                del known[p]
        long = [w for w in new if len(w) > SHORT]
        new = fresh = None
        for words in group:
            yield b"".join(map(cache.__getitem__, words))
        for w in long:
            del cache[w]

    def _pieces(self, part: str):
        # character by character: no special form for a sigma at a word's end
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        if part.isalpha():
            return (part,)
        if part[:-1].isalpha() and part[-1] in ".,;:!?":  # as the pattern would cut it
            return part[:-1], part[-1]
        return self.pieces(part)

    def fragments(self, raw: bytes) -> list[bytes]:
        """The fragments of one piece; the last one gets a trailing space, which no
        piece holds, as its end mark."""
        begin = self._begins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        return [raw[a:b] for a, b in zip(begin, begin[1:])] + [raw[begin[-1]:] + b" "]

    def _begins(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the fragments of pieces begin: at each piece (``first`` has their
        starts and the end of ``raw``) and at every byte pair that no token contains."""
        pair = raw[:-1].astype(np.int32) << 8 | raw[1:]
        cut = ~self.inside[pair]
        final = first[1:] - 2  # the pair at a piece's end, where it has two bytes
        final = final[final >= first[:-1]]
        cut[final] = ~self.ending[pair[final]]
        cut[first[1:-1] - 1] = True
        return np.concatenate([[0], np.flatnonzero(cut) + 1])

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        coded = [p.encode() for p in pieces]
        first = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ids = raw.astype(np.int64)
        ids[first[1:] - 1] += 256
        begin = self._begins(raw, first)
        size = np.diff(begin, append=len(raw))
        symbols, kept = self.symbol[ids], np.zeros(len(raw), bool)
        kept[begin] = True
        lo = 1
        while lo < SHORT:  # fragments of like length are merged side by side
            rows = np.flatnonzero((size > lo) & (size <= 2 * lo))
            for i in range(0, len(rows), ROWS):
                self._merge_rows(symbols, kept, ids, begin[rows[i:i + ROWS]], size[rows[i:i + ROWS]])
            lo *= 2
        for f in np.flatnonzero(size > lo).tolist():
            at = begin[f]
            out = self._merge_long(symbols[at:at + size[f]].tolist())
            symbols[at:at + len(out)] = out
            kept[at:at + len(out)] = True
        ends = np.concatenate([[0], np.cumsum(kept)])[first] * 4
        data, ends = symbols[kept].astype("<u4").tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _merge_rows(self, symbols, kept, ids, begin, size) -> None:
        """Join in each fragment the pair of lowest rank, leftmost first, until none is
        left; its tokens then stand at its first places, marked in ``kept``."""
        cols = np.arange(size.max())
        at = np.minimum(begin[:, None] + cols, len(symbols) - 1)
        now, codes = symbols[at], ids[at]
        rank = np.where(cols[1:] < size[:, None], self.first_rank[codes[:, :-1] & 255, codes[:, 1:]], NO_MERGE)
        while len(now):
            row, pos = np.arange(len(now)), rank.argmin(1)
            best = rank[row, pos]
            go = best < NO_MERGE
            if not go.all():
                done = ~go
                place = cols < size[done, None]
                to = (begin[done, None] + cols)[place]
                symbols[to], kept[to] = now[done][place], True
                now, rank, begin, size, pos, best = now[go], rank[go], begin[go], size[go], pos[go], best[go]
                if not len(now):
                    return
                row = np.arange(len(now))
            size = size - 1
            now[:, :-1] = np.where(cols[:-1] > pos[:, None], now[:, 1:], now[:, :-1])
            rank[:, :-1] = np.where(cols[:-2] > pos[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_MERGE
            now[row, pos] = best & (1 << ID_BITS) - 1
            right = pos + 1 < size
            rank[row[~right], pos[~right]] = NO_MERGE
            for r, p in ((row[right], pos[right]), (row[pos > 0], pos[pos > 0] - 1)):
                rank[r, p] = self._rank(now[r, p], now[r, p + 1])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << ID_BITS | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], NO_MERGE)

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m & (1 << ID_BITS) - 1, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for l in (prv[i], i):
                if l >= 0 and nxt[l] >= 0 and (m := merges.get((ids[l], ids[nxt[l]]))) is not None:
                    heapq.heappush(heap, (m, l, ids[l], ids[nxt[l]]))
        return [x for x in ids if x >= 0]

    # -- decoding
    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones too, with a space between two."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Bpe:
    """One encoder, with its cache, for all tasks of a Python worker."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, full: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of ``docs(doc_id, text)``; without
    ``full`` the digests ``ids_sha256`` and ``decoded_sha256`` stand for the last two."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode_all(t.as_py() for t in batch.column("text")):
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                a.append(ids if full else hashlib.sha256(ids).hexdigest())
                b.append(decoded if full else hashlib.sha256(decoded.encode()).hexdigest())
            out = [batch.column("doc_id"), pa.array(n, pa.int64()),
                   pa.array(a, pa.binary() if full else pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "a", "b"])

    kind = dict(docs.dtypes)["doc_id"]
    names = ("ids", "decoded") if full else ("ids_sha256", "decoded_sha256")
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, a {'binary' if full else 'string'}, b string")
    return out.toDF("doc_id", "n_tokens", *names)


@register("op5_bpe")
def op5_bpe(spark, sf_dir):
    return encode_documents(read_table(spark, sf_dir, "documents"), full=False)
