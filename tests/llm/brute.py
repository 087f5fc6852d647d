"""Plain-Python answers to hold the operators against."""
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(nodes, linked):
    """Least member of each node's group."""
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1:]:
            if find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def near_copies(rows):
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    return {i: len(s) for i, s in sets.items()}, groups(list(sets), linked)


def without_repeats(rows, length=100):
    """``{id: (bytes left, runs)}``, documents in the order of their ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data, runs = (t or "").encode(), []
        for k in range(len(data) - length + 1):
            w = data[k:k + length]
            if w in seen:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
            seen.add(w)
        left, at = b"", 0
        for s, e in runs:
            left += data[at:s]
            at = e
        out[i] = (left + data[at:], runs)
    return out


def without_lines(rows, min_docs=10):
    """``{id: (text left, lines, dropped)}``"""
    ws = " \t\n\x0b\x0c\r"
    keys = {i: [(l, l.strip(ws).translate(LOW)) for l in (t or "").split("\n")] for i, t in rows}
    docs = defaultdict(set)
    for i, ls in keys.items():
        for _, k in ls:
            docs[k].add(i)
    gone = {k for k, d in docs.items() if k and len(d) >= min_docs}
    return {i: ("\n".join(l for l, k in ls if k not in gone), len(ls), sum(k in gone for _, k in ls)) for i, ls in keys.items()}


def counts(text):
    w, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, inside = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(inside)
