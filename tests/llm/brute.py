"""Plain versions of the operators for small inputs, and documents with every odd case."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SYLLABLES = ["an", "ber", "co", "der", "el", "fra", "gu", "hin", "is", "jo", "kal", "mon", "né", "or", "ü", "ß"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, packed string, size int"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_documents(spark):
    """Nulls, empty and blank texts, one-word and long texts, copies, repeated rows, clashing column names."""
    rng = random.Random(7)
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    texts = [
        (None, prose(rng, 80)),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, prose(rng, 30_000)),
        (6, base),
        (7, base),
        (8, " ".join(near)),
        (9, prose(rng, 40) + "\n" + base + "\n" + prose(rng, 40)),
        (10, "same " * 400),
        (11, "\n".join(["a line of text"] * 30)),
        (12, prose(rng, 120)),
        (12, prose(rng, 120)),
        (13, prose(rng, 60)),
        (13, None),
    ]
    texts += [texts[-4]]  # a repeated row
    rows = [(i, t, "xx", s, 0, 1, "k", "p", 1) for (i, t), s in zip(texts, ["a", "b", None] * 9)]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def word_repeats(rows, window=35):
    """Sorted (doc_id, n_words, n_removed, kept_sha256)."""
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in cut for k in range(len(w) - window + 1))
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def byte_repeats(rows, window=100):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256); rows come in their order."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                gone.update(range(k, k + window))
            seen.add(w)
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        spans = sum(k in gone and k - 1 not in gone for k in range(len(b)))
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_components(rows, percent=85):
    """doc_id -> smallest doc_id reachable by links."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    inter = len(x & y)
                    if inter and 100 * inter >= percent * (len(x) + len(y) - inter):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}
