"""Plain Python versions of the operators, and documents with every awkward case."""

import hashlib
import random
import re
from collections import Counter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, runs of one word, odd spaces, nulls, empties."""
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "é", "beta", "über", "x", "gamma7", "日本", "don't", "a-b", "ZETA"]) + str(r.randrange(60))
    passage = [word() for _ in range(45)]
    out = []
    for i in range(n):
        w = [word() for _ in range(r.choice([0, 1, 3, 4, 5, 25, 80, 150]))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[: r.choice([19, 20, 21, 45])]
        if i % 7 == 3 and out:
            w = (out[-3][1] or "").split()
            for _ in range(len(w) // 60):
                w[r.randrange(len(w))] = word()
        if i % 9 == 4:
            w = ["same"] * r.choice([5, 21, 40, 300])
        if i % 11 == 6 and w:
            w = w * 3
        text = r.choice([" ", "\n", "\t ", "  "]).join(w)
        out.append((i, text, "en", f"s{i % 4}" if i % 13 else None, len(text)))
    out += [(n, None, None, "s1", None), (n + 1, "", None, None, 0), (n + 2, "  \n\t", None, "s1", 4), (n + 3, " ".join(word() for _ in range(6000)), None, "s0", 1)]
    out += [(n + 4, out[10][1], None, "s0", 1), (n + 4, out[10][1], None, "s0", 1), (None, out[10][1], None, "s2", 1), (None, out[11][1], None, "s2", 1)]
    return out


def shingles(text, k=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def jaccard(docs):
    s = [shingles(d[1]) for d in docs]
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)
    root = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if link(s[i], s[j])])
    least = {}
    for d, r in zip(docs, root):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    return Counter((d[0], len(x), least.get(r) if x else d[0]) for d, x, r in zip(docs, s, root))


def repeats(docs, n=20):
    first, words = {}, [SPACE.findall(d[1] or "") for d in docs]
    key = lambda i, p: ((1, 0) if docs[i][0] is None else (0, docs[i][0]), p)
    for i, w in enumerate(words):
        for p in range(len(w) - n + 1):
            g = tuple(w[p : p + n])
            first[g] = min(first.get(g, key(i, p)), key(i, p))
    marks = {}
    for i, w in enumerate(words):
        marks.setdefault(docs[i][0], set()).update(p for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < key(i, p))
    out = Counter()
    for i, w in enumerate(words):
        gone = {q for p in marks[docs[i][0]] for q in range(p, p + n)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out[docs[i][0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def contamination(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes, out = {len(g) for g in windows}, Counter()
    for d in docs:
        w, hit, ids = PLAIN.findall((d[1] or "").translate(LOWER)), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    ids |= found
        ids = sorted(str(x) for x in ids if x is not None)
        out[d[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
