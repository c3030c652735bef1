"""Small tables with the awkward cases, and plain versions of the operators."""

import hashlib
import random
import re

import numpy as np

WORDS = ["the", "of", "idiot", "release", "Tion", "née", "straße", "license", "MIT", "apache", "general", "public", "x", "日本", "a.b", "12"]


def texts(n=60, seed=0):
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(45))
    base = []
    for i in range(n):
        own = " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(r.choice([0, 1, 3, 30, 120])))
        if i % 4 == 1:
            own = own + "\n" + passage + "\n" + own[:40]
        if i % 7 == 2 and base:
            own = base[-1]
        if i % 9 == 3 and base:
            own = base[-1].replace("the", "thee", 1)
        base.append(own)
    return base + ["", None, " \n\t ", "é" * 70, "long " * 3000, "MIT License\nReleased under the MIT License."]


def documents(spark, rows=None, shuffled=True):
    """Ids with gaps, one row twice, one id with two texts, one null id, and columns that clash with results."""
    rows = [(3 * i + 1, t) for i, t in enumerate(texts() if rows is None else rows)]
    if shuffled:
        rows += [rows[5], (rows[6][0], "another text under one id"), (None, rows[1][1]), (None, "no id " * 30)]
        random.Random(1).shuffle(rows)
    full = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), k, "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, keep_id int, row string").repartition(3)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def cut_words(docs, size):
    """(doc_id, n_words, n_removed, kept) by the definition."""
    first, out = {}, []
    for k, t in docs:
        w = words(t)
        for i in range(len(w) - size + 1):
            s = tuple(w[i : i + size])
            first[s] = min(first.get(s, (1 << 63, 0)), (k, i))
    for k, t in docs:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (k, i):
                gone[i : i + size] = True
        out.append((k, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def cut_bytes(docs, size):
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) by the definition."""
    first, out = {}, []
    for k, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], 1 << 63), k)
    for k, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), int)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < k:
                gone[i : i + size] = 1
        out.append((k, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), np.frombuffer(b, np.uint8)[gone == 0].tobytes()))
    return out
