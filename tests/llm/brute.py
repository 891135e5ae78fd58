"""Plain Python versions of the operators, and rows that are awkward for them."""

import re
from collections import Counter, defaultdict

AWKWARD = [None, "", "!!!", "one", "one", "x" * 99, "x" * 100, "x" * 350, "ab" * 200, "é" * 80, "ab" * 200, "é" * 80 + "q", "A b a B", "a B a b", "line\nline\nline\n", "w " * 3000, "日本 text " * 40]


def documents(spark, sf, extra=True):
    """The small documents, awkward texts, a null id, two rows with one id, and columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    if extra:
        rows = [(10**7 + i, t) for i, t in enumerate(AWKWARD)] + [(10**8, "same id row " * 30), (10**8, "same id row " * 30), (None, "null id row " * 31)]
        d = d.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    return d.withColumn("bucket", F.lit(1)).withColumn("score", F.lit("x")).withColumn("id", F.lit(None).cast("int")).withColumn("n_words", F.col("text"))


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def removed(rows, length=100):
    """rows: (key, bytes) in order; for each the flags of removed bytes."""
    seen, out = set(), []
    for _, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        out.append(gone)
    return out


def near_classes(texts, threshold=0.8, shingle=5):
    """id -> smallest id of its class, from {id: text}."""
    cells = {}
    for i, t in texts.items():
        w = words(t)
        c = Counter(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else Counter()
        cells[i] = {(s, j) for s, n in c.items() for j in range(n)}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i in sorted(texts):
        both = Counter(j for s in cells[i] for j in holders[s])
        for s in cells[i]:
            holders[s].append(i)
        for j, n in both.items():
            if n >= threshold * (len(cells[i]) + len(cells[j]) - n) - 1e-9:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def contaminated(text, items, window=10):
    """(words, words hit, items) of a text."""
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            p = v[k : k + window]
            for i in range(len(w) - len(p) + 1):
                if w[i] == p[0] and w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(name)
    return len(w), len(hit), found


def best_pieces(text, score, byte):
    """Left-to-right Viterbi: score {piece: (id, score)}, byte ids of unknown characters."""
    if not text:
        return [], 0
    t = "▁" + text.replace(" ", "▁")
    best, back = [0] + [-(10**18)] * len(t), [None] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        if t[e - 1] not in score:
            best[e], back[e] = best[e - 1], (1, None)
            continue
        for n in range(min(16, e), 0, -1):
            x = score.get(t[e - n : e])
            if x and best[e - n] > -(10**17) and best[e - n] + x[1] > best[e]:
                best[e], back[e] = best[e - n] + x[1], (n, x[0])
    p, out = len(t), []
    while p:
        n, i = back[p]
        out = ([byte[b] for b in t[p - 1].encode()] if i is None else [i]) + out
        p -= n
    return out, best[-1]
