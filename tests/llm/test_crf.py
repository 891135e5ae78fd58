import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ferrule.llm import crf

from . import brute


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 2, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    node, step = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    good, z, pairs = crf.forward_backward(node, step, first, True)
    total = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        w, p1, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(node[first[k] + t] * y[t] for t in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            w += s
            p1 += s * np.array(y)
            for a, b in itertools.pairwise(y):
                moves[a, b] += s
        assert np.isclose(z[k], np.log(w)) and np.allclose(good[first[k] : first[k + 1]], p1 / w)
        total += moves / w
    assert np.allclose(pairs, total)


def test_lines_and_features():
    texts = ["a\nb\n", "", "x", None, "\n\n", "é é é\n$$$ 12"]
    from ferrule.llm import words

    buf, at = words.buffers(pa.array(texts, pa.string()))
    s, e, first = crf.lines(buf, at)
    raw = buf.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(s[f:g], e[f:g], strict=True)] for f, g in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").split("\n") for t in texts]
    index, size, _ = crf.measure(buf, at)
    assert index.max() < crf.N_FEATURES and len(index) == len(size) == len(s)


def plain_features(text):
    """Feature numbers of each line, from the words of the docstring."""
    lines = (text or "").encode().split(b"\n")
    stops = b"!\"'(),-.:;?"
    rows = []
    for line in lines:
        n = max(1, len(line))
        share = lambda test: sum(map(test, line)) / n  # noqa: B023, E731
        w = re.findall(rb"[^\x20\x09-\x0d]+", line)
        values = {
            "length": len(line), "upper": share(lambda c: 65 <= c <= 90), "digit": share(lambda c: 48 <= c <= 57), "space": share(lambda c: c in b" \t\r"), "stop": share(lambda c: c in stops),
            "symbol": share(lambda c: c < 128 and not (chr(c).isalnum() or c in b" \t\r\n" or c in stops)), "high": share(lambda c: c >= 128), "word": len(line) / max(1, len(w)),
            "copies": lines.count(line) if line else 1,
        }
        rows.append((values, w))
    flat = [(k, x) for k, (_, w) in enumerate(rows) for x in w]
    for k, (values, w) in enumerate(rows):
        again = sum(1 for i, (line, x) in enumerate(flat) if line == k and (i > 0 and flat[i - 1][1] == x or i > 1 and flat[i - 2][1] == x))
        values["again"] = again / max(1, len(w))
    bins = [{f: sum(v >= e for e in crf.EDGES[f]) for f, v in values.items()} for values, _ in rows]
    out = []
    for k in range(len(bins)):
        columns = [bins[k][f] for f in crf.EDGES]
        for other in (k - 1, k + 1):
            columns += [bins[other][f] if 0 <= other < len(bins) else crf.BINS for f in crf.NEIGHBOUR]
        out.append([c + i * (crf.BINS + 1) for i, c in enumerate(columns)] + [crf.N_FEATURES - 1])
    return out, [len(line) for line in lines]


def plain_score(text, w, step):
    index, size = plain_features(text)
    node, total, good = [sum(w[i] for i in row) for row in index], 0.0, [0.0] * len(index)
    for y in itertools.product((0, 1), repeat=len(index)):
        p = math.exp(sum(n * a for n, a in zip(node, y, strict=True)) + sum(step[a][b] for a, b in itertools.pairwise(y)))
        total += p
        for k, a in enumerate(y):
            good[k] += p * a
    weight = [max(1, n) for n in size]
    return sum(g / total * n for g, n in zip(good, weight, strict=True)) / sum(weight)


def test_scores_are_those_of_plain_python(spark, sf):
    texts = ["One line.", "A first line of text here.\nBUY NOW!!! $$$ 100%\nbuy buy buy buy\n\nthe end é日", "x\nx\nx", None, "", "\n", "a b a b c\n12 34\n  \t "]
    rng = np.random.default_rng(5)
    w, step = rng.normal(size=crf.N_FEATURES) / 4, rng.normal(size=(2, 2))
    got = crf.qualities(pa.array(texts, pa.string()), w, step)
    assert np.allclose(got, [plain_score(t, w, step) for t in texts])
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w, step = crf.fit(docs, labels)
    few = {r.doc_id: r.text for r in docs.collect() if r.text and r.text.count("\n") < 9 and len(r.text) < 4000}
    scored = {r.doc_id: r.score for r in crf.score(docs, labels).collect()}
    assert len(few) > 20 and all(abs(scored[i] - plain_score(t, w, step)) < 1e-9 for i, t in few.items())


def test_lines_of_a_planted_bad_block_are_told_apart(spark):
    """Documents are labelled as wholes; a bad block in a good one, and good lines in a bad one, are found all the same."""
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "morning", "letter", "paper", "the", "quiet"]) for _ in range(12)).capitalize() + "."
    bad = lambda: " | ".join(rng.choice(["$$$", "CLICK", "###", "99", "WIN!!!", "%%"]) for _ in range(12))
    rows = []
    for i in range(300):
        label = i % 2
        lines = [good() if rng.random() < (0.99 if label else 0.25) else bad() for _ in range(8)]
        rows.append((i, "\n".join(lines), label))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    w, step = crf.fit(docs, labels)
    text = "\n".join([good() for _ in range(5)] + [bad() for _ in range(5)] + [good() for _ in range(5)])
    found = crf.line_labels(text, w, step) > 0.5
    assert found[:4].all() and not found[6:9].any() and found[11:].all()  # neighbours' features blur the edges
    mixed = [crf.line_labels(t, w, step) > 0.5 for _, t, _ in rows]
    assert sum(len(set(m.tolist())) == 2 for m in mixed) > 50


def test_tilts_make_the_shares_hold():
    rng = np.random.default_rng(7)
    sizes = [1, 6, 3, 9]
    first = np.concatenate([[0], np.cumsum(sizes)])
    node, step, size, label = rng.normal(size=first[-1]), rng.normal(size=(2, 2)), rng.integers(0, 50, first[-1]), np.array([1, 0, 1, 0])
    share = crf.shares(crf.forward_backward(node + crf.tilts(node, step, size, first, label), step, first), size, first)
    assert (share[label == 1] >= crf.SHARE[1] - 1e-3).all() and (share[label == 0] <= crf.SHARE[0] + 1e-3).all()


def test_long_texts_string_ids_and_odd_labels(spark):
    docs = spark.createDataFrame([(f"d{i}", "A line of text.\n" * 20) for i in range(20)] + [("long", "word " * 1_000_000), ("lines", "x\n" * 700_000)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2 + 0.5 * (i == 4)) for i in range(20)] + [("lines", 1.0)], "doc_id string, quality double")
    assert {r.doc_id for r in crf.score(docs, labels).collect()} >= {"long", "lines", "d4"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = crf.score(docs, labels)
    assert out.count() == docs.count()
    x = out.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = x.score[x.quality == 1].to_numpy(), x.score[x.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (x.predicted == x.quality).mean() > 0.95 and x.predicted[x.quality == 1].mean() > 0.99


def test_labels_of_held_out_rows_change_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    w, v = crf.fit(docs, labels), crf.fit(docs, flipped)
    assert np.array_equal(w[0], v[0]) and np.array_equal(w[1], v[1])


def test_awkward_rows(spark, sf):
    docs, labels = brute.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    odd = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7), (10**12, 0)], "doc_id long, quality int"))
    rows = crf.score(docs, odd).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = crf.keep_good(docs, odd)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in rows)
    assert crf.score(docs.limit(0), odd).count() == 0
    assert all(np.isclose(r.score, 0.5) for r in crf.score(docs.limit(5), odd.limit(0)).collect())
