import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import blocks, lm

from . import brute


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def strength(contexts, once):
    left = [sum(c * m / (c + m) for c in contexts) for m in (2.0**k for k in range(-6, 25))]
    return 2.0 ** np.interp(once, left, np.arange(-6, 25))


def expected(rows):
    rows = [(i, re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())) + ["END"]) for i, t in rows]
    train = [w for i, w in rows if not held(i)]
    c = Counter(x for w in train for x in w)
    n, v, times = sum(c.values()), len(c), Counter(c.values())
    two = Counter(p for w in train for p in zip(["BEGIN", *w], w, strict=False))
    three = Counter(p for w in train for p in zip(["BEGIN", *w], w, w[1:], strict=False))
    c["BEGIN"] = len(train)
    e = min(0.95, max(0.05, times[1] / max(1, times[1] + 2 * times[2])))
    m2 = strength([x for w, x in c.items() if w != "END"], sum(x == 1 for x in two.values()))
    m3 = strength([x for (_, w), x in two.items() if w != "END"], sum(x == 1 for x in three.values()))
    p1 = lambda w: (c[w] - e) / n if c[w] else e * v / n
    p2 = lambda a, w: (two[a, w] + m2 * p1(w)) / (c[a] + m2)
    p3 = lambda a, b, w: (three[a, b, w] + m3 * p2(b, w)) / (two[a, b] + m3)

    def p(w, k):
        return p3("BEGIN" if k == 1 else w[k - 2], w[k - 1], w[k]) if k else p2("BEGIN", w[0])

    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(w, k)) for k in range(len(w)))) for i, w in rows]


@pytest.mark.parametrize("fan, size", [(1024, lm.BLOCK_BYTES), (3, 30_000)])
def test_scores_are_those_of_the_plain_model(spark, sf, monkeypatch, fan, size):
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm, "CHUNK", size)
    docs = brute.documents(spark, sf)
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(map(tuple, lm.score(docs).collect()), key=key)
    want = sorted(expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_held_out_texts_score_above_the_base(spark, sf):
    rows = [r for r in lm.score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def weights(train, probes):
    """The automaton of one block, and the weight of each token of the probes, which aren't learned from."""
    texts = [t.encode() for t in train + probes]
    part = {"id": np.arange(len(texts)), "len": np.array([len(t) for t in texts]), "text": np.frombuffer(b"".join(texts), np.uint8)}
    learn = np.arange(len(texts)) < len(train)
    block = lm.Block([part], 1)
    total = {}

    def told(items, kind):
        for _, k, x in items:
            if k == lm.TOTALS:
                total.update(zip(x["name"].tobytes().decode().split("\n"), x["value"].tolist(), strict=False))
        return [x for _, k, x in items if k == kind]

    block.number(told(lm.add_words(0, 1, [x for _, _, x in block.ask_words(0, learn)]), lm.WORDS))
    grams = told(lm.add_grams(0, [x for _, _, x in block.ask_grams(0, learn)]), lm.GRAMS)
    a = lm.Automaton(block, *block.counted(grams), total)
    w = a.traverse(block)
    return a, [w[f : f + c] for f, c in zip(block.first[len(train) :].tolist(), block.counts[len(train) :].tolist(), strict=True)]


def test_probabilities_sum_to_one():
    train = ["a b a c a b", "a b c", "c c a", "b", "a b c a b", "a b a c"]
    for context in ("", "a", "b", "z", "a b", "c a", "c c", "z a", "a z", "b b", "x y a b"):
        k = len(context.split())
        probes = [f"{context} {w}" for w in ("a", "b", "c", "unknown")] + [context]  # the last one ends here
        a, got = weights(train, probes)
        assert abs(sum(10 ** w[k] for w in got) - 1) < 1e-9, context
    assert a.failures > 0 and a.order.max() == 2


def test_lanes_change_nothing(monkeypatch):
    train, probes = ["a b a c a b c c b a", "c a b", "b"], ["a b c a b a b z b a c a b c a", "", "c"]
    _, whole = weights(train, probes)
    for lane in (2, 3, 5):
        monkeypatch.setattr(lm, "LANE", lane)
        assert all(np.array_equal(x, y) for x, y in zip(whole, weights(train, probes)[1], strict=True))


def test_failure_arcs_lead_from_trigrams_down():
    a, (known, new) = weights(["a b c", "a b c", "b d"], ["a b c", "a b d"])
    two, one = a.order == 2, a.order == 1
    assert (a.order[a.falls_to[two]] == 1).all() and (a.falls_to[one] == 0).all()
    assert known[2] > new[2]  # no arc for d after a b: the failure arc, then the arc of b


def test_long_texts(spark):
    long = "w " * 2_500_000 + "the end"
    docs = spark.createDataFrame([(1, long), (3, "w w"), (4, "w w w")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got[1].n_tokens == 2_500_003 and got[1].score < 0


def test_rows_grow_with_the_blocks_not_their_square(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 8)
    for n in (16, 64):
        route = blocks.Route(n)
        sent = [route.rows([(b, 1, {"x": np.array([own, b])}) for b in range(n)], own).num_rows for own in range(n)]
        assert sum(sent) <= 8 * n
        source = spark.createDataFrame([(i,) for i in range(n)], "i long").repartition(4)

        def send(batches, n=n, route=route):
            for batch in batches:
                for own in batch.column(0).to_pylist():
                    yield route.rows([(b, k, {"x": np.array([own, b, k])}) for b in range(n) for k in (1, 2)], own)

        rows = route.relayed(source.mapInArrow(send, blocks.SCHEMA)).collect()
        assert len(rows) <= 2 * 8 * n * len(route.widths)
        met = {}
        for r in rows:
            x = blocks.load(r.data)["x"].reshape(-1, 3)
            assert (x[:, 1] == r.bucket).all() and (x[:, 2] == r.kind).all()
            met.setdefault((r.bucket, r.kind), []).extend(x[:, 0].tolist())
        assert len(met) == 2 * n and all(sorted(v) == list(range(n)) for v in met.values())


def test_buckets_are_spark_s(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, -1, 7, 2**62, -(2**63) + 1, None]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = [r[0] for r in df.select(F.pmod(F.xxhash64("i"), F.lit(13))).collect()]
    assert got == blocks.bucket_of(np.array([blocks.NULL_ID if i is None else i for i in ids]), 13).tolist()


def test_empty_table_and_no_training(spark, sf):
    docs = brute.documents(spark, sf)
    assert lm.score(docs.limit(0)).count() == 0
    rows = lm.score(docs.limit(5), modulus=1, remainder=0).collect()
    assert len(rows) == 5 and all(r.held_out and r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in rows)


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="integer"):
        lm.score(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
