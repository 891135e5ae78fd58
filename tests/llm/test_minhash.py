import random

import numpy as np
import pytest

from ferrule.llm import blocks
from ferrule.llm import minhash as M

from . import brute


@pytest.mark.parametrize("fan, size", [(1024, 16 << 20), (3, 40_000)])
def test_classes_are_those_of_brute_force(spark, sf, monkeypatch, fan, size):
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(blocks.buckets, "__defaults__", (size,))
    docs = brute.documents(spark, sf)
    rows = docs.select("doc_id", "text").collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.text or "")):
        if r.doc_id is not None:
            texts.setdefault(r.doc_id, r.text)
    want = brute.near_classes(texts)
    got = M.classes(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.duplicate == (r.class_id != r.doc_id) for r in got if r.doc_id is not None)
    kept = M.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_a_hub_of_many_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            w[rng.randrange(120)] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute.near_classes(dict(rows))
    got = {r.doc_id: r.class_id for r in M.classes(docs).collect()}
    assert got == want


@pytest.mark.parametrize("clump_bytes", [M.CLUMP_BYTES, 100_000])
def test_pairs_in_a_large_group_that_no_leader_links(spark, monkeypatch, clump_bytes):
    monkeypatch.setattr(M, "CLUMP_BYTES", clump_bytes)
    rng = random.Random(8)
    page = [f"t{k}" for k in range(184)]  # unrelated pages: similarity 180 / 228, just below the threshold
    rows = [(i, [f"o{i}x{k}" for k in range(24)]) for i in range(500)]
    for i in range(0, 200, 2):  # pairs at about 0.81 to 0.9
        kept = rng.choice([5, 8, 12])
        rows[i + 1] = (i + 1, rows[i][1][:kept] + rows[i + 1][1][kept:])
    rows = [(i, " ".join(page + own)) for i, own in rows]
    got = {r.doc_id: r.class_id for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    want = brute.near_classes(dict(rows))
    assert len(set(want.values())) == 400 and got == want


def test_linked_looks_at_all_pairs_between_sides(monkeypatch):
    monkeypatch.setattr(M, "TILE", 16)
    monkeypatch.setattr(M, "EXPAND", 50)
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(8)]
    sets = [np.unique(np.concatenate([base[k % 8][rng.random(40) < 0.93], rng.integers(0, 2**63, k % 4, dtype=np.uint64)])) for k in range(90)]
    cells, cut = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for dense in (0, 20, 10**6):
        monkeypatch.setattr(M, "DENSE", dense)
        for side in (np.zeros(90, np.int64), np.arange(90) // 8 % 2):
            want = [(i, j) for i in range(90) for j in range(i) if (len(set(side.tolist())) == 1 or side[i] != side[j]) and (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
            got = M.linked(cells, cut, np.arange(90), side, 0.8)
            assert {(max(p), min(p)) for p in got} <= set(want) and sorted(M.forest(*np.array(got).T)) == sorted(M.forest(*np.array(want).T))


def test_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 90, dtype=np.uint64), rng.integers(0, 2**63, 30, dtype=np.uint64)
    x, y = np.sort(a), np.sort(np.concatenate([a[:60], b]))
    t = 4000
    s = M.darts(np.concatenate([x, y]), np.array([0, 90, 180]), t)
    assert abs((s[0] == s[1]).mean() - 60 / 120) < 0.03
    assert (s != np.iinfo(np.uint32).max).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in M.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if root(x) != x}


def test_empty_table(spark, sf):
    docs = brute.documents(spark, sf).limit(0)
    assert M.classes(docs).count() == 0 and M.keep_one(docs).count() == 0


def test_long_texts_and_ids_of_other_types(spark):
    long = " ".join(str(i) for i in range(700_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of six words only")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in M.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(TypeError, match="integer"):
        M.classes(docs.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_every_pair_of_a_group_of_up_to_sixteen_meets():
    rng = np.random.default_rng(5)
    for size in (2, 8, 9, 12, 16, 17, 40):
        doc = rng.choice(10**6, size, replace=False)
        a, b = M.met(np.zeros(size, np.uint64), doc, rng.integers(1, 50, size))
        pairs = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True) if p[0] != p[1]}
        every = size * (size - 1) // 2
        assert len(pairs) == every if size <= 16 else len(pairs) < every
