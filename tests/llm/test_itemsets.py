import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ferrule.llm import itemsets


def brute(rows, least=8, share=5000):
    """items -> (support, rules [(c, a, s)]) from all frequent itemsets, level by level."""
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    least = max(least, -(-len(baskets) // share))
    support, level = {}, Counter(frozenset([i]) for s in baskets.values() for i in s)
    while level := {s: n for s, n in level.items() if n >= least}:
        support |= level
        wider = {a | b for a in level for b in level if len(a | b) == len(a) + 1}
        level = Counter(w for w in wider for s in baskets.values() if w <= s)
    out = {}
    for x, n in support.items():
        if any(n == m for y, m in support.items() if x < y):
            continue
        found = []
        for c in sorted(x) if len(x) > 1 else ():
            a, s = support[x - {c}], support[frozenset([c])]
            if 100 * n >= 10 * a and n * len(baskets) > a * s:
                found.append((c, a, s))
        out[",".join(map(str, sorted(x)))] = (n, found)
    return out


def told(found):
    return hashlib.sha256(";".join(":".join(map(str, r)) for r in found).encode()).hexdigest()


def mined(spark, df, tmp_path, **how):
    got = itemsets.report(*itemsets.itemsets(df, "sale", "item", f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}", **how)).collect()
    assert len({r["items"] for r in got}) == len(got)
    return {r["items"]: (r.support, r.n_items, r.n_rules, r.best_item, r.rules_sha256) for r in got}


def expected(rows, **how):
    out = {}
    for items, (n, found) in brute(rows, **how).items():
        best = min(((a, c) for c, a, _ in found), default=(None, None))[1]
        out[items] = (n, items.count(",") + 1, len(found), best, told(found))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(b, i, "x", None) for b, i in rows], "sale long, item long, items string, support int")


@pytest.fixture
def awkward():
    """A hot item, a hot basket, a group that is always together, ties, nulls and repeated rows."""
    rng = np.random.default_rng(3)
    rows = [(b, int(i)) for b in range(400) for i in rng.choice(14, size=rng.integers(1, 5), replace=False)]
    rows += [(b, 1) for b in range(0, 1500, 3)] + [(7, i) for i in range(90)] + [(b, i) for b in range(600, 620) for i in (50, 51, 52, 53)] + [(b, 51) for b in range(620, 640)]
    return rows + rows[:50] + [(None, 3), (5, None), (None, None)] * 10 + [(-4, -9)] * 30 + [(b, -9) for b in range(9)]


def test_against_all_frequent_sets(spark, tmp_path, awkward):
    want = expected(awkward)
    assert any(v[2] for v in want.values()) and max(v[1] for v in want.values()) >= 4
    assert mined(spark, frame(spark, awkward).repartition(5), tmp_path) == want
    assert mined(spark, frame(spark, awkward), tmp_path, least=20, share=50) == expected(awkward, least=20, share=50)


def test_large_shards_are_split_by_further_items(spark, tmp_path, awkward):
    assert mined(spark, frame(spark, awkward), tmp_path, most_cells=60) == expected(awkward)
    assert len([p for p in (tmp_path / "0").iterdir() if p.name.startswith("shards-")]) >= 3


def test_a_long_set_costs_one_set_and_not_its_subsets(spark, tmp_path):
    rows = [(b, i) for b in range(12) for i in range(60)] + [(b, i) for b in range(12, 24) for i in range(30)]
    got = mined(spark, frame(spark, rows), tmp_path)
    assert {k: v[0] for k, v in got.items()} == {",".join(map(str, range(60))): 12, ",".join(map(str, range(30))): 24}
    # the rest of the 60 is still held by the 12 if a rarer item stays, whose baskets they are
    whole = next(v for v in got.values() if v[1] == 60)
    found = [(c, 12, 24 if c < 30 else 12) for c in range(60)]
    assert whole[2:] == (30, 30, told([r for r in found if 12 * 24 > r[1] * r[2]]))


def test_the_support_of_others_that_no_shard_gives(spark, tmp_path):
    """Sets of three whose rest is held by more baskets, always together with another item that is more, or less, frequent."""
    rows = [(b, i) for b in range(30) for i in (1, 2, 9)] + [(b, 5) for b in range(10)] + [(b, 9) for b in range(30, 60)] + [(b, 2) for b in range(60, 75)]
    assert mined(spark, frame(spark, rows), tmp_path) == expected(rows)


def test_empty_tables_and_kinds(spark, tmp_path):
    assert mined(spark, frame(spark, [(1, 2)]).limit(0), tmp_path) == {} == mined(spark, frame(spark, [(None, 2), (2, None)]), tmp_path)
    text = spark.createDataFrame([(f"basket {b}", i) for b in range(9) for i in (4, 3)], "sale string, item int")
    assert mined(spark, text, tmp_path).keys() == {"3,4"}
    with pytest.raises(TypeError):
        itemsets.itemsets(text, "item", "sale", f"file://{tmp_path}/none")


def test_the_tree():
    tree = {}
    for k, items in enumerate([(0, 1, 2), (0, 1, 2), (0, 1, 3), (0, 1), (1, 2), (2,)]):
        itemsets.push(tree, items, 1, 1 << k, 0)
    assert tree[1] == [1, 16, 0, (2,)] and tree[0][0] == 4 and isinstance(tree[0][3], dict)  # one branch is an array, one is nodes
    assert sorted((p, n) for p, n, _, _ in itemsets.paths(tree[0][3])) == [((1,), 1), ((1, 2), 2), ((1, 3), 1)]
    _, _, _, sub = tree.pop(0)
    itemsets.push(tree, sub, 4, 15, 0)
    assert {k: v[0] for k, v in tree.items()} == {1: 5, 2: 1} and tree[1][1] == 31
    found = {}
    baskets = [((0, 1, 2), 3, 7, 0), ((1, 2), 2, 24, 0)]
    itemsets.grow(baskets, itemsets.totals(baskets), (9,), 2, found)
    assert found == {(3, 7, 0): (9, 0, 1, 2), (5, 31, 0): (9, 1, 2)}


def test_chunks_of_a_shard_agree(monkeypatch):
    rng = np.random.default_rng(0)
    lists = [sorted(rng.choice(30, size=rng.integers(2, 9), replace=False).tolist()) for _ in range(300)]
    flat, at, n = np.array(list(itertools.chain(*lists))), np.cumsum([0, *map(len, lists)]), np.ones(300, np.int64)
    one = list(itemsets.conditional(flat, at, n, lambda names: names % 2 == 0, 5))
    monkeypatch.setattr(itemsets, "CHUNK", 40)
    assert list(itemsets.conditional(flat, at, n, lambda names: names % 2 == 0, 5)) == one and all(i % 2 == 0 for i, _ in one)
    table = pa.table({"prefix": pa.array([[]] * 300, pa.list_(pa.int64())), "part": pa.array([0] * 300, pa.int64()), "items": pa.array(lists, pa.list_(pa.int64())), "n": n, "x": n, "y": n})
    assert itemsets.mine(5, 1)(table).num_rows
