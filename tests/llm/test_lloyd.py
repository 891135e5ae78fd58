import hashlib
import math

import numpy as np
import pytest

from ferrule.llm import lloyd


def brute(rows, k=8, rounds=10, dims=64, scale=1024):
    """Sorted (vec_id, cluster, distance, cluster inertia, inertia, hash) by plain rounds."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    start = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None))[:k]
    c = [list(v) for _, _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds if c else 0):
        got = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, l) in zip(kept, got, strict=True) if l == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    got = assign() if c else []
    total = {j: sum(d for d, l in got if l == j) for j in range(len(c))}
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted([(i, l, d, total[l], sum(total.values()), name[l]) for (i, _), (d, l) in zip(kept, got, strict=True)], key=repr)


def run(spark, rows, tmp_path, **how):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)
    folder = f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}"
    return sorted(map(tuple, lloyd.report(*lloyd.cluster(df, folder, **how)).collect()), key=repr)


@pytest.fixture
def rows():
    rng = np.random.default_rng(2)
    out = [(i, [float(x) for x in rng.normal(size=5) * 0.2 + (i % 4)]) for i in range(300)]
    out += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.5]) for i in range(60)] + [(7, [3.0] * 5), (7, [3.0] * 5), (7, [-3.0] * 5), (None, [0.25] * 5)]
    return out + [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] * 5), (2005, [1.0] * 6), (2006, [0.0] * 5)]


def test_rounds_against_plain_ones(spark, rows, tmp_path):
    got = run(spark, rows, tmp_path, dims=5)
    assert got == brute(rows, dims=5) and len({r[1] for r in got}) > 3
    assert run(spark, rows, tmp_path, dims=5, k=40, rounds=3, scale=16) == brute(rows, dims=5, k=40, rounds=3, scale=16)


def test_small_blocks_agree(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK", 37)
    assert run(spark, rows, tmp_path, dims=5, rounds=4) == brute(rows, dims=5, rounds=4)


def test_few_and_none(spark, tmp_path):
    few = [(i, [float(i), 1.0]) for i in range(3)]
    assert run(spark, few, tmp_path, dims=2) == brute(few, dims=2)
    same = [(i, [2.0, 1.0]) for i in range(20)]  # the centroids are equal: all go to the first, the others stay
    assert {r[1] for r in run(spark, same, tmp_path, dims=2)} == {0}
    assert run(spark, [(1, None), (None, [1.0, 2.0])], tmp_path, dims=2) == [] == run(spark, [(1, None)], tmp_path, dims=64)
    with pytest.raises(TypeError):
        lloyd.cluster(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"), f"file://{tmp_path}/x")


def cases():
    rng = np.random.default_rng(0)
    yield rng.normal(size=(700, 16)) * 300, 8
    x = rng.normal(size=(10, 16)) * 300
    yield x[rng.integers(0, 10, 900)] + rng.normal(size=(900, 16)) * 10, 8
    yield rng.normal(size=(900, 2)) * 300, 50
    yield rng.integers(0, 4, size=(300, 2)), 12
    yield np.ones((40, 3)), 3
    yield rng.normal(size=(1, 3)), 1


@pytest.mark.parametrize("x, k", list(cases()))
def test_the_walk_finds_the_nearest_and_the_smaller_number(x, k):
    x = np.floor(x).astype(np.int32)
    tree = lloyd.Tree.of(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    x, c = x[tree.order], x[np.random.default_rng(1).choice(len(x), k, replace=len(x) < k)].astype(np.int64)
    for node in range(len(tree.low)):  # covering
        far = np.sqrt(((x[tree.low[node] : tree.high[node]].astype(float) - x[tree.centre[node]]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[node]
    walk = lloyd.Walk(x, tree, c)
    assert (walk.label == ((x[:, None].astype(np.int64) - c) ** 2).sum(axis=2).argmin(axis=1)).all()
    count, total = walk.sums()
    assert (count == np.bincount(walk.label, minlength=k)).all()
    assert all((total[j] == x[walk.label == j].astype(np.int64).sum(axis=0)).all() for j in range(k))


def test_close_clusters_are_assigned_by_node():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(8, 16)) * 1000
    x = np.floor(middle[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16))).astype(np.int32)
    tree = lloyd.Tree.of(x)
    walk = lloyd.Walk(x[tree.order], tree, np.floor(middle).astype(np.int64))
    assert walk.compared == 0 and walk.visited < 400  # of 16,000 pairs


def test_large_components_are_refused(spark, tmp_path):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="too large"):
        run(spark, [(1, [1e9, 0.0])], tmp_path, dims=2)
