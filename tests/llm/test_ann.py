import numpy as np
import pyarrow as pa

from ferrule.llm import ann
from ferrule.llm import queries as Q


def exact(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, dtype=np.float32).astype(np.float64)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = exact(rows, [r for r in rows if r[0] % 100 == 0]), found(Q.op9_ann_search(spark, sf))
    assert want.keys() == got.keys()
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 10 for q in want]) >= 0.95
    dist = {q: dict(v) for q, v in exact(rows, [r for r in rows if r[0] % 100 == 0], len(rows)).items()}
    assert all(abs(dist[q][i] - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_awkward_vectors_ties_and_few(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(0, 40)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(500)]
    bad = [(1000, None), (1001, [0.0] * 5), (1002, [1.0, None, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 5), (1004, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (1005, [1.0, 2.0]), (None, [1.0] * 5), (1006, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    asked = [r for r in rows if r[0] in (0, 3, 100, 300)]
    queries = spark.createDataFrame([*asked, asked[0], (1000, None), (1001, [0.0] * 5)], "vec_id long, embedding array<float>")
    got = found(ann.search(df, queries))
    want = exact(rows, asked)
    assert got.keys() == want.keys()
    for q in want:
        assert [a for a, _ in got[q]] == [a for a, _ in want[q]] and np.allclose([b for _, b in got[q]], [b for _, b in want[q]])
    few = ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>"), queries)
    assert {q: len(v) for q, v in found(few).items()} == {0: 3, 3: 3, 100: 4, 300: 4}
    assert ann.search(df.limit(0), queries).count() == 0 and ann.search(df, queries.limit(0)).count() == 0


def test_recall_in_a_dense_cluster(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x[:2000] = rng.normal(size=64) + 0.05 * rng.normal(size=(2000, 64))
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asked = rows[:2000:50] + rows[2000::500]
    want, got = exact(rows, asked), found(ann.search(df, df.where(f"vec_id in ({','.join(str(i) for i, _ in asked)})")))
    recall = {q: len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 10 for q in want}
    print("recall", np.mean([recall[i] for i, _ in asked[:40]]), np.mean([recall[i] for i, _ in asked[40:]]))
    assert min(recall.values()) == 1


def test_recall_over_many_blocks(spark):
    """100,000 vectors in some eight index blocks of 16,384, 400 reranked at first in each: a 41st, as in production."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100_000, 24)).astype(np.float32)
    x[:33_000] = x[0] + 0.02 * rng.normal(size=(33_000, 24))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(8)
    asked = np.arange(0, len(x), 500)
    got = found(ann.search(df, df.where("vec_id % 500 = 0")))
    wide, hits = x.astype(np.float64), []
    for q in asked.tolist():
        dist = ((wide - wide[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        hits.append(len(set(np.argpartition(dist, 10)[:10].tolist()) & {i for i, _ in got[q]}) / 10)
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.99


def test_a_block_beyond_the_bound_is_passed_over():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    block = ann.Block(ann.Block.pack(np.arange(200), x, ann.Codebook(x.astype(np.float64))), None)
    q = np.concatenate([x[:5], x[:5] + 100]).astype(np.float64)
    least = np.sqrt(((x.astype(np.float64)[:, None] - q) ** 2).sum(axis=2)).min(axis=0)
    assert not block.beyond(q, least).any() and block.beyond(q, np.full(10, 1.0)).tolist() == [False] * 5 + [True] * 5


def test_blocks_of_queries_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = found(ann.search(df, df.where("vec_id < 40")))
    monkeypatch.setattr(ann, "QUERY_BYTES", 700)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 40)
    assert found(ann.search(df, df.where("vec_id < 40"))) == one == exact(rows, rows[:40])


def test_anisotropic_codes_keep_the_parallel_part():
    x = np.random.default_rng(0).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    book = ann.Codebook(x)
    p = book.pairs(x)

    def along(codes):
        r = p - book.words[np.arange(book.m), codes]
        return np.abs((r * p).sum(axis=(1, 2))).mean()

    assert book.weight > 0 and along(book.assign(p, 2)) < along(book.assign(p, 0))  # nearest codewords, weighted ones
