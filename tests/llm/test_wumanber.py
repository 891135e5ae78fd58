import hashlib

import numpy as np

from ferrule.llm import wumanber as W

from . import brute


def items(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    more = [(900, None), (901, ""), (902, "One"), (903, "a b a b"), (904, "w " * 30), (905, "日本 text 日本"), (None, "null id row null id"), (906, "one")]
    return b.unionByName(spark.createDataFrame(more, "item_id long, text string"))


def expected(docs, bench):
    named = [(None if r.item_id is None else str(r.item_id), r.text) for r in bench.collect()]
    out = []
    for r in docs.select("doc_id", "text").collect():
        n, hit, found = brute.contaminated(r.text, named)
        found -= {None}
        out.append((r.doc_id, n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0))
    return sorted(out, key=repr)


def test_report(spark, sf):
    docs, bench = brute.documents(spark, sf), items(spark, sf)
    assert sorted(map(tuple, W.report(W.decontaminate(docs, bench)).collect()), key=repr) == expected(docs, bench)


def test_many_parts_agree(spark, sf, monkeypatch):
    docs, bench = brute.documents(spark, sf), items(spark, sf)
    monkeypatch.setattr(W, "TABLE_BYTES", 6000)
    assert W.tables_of(bench, "item_id", "text", 10)[1] > 1
    assert sorted(map(tuple, W.report(W.decontaminate(docs, bench)).collect()), key=repr) == expected(docs, bench)


def test_drop_keeps_clean_documents_whole(spark, sf):
    docs, bench = brute.documents(spark, sf), items(spark, sf)
    clean = sorted(e[0] for e in expected(docs, bench) if not e[5] and e[0] is not None)
    out = W.drop_contaminated(docs, bench)
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == clean


def test_empty_tables(spark, sf):
    docs, bench = brute.documents(spark, sf), items(spark, sf)
    assert W.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in W.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_a_window_of_many_items_and_long_texts(spark):
    same = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(i, same if i % 2 else f"{same} more{i}") for i in range(300)] + [(1000, "long " * 200_000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + same.upper() + " y"), (2, "z " * 1_500_000 + same), (3, "long " * 9), (4, "long " * 11), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.items), [tuple(s) for s in r.spans]) for r in W.decontaminate(docs, bench).collect()}
    assert got == {1: (12, 10, 300, [(1, 11)]), 2: (1_500_010, 10, 300, [(1_500_000, 1_500_010)]), 3: (9, 0, 0, []), 4: (11, 11, 1, [(0, 11)]), 5: (0, 0, 0, [])}


def test_equal_bytes():
    a, b = np.frombuffer(b"abcabd", np.uint8), np.frombuffer(b"xabdabc", np.uint8)
    at = lambda *x: np.array(x, dtype=np.int64)
    assert W.equal_bytes(a, at(0, 0, 3, 2, 0), at(3, 2, 6, 2, 3), b, at(4, 1, 1, 5, 1), at(7, 3, 4, 5, 4)).tolist() == [True, True, True, True, False]
