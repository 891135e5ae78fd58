import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import blocks, words
from ferrule.llm import suffix_dedup as S

from . import brute


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300) | st.text("ab", max_size=400).map(str.encode) | st.text("a", max_size=300).map(str.encode), st.sampled_from([8, 13, 100]))
def test_suffix_array_orders_by_the_first_bytes(text, depth):
    sa = S.suffix_array(np.frombuffer(text, dtype=np.uint8), depth).tolist()
    assert sorted(sa) == list(range(len(text)))
    keys = [text[i : i + depth] for i in sa]
    assert all(a <= b for a, b in zip(keys, keys[1:], strict=False))


def expected(docs):
    rows = sorted((r.doc_id if r.doc_id is not None else -(10**18), (r.text or "").encode()) for r in docs.collect())
    out = []
    for (i, b), gone in zip(rows, brute.removed(rows), strict=True):
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i if i > -(10**18) else None, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_report_is_exact(spark, sf):
    docs = brute.documents(spark, sf)
    assert sorted(map(tuple, S.report(docs).collect()), key=repr) == expected(docs)


@pytest.mark.parametrize("fan, size", [(1024, 16 << 20), (3, 40_000)])
def test_hot_anchors_change_nothing(spark, sf, monkeypatch, fan, size):
    docs = brute.documents(spark, sf)
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(blocks.buckets, "__defaults__", (size,))
    real = S.hot_anchors

    def every_other(docs, id_col, text_col, length, n):
        buf, at = words.buffers(pa.array([r[0] for r in docs.select(text_col).limit(60).collect()], pa.string()))
        return np.unique(S.segments(buf, at, length)[0])[::2]

    monkeypatch.setattr(S, "HOT_SEEN", 2)
    assert 0 < len(real(docs, "doc_id", "text", 100, 4)) <= 4 * S.HOT_EACH
    monkeypatch.setattr(S, "hot_anchors", every_other)
    assert sorted(map(tuple, S.report(docs).collect()), key=repr) == expected(docs)


@pytest.mark.parametrize("wide", [S.WIDE, 2000])
def test_an_anchor_with_many_segments(spark, monkeypatch, wide):
    """One passage in every document, each time between other bytes: its windows are sent one by one."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(120)
    rows = [(i, text(150) + passage + text(150)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(S, "WIDE", wide)
    assert sorted(map(tuple, S.report(docs).collect()), key=repr) == expected(docs)


@pytest.mark.parametrize("length", [32, 300, 1000])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    piece = ["".join(rng.choice("abc ") for _ in range(length + 40)) for _ in range(4)]
    rows = [(i, rng.choice(piece) + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 500))) + rng.choice(piece)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.removed([(i, t.encode()) for i, t in sorted(rows)], length)
    assert [r.n_removed for r in S.report(docs, length=length).orderBy("doc_id").collect()] == [sum(g) for g in want]


def test_lengths_and_ids_out_of_range_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for length in (31, 40_000):
        with pytest.raises(ValueError, match="length"):
            S.report(docs, length=length)
    with pytest.raises(TypeError, match="integer"):
        S.report(docs.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_long_texts(spark):
    line = "the same line of text once more, and then again, with some words to make it long enough for a window\n"
    other = "".join(f"{i} " for i in range(700_000))
    docs = spark.createDataFrame([(1, line * 50_000), (2, other), (3, "x" + other)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in S.report(docs).collect()}
    n = len(line)
    assert got == {1: (n * 50_000, n * 49_999), 2: (len(other), 0), 3: (len(other) + 1, len(other))}


def test_dedup_keeps_rows_and_columns(spark, sf):
    docs = brute.documents(spark, sf)
    out = S.dedup(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    rows = sorted((r.doc_id if r.doc_id is not None else -(10**18), (r.text or "").encode()) for r in docs.collect())
    want = sorted((i if i > -(10**18) else None, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")) for (i, b), gone in zip(rows, brute.removed(rows), strict=True) if i > -(10**18))
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) == want


def test_empty_table(spark, sf):
    docs = brute.documents(spark, sf).limit(0)
    assert S.report(docs).count() == 0 and S.dedup(docs).count() == 0
