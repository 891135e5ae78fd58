import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ferrule.llm import bpe

from . import brute
from .test_tokens import PARTS, SPECIAL, texts

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(FILE)


def plain(word, merges):
    """One word, the slow way: merge the least rank, the first of equal ones."""
    part = [int(merges.byte[b]) for b in word]
    while True:
        best = min(((merges.pair[p][0], i) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in merges.pair), default=None)
        if best is None:
            return part
        part[best[1] : best[1] + 2] = [merges.pair[part[best[1]], part[best[1] + 1]][1]]


def test_ids_and_texts_are_the_library_s(library, coder):
    x = texts(3000, 5) + SPECIAL + [random.Random(3).choice(SPECIAL).join(["the end", " of"] * k) for k in range(5)] + ["a" * 70 + " " + "b" * 64 + "c" * 65, "é" * 200, "日本語" * 90, "x" * 3000, "\0\x7f\xad ­", "   \n\n  "]
    for part in (x, x[::-1], x[:40]):
        ids, n = coder.encode(pa.array(part, pa.string()))
        want = [e.ids for e in library.encode_batch([y or "" for y in part], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert coder.decode(ids, n) == [library.decode(w, skip_special_tokens=False) for w in want] == [y or "" for y in part]


def test_rank_arrays_and_the_heap_give_the_same_parts(coder):
    rng = random.Random(8)
    for length in (1, 2, 3, 7, 20, 63):
        group = ["".join(rng.choice("abethinrs ot'") for _ in range(length)).encode() for _ in range(150)]
        got = coder.merges.solve(np.frombuffer(b"".join(group), np.uint8).reshape(-1, length))
        for w, ids in zip(group, got, strict=True):
            assert ids.tolist() == plain(w, coder.merges) == coder.merges.solve_long(w).tolist()
    for w in (b"a" * 501, b"ab" * 400, bytes(rng.randrange(256) for _ in range(900))):
        assert coder.merges.solve_long(w).tolist() == plain(w, coder.merges)


def test_a_table_of_merges_where_ties_and_order_matter():
    byte = bpe.byte_characters()
    vocabulary = {c: i for i, c in enumerate(byte)} | {"aa": 256, "ab": 257, "aaa": 258, "aab": 259}
    m = bpe.Merges(vocabulary, [("a", "a"), ("a", "b"), ("aa", "a"), ("a", "ab")])
    for w in (b"aaaa", b"aaab", b"aab", b"abab", b"b", b"aaaaab" * 9):
        group = np.frombuffer(w, np.uint8).reshape(1, -1)
        assert m.solve(group)[0].tolist() == plain(w, m) == m.solve_long(w).tolist()
    assert sorted(byte) == sorted(set(byte)) and byte[0x20] == "Ġ" and byte[ord("a")] == "a"


def test_ids_that_are_no_text_decode_like_the_library(library, coder):
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) if rng.random() < 0.4 else rng.randrange(256) for _ in range(rng.randrange(12))]
        assert coder.decode(np.array(ids, np.uint32), np.array([len(ids)])) == [library.decode(ids, skip_special_tokens=False)]
    with pytest.raises(IndexError):
        coder.decode(np.array([50257], np.uint32), np.array([1]))


def test_documents(spark, sf, library):
    docs = brute.documents(spark, sf)
    more = spark.createDataFrame([(2 * 10**8 + i, t) for i, t in enumerate([*SPECIAL, "long word text " * 200_000, "y" * 300_000, "".join(PARTS) * 3000])], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    got = sorted(((r.doc_id is not None, *r) for r in bpe.report(docs, FILE).collect()), key=repr)
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i is not None, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.report(docs.limit(0), FILE).count() == 0


def test_encode_then_decode(spark):
    rows = [("a", "the <|endoftext|> end"), ("b", None), (None, ""), ("a", "don't stop 日本"), ("a", "don't stop 日本")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "key string, body string, ids int")
    coded = bpe.encode(docs, FILE, "key", "body")
    back = bpe.decode(coded, FILE)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "doc_id int, ids array<int>").coalesce(1)
    assert sorted(map(tuple, bpe.decode(odd, FILE).collect())) == [(1, None), (2, ""), (3, "Hello")]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Coder(P.path("word_bpe_49k.json"))
