import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ferrule.llm import sentencepiece_scan as S
from ferrule.llm import token_output as O

from . import brute

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "'s", "'", "re", "'ll", " ", "  ", "\n", "\t", "1", "²", "é", "日", "!", "'d", "'Re", "👍", "don't", "''s", " 's", "\n's", "　", "the", "tion", "▁", "ing"]


def texts(n, seed=1, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)] + [None, "", "<|endoftext|>", "abcde" * 60]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|", "|endoftext|>", " <|endoftext|>\n\n<|endoftext|> don't"]


def test_encoder_gives_the_library_s_ids():
    t = Tokenizer.from_file(BPE)  # as it comes
    x = texts(4000) + SPECIAL + [random.Random(3).choice(SPECIAL).join(["the end", " of"] * k) for k in range(5)] + ["a" * 70 + " " + "b" * 64 + "c" * 65]
    encoder = O.Encoder(BPE)
    for part in (x, x[::-1], x[:50]):
        ids, n = encoder.encode(pa.array(part, pa.string()))
        want = [e.ids for e in t.encode_batch([y or "" for y in part], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert 50256 in ids.tolist() or 50256 in encoder.encode(pa.array(SPECIAL))[0].tolist()


def test_pieces_whose_hashes_agree_are_told_apart(monkeypatch):
    t = Tokenizer.from_file(BPE)
    real = O.words.span_hash
    monkeypatch.setattr(O.words, "span_hash", lambda s, a, b, which=0: (b - a).astype(np.uint64) * np.uint64(9))  # of equal length, of equal hash
    assert real is not O.words.span_hash
    x = ["abc xyz", "ab ba cd", "the The THE", "a b c d e f g", "日本 本日"] * 3
    ids, n = O.Encoder(BPE).encode(pa.array(x, pa.string()))
    assert ids.tolist() == [i for y in x for i in t.encode(y or "", add_special_tokens=False).ids]


@pytest.mark.parametrize("ids", [[], [0], [5] * 10, list(range(70000)), [2**24 + 7, 1, 2**24 + 7]])
def test_codes_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    if len(ids) and ids.max() > 10**6:
        ids = ids % 10**6
    p = O.pack(ids)
    assert (O.unpack(p["rank"], p["control"], p["data"], len(ids)) == ids).all()
    assert len(p["control"]) == -(-len(ids) // 4)


def test_frequent_ids_take_one_byte():
    p = O.pack(np.array([40000] * 1000 + list(range(300)), dtype=np.uint32))
    assert p["rank"][0] == 40000 and len(p["data"]) < 1000 + 300 * 2


def test_files_hold_every_document(spark, sf, tmp_path):
    docs = brute.documents(spark, sf)
    more = spark.createDataFrame([(2 * 10**8 + i, t) for i, t in enumerate([*SPECIAL, "long word text " * 400_000])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    library = Tokenizer.from_file(BPE)
    folder = f"file://{tmp_path}/tokens"
    O.write(docs, folder, BPE)
    got = sorted(map(tuple, O.digests(O.read(spark, folder)).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.select("doc_id", "text").collect()))
    want, start = [], 0
    for known, i, _, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        ids = [*ids, 0]
        want.append((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    (tmp_path / "tokens" / "shard-000000-left-over.tok").write_bytes(b"x")
    O.write(docs, folder, BPE)
    assert not (tmp_path / "tokens" / "shard-000000-left-over.tok").exists()
    with pytest.raises(TypeError, match="integer"):
        O.write(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), folder, BPE)
    O.write(docs.limit(0), f"{folder}0", BPE)
    assert O.read(spark, f"{folder}0").count() == 0


@pytest.fixture(params=[(16384, 4096), (100, 37), (20, 16)])
def model(request):
    return S.Model(PIECES, *request.param)


def test_scan_is_viterbi(model):
    score = {model.text[i]: (i, int(model.score[i])) for i in range(259, len(model.text))}
    x = texts(500, 2) + texts(40, 3, 300) + ["theinger" * 100, "word " * 900]
    ids, n, sums = model.encode(pa.array(x, pa.string()))
    k = 0
    for t, c, s in zip(x, n.tolist(), sums.tolist(), strict=True):
        assert (ids[k : k + c].tolist(), s) == brute.best_pieces(t, score, model.byte.tolist()), t
        k += c
    back, at = model.decode(ids, n)
    raw = back.tobytes()
    assert [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [(t or "").replace("▁", " ") for t in x]


def test_scan_agrees_with_the_library_s_lattice(spark, sf):
    """The library's best path, with the file's model type set to unigram, on texts without unknown characters."""
    data = bytearray(open(PIECES, "rb").read())
    set_unigram(data)
    sp = SentencePieceProcessor(model_proto=bytes(data))
    x = [w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect() for w in (r.text or "").replace("\n", " ")[:200].split() if w]
    m = S.Model.of(PIECES)
    ids, n, sums = m.encode(pa.array(x))
    k = 0
    for t, c, s in zip(x, n.tolist(), sums.tolist(), strict=True):
        best = sp.nbest_encode_as_ids(t, 3)[0]  # with 1 it takes a shortcut that doesn't always find the best path
        assert s == m.score[best].sum(), t
        k += c


def set_unigram(data: bytearray) -> None:
    def varint(i):
        x = s = 0
        while True:
            x |= (data[i] & 127) << s
            s += 7
            i += 1
            if data[i - 1] < 128:
                return x, i

    def skip(tag, i):
        if tag & 7 == 2:
            n, i = varint(i)
            return i + n
        return varint(i)[1] if tag & 7 == 0 else i + (4 if tag & 7 == 5 else 8)

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag >> 3 == 2 and tag & 7 == 2:
            n, i = varint(i)
            j = i
            while j < i + n:
                inner, j = varint(j)
                if inner >> 3 == 3:
                    data[j] = 1
                    return
                j = skip(inner, j)
        i = skip(tag, i)


def test_encode_and_decode_tables(spark, sf):
    docs = brute.documents(spark, sf)
    e = S.encode(docs, PIECES)
    rows = e.collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    back = {(r.doc_id, r.text) for r in S.decode(e, PIECES).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert S.report(S.encode(docs.limit(0), PIECES)).count() == 0


def test_chunks_of_giant_texts_give_the_result(spark):
    """Every chunk of a giant text yields a matrix, and matrices are combined: counted; a text of megabytes agrees with short ones."""
    m, made = S.Model(PIECES, 100, 37), []
    real = S.Chunk.matrix
    S.Chunk.matrix = lambda self: made.append(1) or real(self)
    try:
        text = "an ordinary text of words " * 20
        m.encode(pa.array([text]))
    finally:
        S.Chunk.matrix = real
    assert len(made) == len(m.marks(len(text) + 1)) + 1 == 14
    line = "some words that come again and again, 123 日本 "
    long = line * 60_000
    docs = spark.createDataFrame([(1, long), (2, "x" * 300_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in S.encode(docs, PIECES).collect()}
    ids = [list(m.encode(pa.array([t]))[0]) for t in (line, line * 2, line * 3)]
    assert all(r.round_trip for r in rows.values())
    step = len(ids[2]) - len(ids[1])
    assert len(rows[1].ids) == len(ids[1]) + 59_998 * step and list(rows[1].ids[: len(ids[1]) - 1]) == ids[1][:-1]
