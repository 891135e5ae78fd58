import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule import params
from ferrule.functions import block_search as S
from ferrule.operators import index as X
from ferrule.operators import retrieve as R

WORDS = [f"word{i}" for i in range(40)] + ["a", "b12", "42"]


def texts(n, seed=0, longest=30):
    rng = random.Random(seed)
    weight = [1 / (k + 1) for k in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weight, k=rng.randrange(longest)))) for i in range(n)]


def best(docs, questions, k):
    """(question, id, score, rank) by plain BM25."""
    tf = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / max(1, len(tf))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: params.BM25_EPSILON * sum(raw.values()) / len(raw) if r < 0 else r for w, r in raw.items()}
    out = []
    for q, t in questions:
        found = []
        for i, c in tf.items():
            s = sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in Counter(t.split()).items() if w in c)
            if round(s, 6) > 0:
                found.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frames(spark, docs, questions):
    return spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(questions, "q long, t string")


def same(got, want):
    return [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)


def asked(index, q, k=5, **more):
    return sorted(map(tuple, index.bm25(q, "q", F.col("t"), k, **more).select("q", "id", "score", "rank").collect()))


def test_generations_equal_whole_builds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_DOCS", 16)
    folder = f"file://{tmp_path}/index"
    docs, questions = texts(150), texts(12, 1)
    d, q = frames(spark, docs, questions)
    first = X.KeywordIndex.build(d, folder, "id", F.col("text"))
    assert first.number == 1 and same(asked(first, q), best(docs, questions, 5))
    # two replaced, two new ones, three gone
    more = [(3, "word1 word1 word39"), (77, ""), (1000, "word39 word2"), (1001, "new words only")]
    second = first.add(spark.createDataFrame(more, "id long, text string"), "id", F.col("text"))
    third = second.remove(spark.createDataFrame([(5,), (6,), (1000,)], "x long"), "x")
    now = {**dict(docs), **dict(more)}
    assert same(asked(second, q), best(sorted(now.items()), questions, 5))
    for i in (5, 6, 1000):
        del now[i]
    assert same(asked(third, q), best(sorted(now.items()), questions, 5))
    assert sorted(r.id for r in third.documents().collect()) == sorted(now)
    assert same(asked(first, q), best(docs, questions, 5))  # a reader keeps the generation that it opened
    assert X.KeywordIndex.open(spark, folder).number == 3
    third.prune(keep=1)
    assert same(asked(X.KeywordIndex.open(spark, folder), q), best(sorted(now.items()), questions, 5))
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("manifest")]) == 1


def test_a_failed_build_leaves_the_last_index(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    docs, questions = texts(40), texts(5, 1)
    d, q = frames(spark, docs, questions)
    X.KeywordIndex.build(d, folder, "id", F.col("text"))
    with pytest.raises(Exception, match="stop here"):
        X.KeywordIndex.build(d.withColumn("text", F.raise_error(F.lit("stop here")).cast("string")), folder, "id", F.col("text"))
    index = X.KeywordIndex.open(spark, folder)
    assert index.number == 1 and same(asked(index, q), best(docs, questions, 5))
    files = X.session.Files(spark, folder)
    with pytest.raises(Exception, match="exist"):
        files.create("manifest-00000001.json", "{}")  # of two writers one wins
    assert X.KeywordIndex.open(spark, f"file://{tmp_path}/none") is None


def test_slices_chunks_filter_and_empty_cases(spark, tmp_path, monkeypatch):
    docs, questions = texts(90, 4), [*texts(30, 5), (900, ""), (901, None), (902, "unseen")]
    d, q = frames(spark, docs, questions)
    monkeypatch.setattr(X, "CHUNK", 4)
    monkeypatch.setattr(X, "QUESTION_BYTES", 20_000)
    index = X.KeywordIndex.build(d, f"file://{tmp_path}/a", "id", F.col("text"))
    want = best(docs, [(i, t or "") for i, t in questions], 5)
    assert same(asked(index, q), want)
    even = spark.createDataFrame([(i,) for i in range(0, 90, 2)], "x long")
    every = best(docs, [(i, t or "") for i, t in questions], 1000)
    kept = {}
    for r in sorted(every, key=lambda r: (r[0], r[3])):
        if r[1] % 2 == 0 and len(kept.setdefault(r[0], [])) < 5:
            kept[r[0]].append((*r[:3], len(kept[r[0]]) + 1))
    assert same(asked(index, q, among=even), sorted(r for rows in kept.values() for r in rows))
    none = X.KeywordIndex.build(d.limit(0), f"file://{tmp_path}/b", "id", F.col("text"))
    assert asked(none, q) == [] == asked(index, q.limit(0))


def test_the_same_files_are_indexed_once(spark, tmp_path):
    docs, _ = frames(spark, texts(20), [])
    docs.write.parquet(f"file://{tmp_path}/t")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/t")
    one = X.KeywordIndex.of(read(), "id", F.col("text"))
    assert X.KeywordIndex.of(read(), "id", F.col("text")).folder == one.folder != X.KeywordIndex.of(read(), "id", F.lower("text"), F.lit("x")).folder
    docs.limit(3).write.mode("append").parquet(f"file://{tmp_path}/t")
    assert X.KeywordIndex.of(read(), "id", F.col("text")).folder != one.folder
    assert X.fingerprint(docs) is None


def block(docs, titles=None):
    ids = pa.array([i for i, _ in docs])
    made = S.make(ids, pa.array([t for _, t in docs], pa.string()), pa.array(titles or [None] * len(docs), pa.string()))
    return S.Block({k: v if isinstance(v, pa.Array) else np.asarray(v, dtype=np.int64) for k, v in made.items()})


def test_blocks_below_the_threshold_are_passed_over():
    rng = random.Random(2)
    blocks = [block([(100 * b + i, " ".join(rng.choices(WORDS[:20], k=12)) + (" rare rare" if b == 0 else "")) for i in range(30)]) for b in range(10)]
    question = {"id": [0], "words": pa.array(["rare", "word1"]), "word": np.array([0, 1]), "first": np.array([0, 2]), "weight": np.array([5.0, 0.3])}
    search = S.Bm25(question, 10, 1.5, 0.75, 12.0)
    hits = [(b, len(p)) for b, x in enumerate(blocks) for _, p, _ in search.of(x)]
    assert search.passed == 9 and search.read == 1 and hits[0][0] == 0 and len(hits) == 1
    other = S.Bm25({**question, "weight": np.array([0.0, 0.3])}, 10, 1.5, 0.75, 12.0)
    assert sum(len(p) for x in blocks for _, p, _ in other.of(x)) >= 10 and other.read > 1


def test_terms_that_hold_a_word_and_needles():
    docs = [(1, "database systems"), (2, "data base"), (3, "xdata basey atabas"), (4, None), (5, "data"), (6, "basesystems of data")]
    b = block(docs, ["t", None, "data base", "database systems", None, ""])
    assert sorted(b.terms.to_pylist()[t] for t in b.containing("ata")) == ["atabas", "data", "database", "xdata"]
    assert b.containing("zzz").tolist() == []
    got = b.holding(["database", "databasesystems", "basesystemsofdata", "nothinglikeit"])
    tight = ["".join(b.targets(np.array([k]))[0].split()) for k in range(6)]
    assert [g.tolist() for g in got] == [[k for k, t in enumerate(tight) if w in t] for w in ("database", "databasesystems", "basesystemsofdata", "nothinglikeit")]
    assert got[0].tolist() == [0, 1, 2, 3] and got[1].tolist() == [0, 3]


def test_blocked_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[10:20] = x[5]
    monkeypatch.setattr(R, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(R, "VECTOR_CHUNK", 3)
    monkeypatch.setattr(R, "VECTOR_BYTES", 300)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 60, 5)] + [(901, None), (902, [0.5, 0.5])], "q long, qv array<double>")
    got = {}
    for r in R.vector_topk(d, q, "id", "v", "q", "qv", 4).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.score))
    for i in range(0, 60, 5):
        s = np.round(np.clip((x @ x[i] + 1) / 2, 0, 1), 6)
        want = sorted(range(300), key=lambda j: (-s[j], j))[:4]
        assert [j for _, j, _ in sorted(got[i])] == want and np.allclose([v for _, _, v in sorted(got[i])], s[want], atol=1e-9)
    assert got[902] == [(1, 902, 1.0)] and 901 not in got
    assert "Cartesian" not in R.vector_topk(d, q, "id", "v", "q", "qv", 4)._jdf.queryExecution().executedPlan().toString()


def test_row_groups_of_blocks_are_small(spark, tmp_path, monkeypatch):
    """A reader holds whole row groups, so they don't grow with the index."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(X, "ROW_GROUP", 1 << 17)
    docs = spark.range(0, 960, numPartitions=1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), k -> concat('w', hash(id, k)))) AS text")
    X.KeywordIndex.build(docs, f"file://{tmp_path}/x", "doc_id", F.col("text"))
    groups = [m.row_group(g) for f in tmp_path.glob("x/segment-*/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert len(groups) > 1
    assert all(g.num_rows == 1 for g in groups)  # each block is larger than a row group's bytes


def test_searchable_bytes_are_sparks(spark):
    from ferrule.functions import text as T

    texts = ["AKBİC", "café \U0001f600xßΣ", "tab\tline\nfeed\x0bform\x0c\r\x00\x7f  end", "", None, "Plain ASCII-text, 42!", "ǅẞÅ"]
    got = S.searchable(pa.array(texts, pa.string())).to_pylist()
    want = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.when(F.col("t").isNotNull(), T.searchable(F.col("t")))).collect()
    assert got == [r[0] for r in want]


def test_blocks_hold_only_what_cant_be_told_from_the_rest(spark, tmp_path):
    """What is written follows the texts and stays below them, with titles and postings."""
    docs = spark.range(0, 600, numPartitions=2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), k -> concat('w', abs(hash(id, k)) % 5000))) AS text", "concat('t', id % 7) AS title")
    X.KeywordIndex.build(docs, f"file://{tmp_path}/x", "doc_id", F.col("text"), F.col("title"))
    files = list(tmp_path.glob("x/segment-*/*.parquet"))
    assert sum(f.stat().st_size for f in files) < 0.85 * docs.agg(F.sum(F.length("text"))).first()[0]


def test_what_a_block_tells_from_its_postings():
    b = block([(1, "red fox"), (2, "fox fox den"), (3, None)], ["fox hill", None, "red"])
    at, place = b.anywhere
    assert {t: place[at[k] : at[k + 1]].tolist() for k, t in enumerate(b.terms.to_pylist())} == {"red": [0, 2], "fox": [0, 1], "den": [1], "hill": [0]}
    assert [b.terms[t].as_py() for t in b.containing("hil")] == ["hill"]
    none = block([])
    assert [x.tolist() for x in none.anywhere] == [[0], []]


def test_words_of_a_chunk_are_counted_where_it_is_read(spark, monkeypatch):
    monkeypatch.setattr(S, "WORD_BYTES", 9)
    d = spark.createDataFrame([(1, "Red fox, red"), (2, None), (3, "  "), (4, "den"), (4, "fox den 42"), (5, "a\tb A")], "id long, t string").repartition(2)
    got = sorted(map(tuple, R.postings(d, "id", F.col("t")).collect()))
    assert got == [(1, "fox", 1, 3), (1, "red", 2, 3), (4, "42", 1, 4), (4, "den", 2, 4), (4, "fox", 1, 4), (5, "a", 2, 3), (5, "b", 1, 3)]
    assert "Exchange hashpartitioning" not in R.postings(d.where("id <> 4"), "id", F.col("t"))._jdf.queryExecution().executedPlan().toString()


def test_an_index_for_bm25_alone_holds_no_texts(spark, tmp_path, monkeypatch):
    built, write = [], X.KeywordIndex._write
    monkeypatch.setattr(X.KeywordIndex, "_write", staticmethod(lambda picked, folder, *more: built.append(write(picked, folder, *more)) or built[-1]))
    docs = spark.range(0, 600, numPartitions=2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), k -> concat('w', abs(hash(id, k)) % 5000))) AS text")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"), F.substring("text", 1, 60).alias("t"))
    rows = lambda **more: sorted(map(tuple, R.bm25(docs, q, "doc_id", F.col("text"), "q", F.col("t"), 5, **more).collect()))
    assert rows() == rows(title=F.lit("w1 title"))
    alone, both = (spark.read.format("binaryFile").load(b["folder"]).agg(F.sum("length")).first()[0] for b in built)
    assert alone < 0.55 * both


def test_the_whole_ladder_is_one_pass_over_the_documents(spark, monkeypatch):
    """Every pair, as the rules have it, in chunks and slices of any size, with nothing stored and no word looked for by itself."""
    rng = random.Random(5)
    word = lambda: rng.choice(("rain", "map", "rainmap", "brain", "maps", "the", "it", "training", "mapped", "xx", "9th", "sun"))
    line = lambda n: rng.choice((" ", "  ", "-", "\n")).join(word() for _ in range(rng.randrange(n))) or None
    docs = [(i, line(7), line(3)) for i in range(120)] + [(200, "so-rain map", None), (201, "strain maps", "x"), (202, None, "rainmaps it"), (203, "", "")]
    asked = [(i, line(5)) for i in range(40)] + [(50, "rain maps"), (51, "rain"), (52, "the it"), (53, ""), (54, None), (55, "rain map sun")]
    d, q = spark.createDataFrame(docs, "id long, text string, title string"), spark.createDataFrame(asked, "qid long, q string")

    low = lambda x: "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in (x or "").lower())
    padded = lambda x: " " + "".join(" " if c.isspace() else c for c in x) + " "
    expected = {}
    for i, x in asked:
        k = [w for w in dict.fromkeys(low(x).split()) if len(w) >= 3 and w not in params.STOPWORDS]
        form, phrase = "".join(k) if len(k) > 1 and len("".join(k)) >= params.COMPACT_LENGTH else None, low(x).strip(" ")
        for j, text, title in docs:
            whole = low(" ".join(t for t in (text, title) if t is not None))
            n, part = sum(f" {w} " in padded(whole) for w in k), sum(w in whole for w in k)
            score = 0
            if k and phrase and f" {phrase} " in padded(whole):
                score = 1
            elif form and form in "".join(whole.split()):
                score = 0.84
            elif n:
                score = min(1, 0.75 + n / len(k) * 0.2)
            elif k and phrase and phrase in whole:
                score = 0.72
            elif part:
                score = min(1, 0.52 + part / len(k) * 0.16)
            named = sum(f" {w} " in padded(low(title)) for w in k) + (form is not None and form in "".join(low(title).split()))
            titled = min(1, 0.35 + named / (len(k) + (form is not None)) * 0.45) if named else 0
            if score or titled:
                expected[i, j] = (round(score, 6), round(titled, 6))
    assert {0.84, 0.72, 1} < {s for s, _ in expected.values()}

    def fail(*a, **k):
        raise AssertionError

    monkeypatch.setattr(X.KeywordIndex, "of", fail)
    for chunk, size, near, rows in ((256, 32 << 20, 8 << 20, 512), (7, 2000, 300, 16)):
        for where, name, value in ((X, "CHUNK", chunk), (X, "QUESTION_BYTES", size), (S, "NEAR", near), (X, "BLOCK_DOCS", rows)):
            monkeypatch.setattr(where, name, value, raising=False)
        got = R.lexical(d, q, "id", F.col("text"), F.col("title"), "qid", F.col("q")).collect()
        assert {(r.qid, r.id): (r.keyword_score, r.title_score) for r in got} == expected and len(got) == len(expected)


def test_the_ladder_meets_all_words_in_one_pass(monkeypatch):
    block = S.Block(S.make(pa.array([1, 2, 3]), pa.array(["rainmaps it", "training", "sun"]), pa.array(["", None, "brain"])))
    monkeypatch.setattr(S.Block, "containing", None)
    for near in (1, 8 << 20):
        monkeypatch.setattr(S, "NEAR", near, raising=False)
        words = {"id": range(2), "words": pa.array(["rain", "map", "sun"]), "word": np.array([0, 1, 2, 0]), "first": np.array([0, 2, 4]), "form": [None, None], "phrase": ["rain map", "sun rain"]}
        got = {(i, p): round(s, 6) for i, places, scores, _ in S.Ladder(words, None, True).of(block) for p, s in zip(places.tolist(), scores.tolist(), strict=True)}
        assert got == {(0, 0): 0.68, (0, 1): 0.6, (0, 2): 0.6, (1, 0): 0.6, (1, 1): 0.6, (1, 2): 0.85}
