import corpus_pipeline as C
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from ferrule.llm import crf
from ferrule.llm import sentencepiece_scan as S

from . import brute


def test_run_is_the_brute_force_composition(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.collect()
    quality = crf.qualities(pa.array([r.text for r in rows], pa.string()), *crf.fit(docs, labels))
    texts = {r.doc_id: r.text for r, q in zip(rows, quality, strict=True) if q >= crf.GOOD}
    classes = brute.near_classes(texts)
    left = sorted((i, (texts[i] or "").encode()) for i in texts if classes[i] == i)
    cut = {i: bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") for (i, b), gone in zip(left, brute.removed(left), strict=True)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: t for i, t in cut.items() if brute.contaminated(t, items)[1] == 0}
    got = {r.doc_id: (list(r.ids), r.round_trip) for r in C.run(spark, sf).collect()}
    assert got.keys() == clean.keys()
    m = S.Model.of(P.path("piece_bpe_32k.model"))
    ids, n, _ = m.encode(pa.array([clean[i] for i in sorted(clean)], pa.string()))
    k = 0
    for i, c in zip(sorted(clean), n.tolist(), strict=True):
        assert got[i] == (ids[k : k + c].tolist(), True)
        k += c


def test_stages_keep_columns_and_take_awkward_rows(spark, sf, tmp_path):
    extra = [(10**7 + i, t, None, None, None) for i, t in enumerate(brute.AWKWARD)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("bucket", F.lit(1)).withColumn("_text", F.lit("x"))
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminated", "token_ids"]
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        if name != "token_ids":
            assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0 < docs.count() <= before.count()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0
