import pytest
from pyspark.sql import functions as F

from ferrule.engine import Engine, bm25_channel, lexical_channel, vector_channel
from ferrule.functions.python_udfs import hashing_encoder

TEXTS = [
    (1, "BrightLeaf is a tool for patient care. It stores records.", "guide", "en"), (2, "We thank our teachers. Figure 3 shows a tree", "thanks", "en"), (3, "The library opens at nine. Students borrow books there.", "library", "en"), (4, None, "empty", "en"), (5, "Un texte sur la bibliothèque.", "fr", "fr"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.of_documents(spark.createDataFrame(TEXTS, "doc_id long, text string, source string, lang string"))


def asked(spark):
    return spark.createDataFrame([(1, "Can you explain BrightLeaf?"), (2, "when does the library open"), (3, "zebra"), (4, ""), (5, None)], "query_id long, query string")


def test_answers_and_refusals(spark, engine):
    got = {r.query_id: r for r in engine.answer(asked(spark)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1].answer.startswith("BrightLeaf is a tool") and got[1].sources == "guide" and got[1].status != "refused"
    assert "library" in got[2].answer.lower()
    assert all(got[k].status == "refused" and not got[k].answer for k in (3, 4, 5))


def test_a_spaced_name_finds_the_joined_one(spark, engine):
    q = spark.createDataFrame([(1, "bright leaf")], "query_id long, query string")
    assert engine.retrieve(q).first().title == "guide"


def test_vector_channel_and_evaluation(spark, engine):
    encode = hashing_encoder()
    chunks = engine.chunks.withColumn("embedding", encode("text"))
    e = Engine(chunks, channels=[bm25_channel, lexical_channel, vector_channel(encode)])
    truth = chunks.where("title = 'library'").select(F.lit(2).cast("long").alias("query_id"), "chunk_id")
    m = e.evaluate(asked(spark), truth).first()
    assert m.n == 1 and m.recall3 == 1.0 and m.mrr == 1.0
    assert e.readiness().first().state == "ready"


def test_graph_query(spark):
    t = spark.createDataFrame([("d1", "label", "Physics", False), ("c1", "label", "Optics", False), ("c1", "taught_in", "d1", True), ("p1", "label", "Ann", False), ("p1", "teaches", "c1", True)], "s string, p string, o string, o_is_uri boolean")
    got = Engine(t.limit(0), t).graph_query(spark.createDataFrame([("p1",)], "seed string")).collect()
    assert {(r.node, r.fact, r.score) for r in got} == {("p1", "Teaches: Optics", 0.94), ("c1", "Taught in: Physics", 0.94)}
