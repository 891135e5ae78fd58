"""Work that must not grow faster than its input: expressions tell their parts once, and no join holds every row against every other."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.functions import block_search as S
from ferrule.functions import rules as L
from ferrule.functions import text as T
from ferrule.operators import answers as A
from ferrule.operators import graph as G
from ferrule.operators import index as X
from ferrule.operators import retrieve as R
from ferrule.plans import graph_queries, retrieval_queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("f", "pattern", "most"), [
    (lambda a, b: L.definition_score(a, b), "[^a-z0-9]+", 4), (lambda a, b: L.definition_score(a, b), r"(?U)\s+", 1), (lambda a, b: L.is_low_value(a), r"(?U)\s+", 1), (lambda a, b: L.is_incomplete(a), r"(?U)\s+", 1), (lambda a, b: L.is_heading(a), r"(?U)\s+", 1),
    (lambda a, b: T.without_intent(a), r"(?U)\s+", 1), (lambda a, b: A.extracted(a, b), r"([0-9])(?=[A-Za-z])", 1), (lambda a, b: A.answer_bonus(a, F.lit("definition"), F.array(F.lit("x")), F.lit("t"), b), "[^a-z0-9]+", 8),
])
def test_an_expression_tells_its_parts_once(spark, f, pattern, most):
    told = plan(spark.createDataFrame([("a", "b")], "a string, b string").select(f(F.col("a"), F.col("b")).alias("v")))
    assert 0 < told.count(pattern) <= most


def test_texts_that_hold_a_question_are_found_without_holding_all_against_all(spark):
    docs = spark.createDataFrame([(1, "Xthe red fox RANy home"), (2, "red fox the ran"), (3, None), (4, "the red   fox ran"), (5, "fo"), (6, "Foxes, the Red.Fox ran")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "The red fox ran"), (2, "fo"), (3, ""), (4, None), (5, "the Red.Fox ran"), (6, "unknown red fox ran")], "item_id long, q string")
    of = lambda q: R.containing(docs, q, "doc_id", F.col("text"), "item_id", F.col("q"))
    assert sorted(map(tuple, of(asked).collect())) == [(1, 1), (2, 1), (2, 2), (2, 4), (2, 5), (2, 6), (5, 6)]
    physical = of(asked.where("item_id <> 2"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_nodes_that_many_seeds_reach_are_gone_on_from_once(spark):
    t = spark.createDataFrame([*[(f"s{k}", "to", "hub", True) for k in range(20)], *[("hub", "to", f"x{k}", True) for k in range(20)], ("x1", "to", "s1", True), ("x2", "is", "value", False)], "s string, p string, o string, o_is_uri boolean")
    seeds = spark.createDataFrame([(f"s{k}",) for k in range(20)], "seed string")
    got = dict(map(tuple, G.reach(t, seeds, 3).collect()))
    assert got == {f"s{k}": 0 for k in range(20)} | {"hub": 1} | {f"x{k}": 2 for k in range(20)}
    assert G.reach(t, seeds, 3).count() == 41 and G.reach(t, seeds, 0).count() == 20


def test_a_misspelt_word_is_looked_at_once_for_all_who_have_it(spark):
    df = graph_queries.fuzzy_term_fix(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan(df) and df.count() == 150


def test_labels_of_all_nodes_are_not_broadcast(spark, sf):
    told = graph_queries.kg_entity_facts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in told and "Broadcast" not in told


def test_both_keyword_channels_search_one_index(spark, sf, monkeypatch):
    built, write = [], X.KeywordIndex._write
    monkeypatch.setattr(X, "FORMAT", "as none is stored")
    monkeypatch.setattr(X.KeywordIndex, "_write", staticmethod(lambda picked, folder, *more: built.append(folder) or write(picked, folder, *more)))
    retrieval_queries.channels(spark, sf)
    assert len(built) == 1


def test_the_dense_channel_is_one_python_pass_over_the_documents(spark, sf):
    told = plan(retrieval_queries.dense_channel(spark, sf))
    assert told.count("MapInArrow") == 1 and "EvalPython" not in told


def test_letters_are_counted_in_pieces(monkeypatch):
    texts = ["Abba", None, "", "12 z" * 9, "\u212aelvin \u0130", "xyz", "\xe9"]
    monkeypatch.setattr(S, "LETTER_BYTES", 5)
    for got, t in zip(S.letter_profile(pa.array(texts, pa.string())).to_pylist(), texts, strict=True):
        n = [(t or "").lower().count(chr(97 + k)) for k in range(26)]
        norm = sum(x * x for x in n) ** 0.5
        assert got == [x / norm if norm else 0.0 for x in n]


def test_vectors_are_searched_by_one_python_worker_a_task(spark, sf):
    told = plan(retrieval_queries.vector_topk(spark, sf))
    assert told.count("MapInArrow") == 1 and "EvalPython" not in told
