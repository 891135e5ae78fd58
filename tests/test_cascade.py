from pyspark.sql import functions as F

from ferrule.engine import Engine, bm25_channel
from ferrule.operators import cascade as C
from ferrule.operators import retrieve as R


def test_later_branches_read_what_is_left(spark):
    q = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "query_id long, query string")
    told = []
    got = C.cascade(q, [
        ("even", lambda x: x.where("query_id % 2 = 0").withColumn("answer", F.lit("e"))), ("three", lambda x: x.where("query_id % 3 = 0").withColumn("answer", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit(None))))),
        ("rest", lambda x: x.where("query_id < 8").withColumn("answer", F.col("query"))), ("none", lambda x: x.withColumn("answer", F.lit(None).cast("string"))),
    ], on_branch=lambda *x: told.append(x))
    assert told == [("even", 10, 5), ("three", 5, 2), ("rest", 3, 3)]  # none is left: the last branch doesn't run
    assert {r.query_id: (r.branch, r.answer) for r in got.collect()} == {i: ("even", "e") if i % 2 == 0 else ("three", "a") if i % 3 == 0 else ("rest", f"t{i}") for i in range(10)}
    assert C.cascade(q.limit(0), [("x", lambda x: x.withColumn("answer", F.lit("y")))]).collect() == []
    assert [r.branch for r in C.cascade(q.limit(1), []).collect()] == [None]


QUESTIONS = [(1, "What is BrightLeaf?", "definition"), (2, "Who is the head of department of physics?", "fact"), (3, "How many rooms are there?", "fact"), (4, "Explain BrightLeaf", "explanation"), (5, "What is nothing known?", "definition"), (6, "who is Ann Lee", "fact")]
EVIDENCE = [
    (1, 1, "Figure 3 shows it", 0.9, "vector"), (1, 2, "BrightLeaf is a tool for patient care.", 0.5, "vector"), (2, 1, "The department has Dr. Omar Haddad as guest.", 0.9, "vector"), (2, 2, "Dr. Anna Berg is the Head of the Department.", 0.4, "structured"), (3, 1, "There are 12 rooms in the house.", 0.7, "vector"),
    (4, 1, "BrightLeaf is a tool for patient care.", 0.9, "vector"),
]


def test_direct_answers_by_branch(spark):
    q = spark.createDataFrame(QUESTIONS, "query_id long, query string, question_type string")
    e = spark.createDataFrame(EVIDENCE, "query_id long, rank int, sentence string, score double, match_type string")
    facts = spark.createDataFrame([(5, "Thing", "is known", 0.9), (5, "Other", "isn't", 0.2), (4, "BrightLeaf", "is not asked", 0.9)], "query_id long, entity string, fact string, score double")
    people = spark.createDataFrame([("Ann Lee", "Librarian", "archive")], "name string, designation string, department string")
    read = {}
    got = {r.query_id: (r.branch, r.answer) for r in C.direct_answers(q, e, facts, people, on_branch=lambda n, a, b: read.update({n: (a, b)})).collect()}
    assert got == {
        1: ("definition", "BrightLeaf is a tool for patient care."), 2: ("role", "Head of Department: Dr. Anna Berg"), 3: ("fact", "There are 12 rooms in the house."), 4: (None, None), 5: ("graph", "Thing: is known"), 6: ("profile", "Ann Lee is Librarian in the archive."),
    }
    assert [read[k][0] for k in ("definition", "profile", "role", "fact", "graph")] == [6, 5, 4, 3, 2]


TEXTS = [(1, "BrightLeaf is a tool for patient care. It stores records.", "guide", "en"), (2, "The attendance rule asks for eighty days.", "handbook", "Regulation"), (3, "The attendance rule of BrightLeaf is a joke.", "jokes", "en"), (4, "Rooms are open at nine.", "house", "en")]


def test_history_category_and_branches_in_answers(spark):
    engine = Engine.of_documents(spark.createDataFrame(TEXTS, "doc_id long, text string, source string, lang string"))
    q = spark.createDataFrame([(1, "How does it work?"), (2, "attendance rule of BrightLeaf"), (3, "What is BrightLeaf?")], "query_id long, query string")
    history = spark.createDataFrame([(1, 0, "user", "What is BrightLeaf?"), (1, 1, "assistant", "A tool."), (2, 0, "user", "Hello")], "query_id long, turn int, role string, text string")
    plan = {r.query_id: r for r in engine.plan(q, history).collect()}
    assert plan[1].note == "Follow-up to: What is BrightLeaf?" and "BrightLeaf" in plan[1].query and plan[2].note is None and plan[2].category_filter == "Regulation"
    hits = {(r.query_id, r.title) for r in engine.retrieve(q, history=history).collect()}
    assert (1, "guide") in hits and {t for i, t in hits if i == 2} == {"handbook"}  # the joke is of another category
    got = {r.query_id: r for r in engine.respond(q, history=history).collect()}
    assert got[3].branch == "definition" and got[3].answer.startswith("BrightLeaf is a tool") and got[2].sources == "handbook"
    assert engine.branches["definition"][0] == 3 and all(a >= b for a, b in engine.branches.values())


def test_answer_order_prefers_what_answers(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9, 0.9, "plain"), (1, "b", 2, 0.5, 0.5, "gives"), (1, "c", 3, 0.5, 0.6, "plain")], "query_id long, chunk_id string, rank int, score double, reranker_score double, text string")
    got = R.answer_order(hits, F.when(F.col("text") == "gives", 1.0).otherwise(0.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]


def test_a_channel_gives_only_what_is_meant(spark):
    chunks = spark.createDataFrame([(str(i), f"word{i % 3} common", "t", "x") for i in range(9)], "chunk_id string, text string, title string, category string")
    q = spark.createDataFrame([(1, "word1")], "query_id long, query string")
    among = spark.createDataFrame([("4",), ("0",)], "chunk_id string")
    assert [r.chunk_id for r in bm25_channel(chunks, q, among=among).collect()] == ["4"]
