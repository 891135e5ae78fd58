import difflib

from ferrule.engine import Engine
from ferrule.operators import measure as M


def test_ranks_by_containment_and_ratio(spark):
    hits = [(1, 1, "Nothing of it"), (1, 2, "The library opens at nine. Bring a card."), (2, 1, "library"), (3, 1, "The librarry opens at nin"), (3, 2, "the library opens at nine"), (4, 1, "far"), (5, 1, None), (5, 2, "")]
    targets = [(1, "the library  opens at nine"), (2, "The library opens"), (3, "the library opens at nine"), (4, "the library opens at nine"), (4, None), (5, "x")]
    got = M.match_ranks(spark.createDataFrame(hits, "query_id long, rank int, text string"), spark.createDataFrame(targets, "query_id long, target string"))
    plain = {}
    for q, r, h in sorted(hits, key=lambda x: x[1]):
        c = " ".join((h or "").lower().split())
        for p, t in targets:
            g = " ".join((t or "").lower().split())
            if p == q and c and g and (g in c or c in g or difflib.SequenceMatcher(None, c, g).ratio() >= 0.72):
                plain.setdefault(q, r)
    assert {r.query_id: r.match_rank for r in got.collect()} == plain == {1: 2, 2: 1, 3: 1}


def test_metrics_of_an_engine(spark):
    texts = [(1, "The library opens at nine. Students borrow books there.", "library", "en"), (2, "Rain falls on the quiet hills of the north.", "rain", "en")]
    engine = Engine.of_documents(spark.createDataFrame(texts, "doc_id long, text string, source string, lang string"))
    q = spark.createDataFrame([(1, "when does the library open"), (2, "zebra")], "query_id long, query string")
    truth = spark.createDataFrame([(1, "The library opens at nine.", None), (2, "A zebra is striped.", ["zebra text"])], "query_id long, ground_truth string, context array<string>")
    details, row = engine.judged(q, truth)
    got = {r.query_id: r for r in details.collect()}
    assert got[1].match_rank == 1 and got[1].answer_correctness == 1.0 and not got[1].hallucinated and got[2].match_rank is None and got[2].status == "refused" and not got[2].hallucinated
    m = row.first()
    assert (m.samples, m.recall3, m.mrr10, m.hallucination_rate) == (2, 0.5, 0.5, 0.0)
    assert engine.rows["plan"] == 2 and engine.rows["details"] == 2 and engine.rows["evidence"] >= 1
    assert M.summary(details.limit(0)).first().samples == 0


def test_words_that_no_hit_has_are_made_up(spark):
    hits = spark.createDataFrame([(1, 1, "rain falls on hills")], "query_id long, rank int, text string")
    answers = spark.createDataFrame([(1, "complete", "Dragons fall on hills."), (2, "complete", "")], "query_id long, status string, answer string")
    truth = spark.createDataFrame([(1, "rain falls", None), (2, "", None)], "query_id long, ground_truth string, context array<string>")
    got = {r.query_id: (r.hallucinated, r.answer_correctness > 0) for r in M.details(hits, answers, truth).collect()}
    assert got == {1: (True, True), 2: (False, False)}
