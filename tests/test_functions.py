import pytest
from pyspark.sql import functions as F

from ferrule.functions import python_udfs
from ferrule.functions import rules as L
from ferrule.functions import text as T
from ferrule.operators import docs as D


def value(spark, x, column):
    return spark.createDataFrame([(x,)], "x string").select(column(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize(("question", "intent"), [
    ("Define entropy", "DEFINITION"), ("the meaning of tides", "DEFINITION"), ("what is a fjord", "DEFINITION"), ("Describe a volcano", "GENERAL"), ("Summary of chapter two", "GENERAL"), ("how do bees dance", "GENERAL"),
    ("Compare oak with ash", "COMPARISON"), ("any difference in price", "COMPARISON"), ("Who is the hod of music", "FACULTY_INFO"), ("credit for this lab", "COURSE_INFO"), ("the attendance rule", "REGULATION"), ("tea", "GENERAL"), (None, "GENERAL"), ("", "GENERAL"),
])
def test_intent(spark, question, intent):
    assert value(spark, question, T.intent) == intent


@pytest.mark.parametrize(("f", "x", "want"), [
    (T.squash, "  a\t b c ", "a b c"), (T.squash, None, ""), (T.slug, "  Ä b--C! ", "b-c"), (T.slug, None, "item"), (T.spaced, "CST301a", "CST 301 a"), (T.keywords, "The cat and the Cat's hat", ["cat", "hat"]),
    (T.compact_form, "bright leaf", "brightleaf"), (T.compact_form, "nest", None), (T.without_intent, "Can you explain BrightLeaf?", "BrightLeaf"), (T.without_intent, "what is ", "what is"), (T.without_intent, None, ""),
    (T.focus_phrase, "can you explain the BrightLeaf", "brightleaf"), (T.question_type, "what is hod", "definition"), (T.question_type, "How many seats?", "fact"), (T.question_type, "how does it work", "explanation"),
    (T.is_follow_up, "How does it work?", True), (T.is_follow_up, "How do planes fly?", False), (T.is_noise, "", True), (T.is_noise, "[PAGE 3]", False), (T.is_noise, "ha ha ha ha ha ha ha ha", True), (T.is_noise, "a normal line of text", False),
    (T.token_estimate, "one two three", 3), (T.token_estimate, None, 1), (T.department_text, "R & D (AI)", "r and d (ai)"), (T.friendly_predicate, "hasName", "Has name"), (T.confidence_label, "0.81", "High"),
    (L.is_incomplete, "It opened (in 1990.", True), (L.is_incomplete, "This goes to the", True), (L.is_incomplete, "It works.", False), (L.is_incomplete, "12 34", True), (L.is_incomplete, None, True), (L.is_heading, "Objectives and summary", True), (L.is_heading, "The summary is in contents", False),
    (L.role_label, "who is the HOD of x", "head of department"), (L.is_person, "Dr. Ann", True), (L.person_name, "Dr. A B Smith Assistant Professor of x", "Dr. A. B. Smith"), (L.cleaned_answer, 'Answer: "so ."', "so."), (L.is_metadata_fact, None, True),
])
def test_functions(spark, f, x, want):
    assert value(spark, x, f) == want


def test_chunk_id_of_a_null_page(spark):
    import hashlib

    want = hashlib.sha1(b"s|None|a b").hexdigest()[:16]
    assert value(spark, "a  b", lambda x: T.chunk_id(F.lit("s"), F.lit(None), x)) == want


def test_sentences_keep_titles_and_initials(spark):
    got = value(spark, "Dr. A. Rao leads it. He came: First in 1990.\nNew line", D.sentences)
    assert got == ["Dr. A. Rao leads it.", "He came:", "First in 1990.", "New line"]


def test_definition_score_prefers_definitions(spark):
    rows = [("brightleaf", "BrightLeaf is a tool for care."), ("brightleaf", "We hereby thank BrightLeaf."), ("bright leaf", "The brightleaf app."), ("", "x")]
    got = [r.s for r in spark.createDataFrame(rows, "f string, t string").select(L.definition_score(F.col("f"), F.col("t")).alias("s")).collect()]
    assert got[0] > got[2] > 2 and got[0] > got[1] and got[3] == 0


@pytest.mark.parametrize("size", [20, 50, 1500])
def test_recursive_chunks(size):
    text = "First paragraph here. It has two sentences.\n\n" + "word " * 80 + "\n" + "x" * 70
    chunks = D.pack(text, size, size // 5)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    pos = 0
    for c in chunks:
        at = text.find(c[:5], max(0, pos - size))
        assert at >= 0
        pos = at


def test_cleaning(spark):
    rows = [(1, "Home\nHome\nHome\nBody text\nBody text\n[PAGE 2]\nTail"), (2, None), (3, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.cleaned) for r in D.clean_document(docs).collect()] == [(1, "Body text\n[PAGE 2]\nTail")]
    assert [(r.doc_id, r.cleaned) for r in D.clean_page(docs).collect()] == [(1, "Home\nBody text\n[PAGE 2]\nTail")]


def test_page_sections(spark):
    docs = spark.createDataFrame([(1, "front [PAGE 1] one\n[PAGE 2]\n\n[PAGE 3] three"), (2, None)], "doc_id long, text string")
    assert [(r.page, r.section) for r in D.page_sections(docs).orderBy("seq").collect()] == [(None, "front"), (1, "one"), (3, "three")]


def test_html(spark):
    html = '<html><head><title> T &amp; x</title><script>bad bad bad</script></head><body><nav>one two three</nav><article><h1>A b c</h1><p>Hi there &lt;you&gt;<p>A b c</p><a href="/x">go</a><a href="/x">again</a><a href="/y"></a></article></body></html>'
    pages = spark.createDataFrame([(1, "http://h.com/z?q", html), (2, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.cleaned) for r in D.html_text(pages).collect()] == [(1, "A b c\nHi there <you>")]
    assert [tuple(r) for r in D.html_links(pages).collect()] == [(1, "http://h.com/x", "go")]


def test_python_udfs(spark):
    df = spark.createDataFrame([("ﬁ\x00①", "fi 1"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(python_udfs.nfkc("a")).collect()] == ["fi 1", ""]
    assert df.select(python_udfs.similarity("b", "b")).first()[0] == 1.0
    fix = python_udfs.spelling(["faculty", "course"])
    assert spark.createDataFrame([("who teaches facultyy cat coursse",)], "a string").select(fix("a")).first()[0] == "who teaches faculty cat course"
