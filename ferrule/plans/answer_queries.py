"""Queries from evidence to answers, and of ingestion rules: conversations ask and answer, star-schema tables are the facts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule import params
from ferrule.functions import text as T
from ferrule.operators import answers as A
from ferrule.operators import cascade as C
from ferrule.operators import docs as D
from ferrule.operators import graph as G
from ferrule.operators import ingest as I
from ferrule.operators import retrieve as R

from . import common as S
from .common import table
from .graph_queries import _TRIPLES, triples

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def talk(spark, sf):
    """Each turn with the one before it as its question."""
    return table(spark, sf, "conversations").withColumn("query", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("query is not null")


_QA = "qa AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query FROM conversations) WHERE query IS NOT NULL)"


def questions(spark, sf):
    """The first turn of each conversation as its question."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query")).withColumn("question_type", T.question_type(F.col("query")))


def evidence(spark, sf):
    """Sentences of the later turns of each conversation, as evidence for its question."""
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", F.posexplode(D.sentences(F.col("text"))).alias("i", "sentence"))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("turn", "i")))
    s = s.withColumn("score", F.round(0.4 + (F.col("rank") % 5) * 0.1, 2)).withColumn("semantic_score", F.round((F.col("rank") % 7) * 0.1, 2)).withColumn("match_type", F.when(F.col("turn") % 3 == 0, "structured").otherwise("vector"))
    return s.join(questions(spark, sf), "query_id").withColumn("title", F.col("role"))


_PAGE = "CASE page_id % 4 WHEN 1 THEN 'Skip  to content News Sign in ' || html WHEN 2 THEN html || ' show all . Show all> ' WHEN 3 THEN 'This site uses cookies. Accept all' || html ELSE html END"


def part_evidence(spark, sf):
    """Sentences about each part, as evidence for a question that asks to explain it: what it is, what it does, who is in charge, and layout."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), "p_name", F.lower("p_type").alias("kind"), "p_brand", "p_partkey")
    who = F.element_at(F.array(*[F.lit(n) for n in ("Anna Berg", "Omar Haddad", "Li Wei", "Rosa Diaz", "Jan Novak")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    told = F.array(
        F.concat(F.lit("The "), "p_name", F.lit(" is a system that is designed to hold "), "kind", F.lit(" loads on walls and doors.")),
        F.concat("p_name", F.lit(" provides a joint that users of "), "p_brand", F.lit(" can open again without tools.")),
        F.concat(F.lit("Dr. "), who, F.lit(" is the Head of the Department of "), "kind", F.lit(" fittings.")), F.concat(F.lit("Abstract The "), "p_name", F.lit(" was tested twice.")), F.concat(F.lit("Figure 3 shows a "), "p_name"),
    )
    s = p.select("query_id", F.concat(F.lit("explain "), "p_name").alias("query"), F.lit("explanation").alias("question_type"), F.posexplode(told).alias("i", "sentence"))
    s = s.withColumn("rank", F.col("i") + 1).withColumn("turn", F.col("i").cast("long"))
    return s.withColumn("score", F.round(0.9 - F.col("rank") * 0.1, 2)).withColumn("semantic_score", F.round(0.8 - F.col("rank") * 0.1, 2)).withColumn("match_type", F.lit("vector")).withColumn("title", F.lit("parts")).withColumn("role", F.lit("user"))


def _without(x: str) -> str:
    for p in params.BOILERPLATE:
        x = f"regexp_replace({x}, '(?is){p}', ' ', 'g')"
    return x


@query("boilerplate_removed", "SELECT page_id, md5(" + S.squash(_without(f"coalesce({_PAGE}, '')")) + ") AS text, md5(" + S.squash(f"coalesce({_PAGE}, '')") + ") AS before FROM pages")
def boilerplate_removed(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(_PAGE).alias("html"))
    return p.select("page_id", F.md5(A.without_blocks(F.col("html"))).alias("text"), F.md5(T.squash(F.col("html"))).alias("before"))


@query("sentence_cosine", """WITH p AS (SELECT a.vec_id AS vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 4) AS cosine FROM p""")
def sentence_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(after, "vec_id").select("vec_id", A.cosine(F.col("embedding"), F.col("y")).alias("cosine"))


@query("iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def iso_utc(spark, sf):
    return table(spark, sf, "events").select("event_id", A.iso_utc(F.col("ts")).alias("at"))


@query("about_summary", """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, CASE WHEN contains(t, 'the ') THEN substr(t, instr(t, 'the ')) WHEN contains(t, 'de ') THEN substr(t, instr(t, 'de ')) ELSE t END AS t FROM t)
SELECT doc_id, md5(substr(CASE WHEN contains(t, '@') THEN substr(t, 1, instr(t, '@') - 1) ELSE t END, 1, 900)) AS about FROM b""")
def about_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(A.about(F.col("text"), ("the ", "de "), "@")).alias("about"))


_TITLE = "p_name || CASE WHEN p_partkey % 3 = 0 THEN ': ' || p_type WHEN p_partkey % 3 = 1 THEN ' health project' ELSE '' END"


@query("title_quality", f"""WITH t AS (SELECT p_partkey, {_TITLE} AS t FROM part), n AS (SELECT *, len(regexp_extract_all(lower(t), '[a-z0-9]+')) AS n FROM t)
SELECT p_partkey, round(CASE WHEN {S.any_of('lower(t)', params.TITLE_BOILERPLATE)} THEN -1 ELSE CASE WHEN contains(t, ':') THEN 0.7 ELSE 0 END + CASE WHEN upper(t) = t AND lower(t) <> t THEN 0.2 ELSE 0 END
  + CASE WHEN n BETWEEN 4 AND 12 THEN 0.6 WHEN n BETWEEN 2 AND 3 THEN 0.1 ELSE 0 END + CASE WHEN length(t) >= 28 THEN 0.4 ELSE 0 END
  + CASE WHEN regexp_matches(lower(t), '\\b({'|'.join(params.TITLE_WORDS)})\\b') THEN 0.5 ELSE 0 END END, 2) AS quality FROM n""")
def title_quality(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(A.title_quality(F.expr(_TITLE)), 2).alias("quality"))


@query("document_priority", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN -2.0 WHEN contains(lower(p_type), 'econ') THEN 4.5 WHEN starts_with(lower(p_type), 'sm') THEN 2.4 ELSE 0.0 END AS priority FROM part")
def document_priority(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.priority(F.col("p_type"), [("promo", -2.0), ("econ", 4.5), ("^sm", 2.4)]).alias("priority"))


#: Qualifiers of part types, with what they are also called.
_QUALIFIERS = {"standard": ("plain", "std"), "promo": ("offer",), "large": ("big", "xl"), "small": ("mini",)}


@query("qualifier_aliases", "SELECT p_partkey, array_to_string(list_sort(list_concat(" + ", ".join(f"CASE WHEN contains(lower(p_type), '{k}') THEN [{S.listed((k, *v))}] ELSE [] END" for k, v in _QUALIFIERS.items()) + ")), ',') AS aliases FROM part")
def qualifier_aliases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(A.qualifiers(F.col("p_type"), _QUALIFIERS), ",").alias("aliases"))


@query("evidence_strength", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_discount * 10 >= 0.82 OR l_tax * 10 >= 0.8 OR l_quantity / 50 >= 0.9 THEN 'strong'
  WHEN l_quantity / 60 >= 0.5 OR l_quantity / 50 >= 0.45 OR l_discount * 10 >= 0.4 OR l_tax * 10 >= 0.38 THEN 'usable' ELSE 'weak' END AS strength FROM lineitem""")
def evidence_strength(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.strength(c("l_returnflag") == "R", c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50, c("l_quantity") / 60).alias("strength"))


@query("focus_statement", f"""WITH d AS (SELECT doc_id, {S.squash('text')} AS t FROM documents), f AS (SELECT doc_id, t, regexp_extract_all(lower(regexp_extract(t, '^[^ ]+', 0)), '[a-z0-9]+') AS w FROM d)
SELECT doc_id, len(w) = 0 OR regexp_matches(lower(t), '^' || array_to_string(w, '\\s*') || '\\s+(?:{A.STATES})\\b') AS states FROM f""")
def focus_statement(spark, sf):
    t = T.squash(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", A.states_focus(F.regexp_extract(t, "^[^ ]+", 0), t).alias("states"))


@query("role_match", f"""WITH t AS (SELECT conv_id, turn, lower({S.squash('text')}) AS t FROM {S.TURNS}) SELECT conv_id, turn, regexp_matches(t, '\\b(?:head of (?:the )?department|hod)\\b') AS head, contains(t, 'teacher') AND regexp_matches(t, '\\bteacher\\b') AS teacher FROM t""")
def role_match(spark, sf):
    return S.turns(spark, sf).select("conv_id", "turn", A.holds_role("Head of Department", F.col("text")).alias("head"), A.holds_role("Teacher", F.col("text")).alias("teacher"))


@query("simple_sentences", f"SELECT doc_id, len(list_filter(string_split(regexp_replace({S.squash('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n, md5(array_to_string(list_filter(string_split(regexp_replace({S.squash('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), chr(1))) AS sentences FROM documents")
def simple_sentences(spark, sf):
    s = A.simple_sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\x01")).alias("sentences"))


@query("extracted_sentences", None)
def extracted_sentences(spark, sf):
    return evidence(spark, sf).select("query_id", "rank", A.extracted(F.col("sentence"), T.focus_phrase(F.col("query"))).alias("sentence"))


@query("name_in_role", None)
def name_in_role(spark, sf):
    e = part_evidence(spark, sf)
    return e.select("query_id", "rank", *[A.name_in_role(r, F.col("sentence")).alias(r.lower().replace(" ", "_")) for r in A.ROLES])


@query("structured_row", f"""SELECT s_suppkey, {S.squash('s_name')} AS sentence, CASE WHEN s_suppkey % 5 = 0 THEN 'Official Source' ELSE 'supplier' END AS title, round(s_acctbal / 10000, 2) AS score, 'structured' AS match_type FROM supplier""")
def structured_row(spark, sf):
    title = F.when(F.col("s_suppkey") % 5 == 0, "  ").otherwise("supplier")
    return table(spark, sf, "supplier").select("s_suppkey", A.structured(F.col("s_name"), title, F.col("s_acctbal").cast("double") / 10000).alias("e")).select("s_suppkey", "e.sentence", "e.title", "e.score", "e.match_type")


@query("best_fact_sentence", None)
def best_fact_sentence(spark, sf):
    return A.best_fact(evidence(spark, sf))


@query("overview_evidence", None)
def overview_evidence(spark, sf):
    e = part_evidence(spark, sf)
    return e.select("query_id").distinct().join(A.overview(e), "query_id", "left")


@query("answer_explanation_evidence", None)
def answer_explanation_evidence(spark, sf):
    return A.explanation(evidence(spark, sf))


@query("explanation_sufficient", None)
def explanation_sufficient(spark, sf):
    return A.sufficient(A.explanation(evidence(spark, sf), 3), questions(spark, sf))


@query("context_evidence", None)
def context_evidence(spark, sf):
    e = evidence(spark, sf).select("query_id", "query", "question_type", "sentence", "title", F.col("turn").alias("page"), F.col("rank").alias("chunk_id"), F.col("score").alias("chunk_score"), F.col("score").alias("rerank_score"), F.col("semantic_score").alias("_v"))
    return A.context_evidence(e, F.col("_v")).drop("_v")


@query("answer_bonus", None)
def answer_bonus(spark, sf):
    none = F.array(F.lit("teacher"))
    return talk(spark, sf).select("conv_id", "turn", A.answer_bonus(F.col("query"), T.question_type(F.col("query")), none, F.lit("talk"), F.coalesce("text", F.lit(""))).alias("bonus"))


@query("budgeted_context", None)
def budgeted_context(spark, sf):
    e = evidence(spark, sf)
    facts = e.where("rank <= 6").select("query_id", "rank", F.col("title").alias("entity"), F.col("sentence").alias("fact"))
    return A.budgeted(facts, e.select("query_id", "rank", "title", F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("page"), "sentence"))


@query("facts_by_entity", "SELECT o_orderpriority AS entity, CAST(max(o_totalprice) AS DOUBLE) AS score, count(DISTINCT 'order ' || o_orderkey) AS n FROM orders WHERE NOT starts_with(lower(o_orderstatus), 'type') GROUP BY o_orderpriority")
def facts_by_entity(spark, sf):
    o = table(spark, sf, "orders").select(F.lit(1).alias("query_id"), F.col("o_orderpriority").alias("entity"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("fact"), F.col("o_totalprice").cast("double").alias("score"))
    return A.entity_facts(o).select("entity", "score", F.size("facts").cast("long").alias("n"))


@query("fact_evidence", None)
def fact_evidence(spark, sf):
    q = questions(spark, sf)
    facts = evidence(spark, sf).where("match_type = 'structured'").select("query_id", F.col("title").alias("entity"), F.col("sentence").alias("fact"), "score")
    return A.fact_evidence(facts, q).select("query_id", "rank", "evidence.sentence", "evidence.title", "evidence.score")


@query("profile_match", None)
def profile_match(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("who is "), F.col("c_name")).alias("query"), F.col("c_custkey").alias("query_id"))
    people = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("designation"), F.lit("customers").alias("department"))
    return A.profile_match(c.select("query_id", "query"), people)


@query("profile_sentence", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' is in the sales.' WHEN c_custkey % 4 = 1 THEN c_name || ' is ' || c_mktsegment || '.' WHEN c_custkey % 4 = 2 THEN c_name || ' is ' || c_mktsegment || ' in the sales.' END AS sentence FROM customer""")
def profile_sentence(spark, sf):
    k = F.col("c_custkey") % 4
    return table(spark, sf, "customer").select("c_custkey", A.profile_sentence(F.col("c_name"), F.when(k.isin(1, 2), F.col("c_mktsegment")).otherwise(""), F.when(k.isin(0, 2), "sales").otherwise("")).alias("sentence"))


@query("role_evidence", None)
def role_evidence(spark, sf):
    people = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "Head of Department").otherwise("Clerk").alias("designation"), F.lit("supply").alias("department"))
    told = F.concat(F.lit("Dr. Anna Berg is the Head of the Department of "), F.col("source"), F.lit(". "), F.substring("text", 1, 400))
    documents = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 50 == 0, told).otherwise(F.col("text")).alias("text"))
    return A.role_evidence("Head of Department", people, documents, [("news", -2.0)]).select("title", "evidence.sentence", "evidence.score", "evidence.source_type")


@query("upload_facts", None)
def upload_facts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("label"), F.col("p_type").alias("description"), F.array("p_brand", F.col("p_type")).alias("features"))
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what is "), F.col("p_name")).alias("query"))
    return A.upload_facts(asked, p)


@query("person_records", None)
def person_records(spark, sf):
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.initcap(F.lower(F.regexp_extract("n_name", "^[A-Za-z]+", 0))), F.lit(" "), F.initcap(F.lower("c_mktsegment")))
    register = F.concat(F.lit("MEK21CS"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    title = F.concat(F.lit('project titled "Health Monitoring System for '), F.col("c_mktsegment"), F.lit('"'))
    text = F.concat_ws("\n", F.lit("List of students"), name, F.when(F.col("c_custkey") % 3 > 0, register), F.when(F.col("c_custkey") % 2 == 0, title), F.lit("Department of Computer Science during 2024"))
    return A.person_records(people.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("who is "), name).alias("query"), F.col("c_custkey").alias("chunk_id"), text.alias("text")))


@query("regulation_faqs", """SELECT doc_id, q AS question, a AS answer FROM documents, (VALUES ('', 'Where is it?', 'In the archive.'), ('the ', 'What language?', 'English, in part.')) r(m, q, a) WHERE contains(lower(source), 'src1') AND contains(coalesce(text, ''), m)""")
def regulation_faqs(spark, sf):
    return I.faqs(table(spark, sf, "documents"), [("src1", "", "Where is it?", "In the archive."), ("src1", "the ", "What language?", "English, in part.")], "doc_id", "source", "text")


@query("source_lookup", "SELECT p.url AS url, min(q.page_id) AS page_id FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL UNION SELECT 'http://unknown.example/') p LEFT JOIN pages q ON q.url = p.url GROUP BY p.url")
def source_lookup(spark, sf):
    p = table(spark, sf, "pages")
    asked = p.select("url").where("url is not null").distinct().unionByName(spark.createDataFrame([("http://unknown.example/",)], "url string"))
    return I.lookup(asked, p.where("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id")))


@query("run_healed", "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN CASE WHEN event_id % 3 > 0 THEN 'idle' ELSE 'error' END WHEN event_type = 'click' THEN 'running' ELSE event_type END AS state FROM events")
def run_healed(spark, sf):
    state = F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", I.healed(state, F.col("user_id") % 2 != 0, F.col("event_id") % 3 > 0).alias("state"))


#: An upload's state by how far its order has come: the last shipped line's number, and returned ones as failures.
@query("upload_steps", """WITH s AS (SELECT l_orderkey, max(l_linenumber) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey),
t AS (SELECT l_orderkey, CASE WHEN r > 2 THEN 'failed' WHEN n = 1 THEN 'uploaded' WHEN n = 2 THEN 'chunking' WHEN n = 3 THEN 'embedding' WHEN n = 4 THEN 'kg_sync' ELSE 'indexed' END AS s, r = 1 AS broke FROM s),
n AS (SELECT l_orderkey, CASE WHEN s IN ('indexed', 'failed') THEN s WHEN broke THEN 'failed' WHEN s = 'uploaded' THEN 'chunking' WHEN s = 'chunking' THEN 'embedding' WHEN s = 'embedding' THEN 'kg_sync' ELSE 'indexed' END AS state FROM t)
SELECT l_orderkey, state, CASE state WHEN 'uploaded' THEN 15 WHEN 'chunking' THEN 40 WHEN 'embedding' THEN 75 WHEN 'kg_sync' THEN 90 WHEN 'indexed' THEN 100 WHEN 'failed' THEN 100 ELSE 0 END AS progress FROM n""")
def upload_steps(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    names = F.array(*[F.lit(s) for s, _ in I.UPLOAD_STEPS])
    state = F.when(F.col("r") > 2, "failed").otherwise(F.element_at(names, F.least(F.col("n"), F.lit(len(I.UPLOAD_STEPS))).cast("int")))
    return s.select("l_orderkey", I.step_after(state, F.col("r") == 1).alias("state")).withColumn("progress", I.progress(F.col("state")))


@query("upload_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders WHERE o_orderstatus = 'P'")
def upload_order(spark, sf):
    # a listing is one ordered list; ranks within months first, so that no task sorts it all
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    before = o.groupBy("m").count().withColumn("later", F.coalesce(F.sum("count").over(W.partitionBy(F.lit(0)).orderBy(F.desc("m")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = o.withColumn("k", F.row_number().over(W.partitionBy("m").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    return within.join(F.broadcast(before.select("m", "later")), "m").select("o_orderkey", (F.col("k") + F.col("later")).cast("long").alias("position"))


@query("index_rebuilt", "SELECT source_type, count(*) AS n FROM (SELECT doc_id, 'official' AS source_type FROM documents WHERE doc_id % 4 > 0 AND length(trim(coalesce(text, ''))) > 0 UNION ALL SELECT doc_id, 'upload' FROM documents WHERE doc_id % 4 = 0) GROUP BY source_type")
def index_rebuilt(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return I.rebuilt(d, d.where("doc_id % 4 = 0"), "doc_id").groupBy("source_type").agg(F.count("*").alias("n"))


@query("index_appended", f"WITH t AS (SELECT doc_id, {S.tokens('text')} AS ts FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY term")
def index_appended(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    new = d.where("doc_id % 5 >= 3")
    post = lambda x: R.bags(x, "doc_id", F.col("text")).select("doc_id", F.col("words.term").alias("terms"))
    whole = I.appended(post(d.where("doc_id % 5 < 4")), post(new), "doc_id", new)
    return whole.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


_NAMED = "(SELECT doc_id, text, concat_ws(' ', source, lang) AS title FROM documents)"


@query("topic_boost", f"SELECT doc_id, CASE WHEN contains(lower(title), 'en') THEN 0.85 ELSE 0.65 END AS title_score, CASE WHEN contains(lower(text), 'en') THEN 0.65 ELSE 0.45 END AS keyword_score FROM {_NAMED} WHERE contains(lower(title), 'en') OR contains(lower(text), 'en') OR contains(lower(title), 'src1')")
def topic_boost(spark, sf):
    return R.topic_boost(table(spark, sf, "documents"), "en", "doc_id", F.col("text"), F.concat_ws(" ", "source", "lang"), also="src1", most=None)


@query("course_lookup", None)
def course_lookup(spark, sf):
    courses = table(spark, sf, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("code"))
    return G.course_lookup(questions(spark, sf).select("query_id", "query"), courses)


@query("kg_by_type", f"WITH {_TRIPLES} SELECT DISTINCT l.s AS entity, l.o AS label, t.o AS type FROM tr l JOIN tr t ON l.p = 'label' AND t.p = 'type' AND t.s = l.s WHERE contains(lower(l.o), '1') AND t.o = 'Supplier'")
def kg_by_type(spark, sf):
    return G.by_type(triples(spark, sf), F.lit("1"), "Supplier")


@query("kg_fast_path", f"SELECT conv_id, turn, CASE WHEN NOT (turn % 5 = 0 OR {S.any_of('lower(text)', params.ROLE_TERMS)}) THEN 'skipped' WHEN turn % 2 = 0 AND turn % 3 = 0 THEN 'skipped_for_explanation' ELSE 'lookup' END AS path FROM conversations WHERE text IS NOT NULL")
def kg_fast_path(spark, sf):
    t = F.col("turn")
    kind = F.when(t % 2 == 0, "explanation").otherwise("fact")
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", G.fast_path(F.col("text"), F.lit("GENERAL"), kind, t % 5 == 0, t % 3 == 0).alias("path"))


def _built(spark, sf):
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    nation = groups.select(F.col("id").alias("_n"), F.col("label").alias("group"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("_n")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), "group")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("group"))
    return G.build(("root-1", "World", "Root"), groups, {"Supplier": (s, None, "has_supplier", "belongs_to"), "Part": (p, "offers", None, None)})


@query("kg_build_nodes", "SELECT 'root-1' AS id, 'World' AS label, 'Root' AS type UNION ALL SELECT 'group-' || n_nationkey, n_name, 'Group' FROM nation UNION ALL SELECT 'supplier-' || s_suppkey, s_name, 'Supplier' FROM supplier UNION ALL SELECT 'part-' || p_partkey, p_name, 'Part' FROM part")
def kg_build_nodes(spark, sf):
    return _built(spark, sf)[0]


@query("kg_build_edges", "SELECT 'group-' || s_nationkey AS source, 'supplier-' || s_suppkey AS target, 'has_supplier' AS type FROM supplier UNION ALL SELECT 'supplier-' || s_suppkey, 'group-' || s_nationkey, 'belongs_to' FROM supplier UNION ALL SELECT 'root-1', 'part-' || p_partkey, 'offers' FROM part")
def kg_build_edges(spark, sf):
    return _built(spark, sf)[1].drop("id")


@query("generation_context", f"WITH {_QA} SELECT conv_id, turn, md5(CASE WHEN text <> '' THEN 'Direct answer candidate:' || chr(10) || text || chr(10) || chr(10) ELSE '' END || '[Knowledge Graph Facts]' || chr(10) || '- ' || query || chr(10) || chr(10) || '[Relevant Documents]' || chr(10) || '- ' || coalesce(text, '') || chr(10) || '- ' || query) AS context FROM qa")
def generation_context(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return talk(spark, sf).select("conv_id", "turn", F.md5(A.generation_context(F.array("query"), F.array(t, F.col("query")), F.col("text"), F.lit(""))).alias("context"))


@query("answer_grounded", None)
def answer_grounded(spark, sf):
    t = talk(spark, sf)
    return t.select("conv_id", "turn", A.answer_is_grounded(F.col("text"), F.lit(0.8), T.question_type(F.col("query")), F.when(F.col("conv_id") % 2 == 0, F.array("query", F.col("text"))).otherwise(F.array("query")), F.lit(False)).alias("grounded"))


@query("answer_finalised", None)
def answer_finalised(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", A.finalised(F.when(F.col("turn") % 2 == 0, F.col("text")), F.lit("fallback"), T.question_type(F.col("query")), F.col("turn") % 3 == 0).alias("answer"))


@query("response_cache", f"WITH c AS (SELECT lower({S.squash('text')}) || '::v1::r1' AS key, min(conv_id) AS response FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1) SELECT conv_id, turn, md5(lower({S.squash('text')}) || '::v1::r1') AS key, c.response IS NOT NULL AS hit FROM conversations v LEFT JOIN c ON c.key = lower({S.squash('text')}) || '::v1::r1'")
def response_cache(spark, sf):
    c = table(spark, sf, "conversations")
    kept = c.where("conv_id % 2 = 0").groupBy(A.cache_key(F.col("text"), "v1", "r1").alias("key")).agg(F.min("conv_id").alias("response"))
    return A.cached(c.select("conv_id", "turn", F.col("text").alias("query")), kept, "v1", "r1").select("conv_id", "turn", F.md5("key").alias("key"), "hit")


@query("direct_answers", None)
def direct_answers(spark, sf):
    """Questions about parts, of every kind, through the cascade: definitions, the person in charge, facts, and what the graph says."""
    q = table(spark, sf, "part").selectExpr("p_partkey AS query_id", f"{S.QUESTION} AS query").withColumn("question_type", T.question_type(F.col("query")))
    e = part_evidence(spark, sf).where("query_id % 5 > 0").select("query_id", "rank", "sentence", "score", "match_type")
    facts = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("entity"), F.concat(F.lit("is made by "), "p_brand").alias("fact"), F.lit(0.8).alias("score")).where("query_id % 7 > 0")
    return C.direct_answers(q, e, facts)


_BRANCH = "CASE WHEN regexp_matches(lower(text), '\\b(hod|head of (the )?department)\\b') THEN 'role' WHEN starts_with(lower(text), 'what is ') THEN 'definition' WHEN contains(lower(text), ' located') THEN 'place' END"


@query("cascade_branches", f"SELECT conv_id, turn, CASE {_BRANCH} WHEN 'role' THEN 'ask the head' WHEN 'definition' THEN upper(text) WHEN 'place' THEN 'in the store' END AS answer, {_BRANCH} AS branch FROM {S.TURNS}")
def cascade_branches(spark, sf):
    turns = S.turns(spark, sf).withColumn("key", F.struct("conv_id", "turn"))
    low = F.lower("text")
    branches = [
        ("role", lambda q: q.where(low.rlike(r"\b(hod|head of (the )?department)\b")).withColumn("answer", F.lit("ask the head"))),
        ("definition", lambda q: q.where(low.startswith("what is ")).withColumn("answer", F.upper("text"))),
        ("place", lambda q: q.where(F.contains(low, F.lit(" located"))).withColumn("answer", F.lit("in the store"))),
        ("none", lambda q: q.where("false").withColumn("answer", F.lit(""))),
    ]
    return C.cascade(turns, branches, "key").select("key.conv_id", "key.turn", "answer", "branch")
