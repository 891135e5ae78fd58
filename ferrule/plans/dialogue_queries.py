"""Queries of question understanding, evidence and answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule import params, session
from ferrule.functions import python_udfs
from ferrule.functions import text as T
from ferrule.operators import docs as D
from ferrule.operators import evidence as E
from ferrule.operators.retrieve import ranked, small

from . import common as S
from . import retrieval_queries as R
from .common import table

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _case(q: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {S.any_of(q, terms)} THEN '{name}'" for name, terms in rules) + f" ELSE '{default}' END"


@query("intent_route", f"SELECT conv_id, turn, {_case("lower(coalesce(text, ''))", params.INTENTS, 'GENERAL')} AS intent FROM {S.TURNS}")
def intent_route(spark, sf):
    return S.turns(spark, sf).select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


_CAT = "CASE " + " ".join(f"WHEN i = '{k}' THEN '{v}'" for k, v in params.CATEGORY_BY_INTENT.items()) + " END"


@query("category_by_intent", f"SELECT conv_id, turn, {_CAT} AS category FROM (SELECT conv_id, turn, {_case("lower(coalesce(text, ''))", params.INTENTS, 'GENERAL')} AS i FROM {S.TURNS})")
def category_by_intent(spark, sf):
    c = F.lit(None).cast("string")
    for k, v in params.CATEGORY_BY_INTENT.items():
        c = F.when(F.col("i") == k, v).otherwise(c)
    return S.turns(spark, sf).select("conv_id", "turn", T.intent(F.col("text")).alias("i")).select("conv_id", "turn", c.alias("category"))


_TYPE = "CASE " + " ".join(f"WHEN {(S.starts if where == 'starts' else S.any_of)('q', phrases)} THEN '{kind}'" for kind, where, phrases in params.QUESTION_TYPES) + " ELSE 'definition' END"


@query("question_type", f"SELECT conv_id, turn, {_TYPE} AS question_type, CASE WHEN {_TYPE} = 'explanation' THEN 8 ELSE 5 END AS chunk_limit FROM (SELECT conv_id, turn, lower({S.squash('text')}) AS q FROM {S.TURNS})")
def question_type(spark, sf):
    k = T.question_type(F.col("text"))
    return S.turns(spark, sf).select("conv_id", "turn", k.alias("question_type"), F.when(k == "explanation", 8).otherwise(5).alias("chunk_limit"))


_FOLLOW = f"(q <> '' AND (regexp_matches(q, '\\b({'|'.join(params.FOLLOW_UP_WORDS)})\\b') OR {S.starts('q', params.FOLLOW_UP_STARTERS)}))"


@query("follow_up_flag", f"SELECT conv_id, turn, {_FOLLOW} AS follow_up FROM (SELECT conv_id, turn, lower({S.squash('text')}) AS q FROM conversations WHERE role = 'user')")
def follow_up_flag(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.is_follow_up(F.col("text")).alias("follow_up"))


@query("follow_up_rewrite", f"""WITH u AS (SELECT conv_id, turn, {S.squash('text')} AS t, lower({S.squash('text')}) AS q FROM conversations WHERE role = 'user' AND {S.squash('text')} <> ''), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM u)
SELECT conv_id, turn, CASE WHEN b IS NOT NULL AND {_FOLLOW} AND lower(b) <> q THEN b || chr(10) || 'Follow-up question: ' || t ELSE t END AS rewritten FROM p""")
def follow_up_rewrite(spark, sf):
    u = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.squash(F.col("text")).alias("t")).where("t <> ''")
    before = F.lag("t").over(W.partitionBy("conv_id").orderBy("turn"))
    u = u.withColumn("b", before)
    use = F.col("b").isNotNull() & T.is_follow_up(F.col("t")) & (F.lower("b") != F.lower("t"))
    return u.select("conv_id", "turn", F.when(use, F.concat("b", F.lit("\nFollow-up question: "), "t")).otherwise(F.col("t")).alias("rewritten"))


@query("recent_user_turns", f"WITH u AS (SELECT conv_id, turn, {S.squash('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' AND {S.squash('text')} <> '') SELECT conv_id, turn, t FROM u WHERE k <= 3")
def recent_user_turns(spark, sf):
    u = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.squash(F.col("text")).alias("t")).where("t <> ''")
    return ranked(u, ["conv_id"], [F.desc("turn")], 3).drop("rank")


@query("expand_queries", f"""WITH k AS (SELECT conv_id, turn, {S.squash('text')} AS t, {S.keywords('text')} AS k0 FROM conversations), j AS (SELECT *, array_to_string({S.unique('k0')}, ' ') AS kw FROM k)
SELECT conv_id, turn, CASE WHEN t = '' THEN '' WHEN kw = '' OR kw = lower(t) THEN t ELSE t || ' | ' || kw END AS expanded FROM j""")
def expand_queries(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.squash(F.col("text")).alias("t"), F.array_join(T.keywords(F.col("text")), " ").alias("kw"))
    return c.select("conv_id", "turn", F.when(F.col("t") == "", "").when((F.col("kw") == "") | (F.col("kw") == F.lower("t")), F.col("t")).otherwise(F.concat_ws(" | ", "t", "kw")).alias("expanded"))


@query("spelling_fix", None)
def spelling_fix(spark, sf):
    terms = ["purchase", "signup", "report", "question", "answer", "document", "please", "thanks"]
    return table(spark, sf, "conversations").select("conv_id", "turn", python_udfs.spelling(terms)(F.col("text")).alias("text"))


@query("keyword_overlap", f"""WITH c AS (SELECT conv_id, turn, {S.keywords('text')} AS k, lag({S.keywords('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(k)) = 0 OR len(coalesce(b, [])) = 0 THEN 0 ELSE len(list_intersect(list_distinct(k), list_distinct(b))) / len(list_distinct(k)) END, 6) AS overlap FROM c""")
def keyword_overlap(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.keywords(F.col("text")).alias("k"))
    c = c.withColumn("b", F.lag("k").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.round(F.when((F.size("k") > 0) & (F.coalesce(F.size("b"), F.lit(0)) > 0), F.size(F.array_intersect("k", "b")) / F.size("k")).otherwise(0.0), 6).alias("overlap"))


@query("confidence_label", "SELECT event_id, CASE WHEN s > 0.8 THEN 'High' WHEN s >= 0.5 THEN 'Medium' ELSE 'Low' END AS label, s FROM (SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS s FROM events)")
def confidence_label(spark, sf):
    s = F.round(T.clamp(F.col("value") / 100), 6)
    return table(spark, sf, "events").select("event_id", T.confidence_label(s).alias("label"), s.alias("s"))


@query("confidence_blend", f"WITH {R._LIN}, b AS (SELECT item_id, max(score) AS ev, max(k) AS ch, max(CASE WHEN doc_id % 2 = 0 THEN bn END) AS kg FROM lin GROUP BY item_id) SELECT item_id, CAST(round(greatest(0, least(1, CASE WHEN ev IS NOT NULL AND kg IS NOT NULL THEN ev * 0.5 + ch * 0.3 + kg * 0.2 WHEN ev IS NOT NULL THEN ev * 0.7 + ch * 0.3 ELSE coalesce(kg, 0) END)), 2) AS DOUBLE) AS confidence FROM b")
def confidence_blend(spark, sf):
    b = R.linear(spark, sf).groupBy("item_id").agg(F.max("score").alias("ev"), F.max("k").alias("ch"), F.max(F.when(F.col("doc_id") % 2 == 0, F.col("bn"))).alias("kg"))
    return b.select("item_id", E.confidence(F.col("ev"), F.col("ch"), F.col("kg")).alias("confidence"))


@query("kg_fact_filter", f"""WITH q AS (SELECT item_id, {S.keywords('text')} AS kw, text FROM benchmark), f AS (SELECT item_id, q.text AS t, kw, n_nationkey, ' ' || regexp_replace({S.searchable("n_name || ' ' || (SELECT any_value(text) FROM benchmark b WHERE b.item_id = n_nationkey)")}, '\\s', ' ', 'g') || ' ' AS pad FROM q, nation),
h AS (SELECT item_id, n_nationkey, len(list_filter(list_distinct(kw), lambda w: contains(pad, ' ' || w || ' '))) AS hits FROM f), r AS (SELECT *, CAST(round(least(1, greatest(0.5, CASE WHEN hits > 0 THEN 0.78 ELSE 0.5 END) + hits * 0.04), 2) AS DOUBLE) AS relevance FROM h WHERE hits > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, n_nationkey) AS rank FROM r) SELECT item_id, n_nationkey, relevance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def kg_fact_filter(spark, sf):
    b = table(spark, sf, "benchmark")
    n = table(spark, sf, "nation").join(b.select(F.col("item_id").alias("i"), F.col("text").alias("ft")), F.col("n_nationkey") == F.col("i"), "left")
    n = n.select("n_nationkey", T.padded(T.searchable(F.concat("n_name", F.lit(" "), "ft"))).alias("pad"))
    q = b.select("item_id", T.keywords(F.col("text")).alias("kw"))
    h = q.join(F.broadcast(n)).select("item_id", "n_nationkey", T.whole_word_hits(F.col("kw"), F.col("pad")).alias("hits")).where("hits > 0")
    return ranked(h.select("item_id", "n_nationkey", E.fact_relevance(F.lit(0.5), F.col("hits")).alias("relevance")), ["item_id"], [F.desc("relevance"), F.asc("n_nationkey")], 3)


_SENTS = f"""se AS (SELECT doc_id, source, lang, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, source, lang, {S.lines('text')} AS ss FROM documents))"""


def _evidence(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(D.lines_of(F.col("text"))).alias("i", "s"))
    return d.withColumn("i", (F.col("i") + 1).cast("long"))


@query("evidence_union_distinct", f"WITH {_SENTS}, u AS (SELECT 0 AS part, doc_id, i, s FROM se WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, i, s FROM se WHERE (doc_id % 2 <> 0 OR doc_id % 3 = 0)), k AS (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY part, doc_id, i) AS k FROM u) SELECT doc_id, i, md5(s) AS s FROM k WHERE k = 1")
def evidence_union_distinct(spark, sf):
    e = _evidence(spark, sf).select("doc_id", "i", "s", F.lower("s").alias("key"))
    return E.union_distinct([e.where("doc_id % 2 = 0"), e.where("doc_id % 2 <> 0 or doc_id % 3 = 0")], ["key"], ["doc_id", "i"]).select("doc_id", "i", F.md5("s").alias("s"))


@query("facts_union_distinct", "WITH u AS (SELECT 0 AS part, n_nationkey AS k, lower(n_name) AS entity, 'nation' AS fact FROM nation UNION ALL SELECT 1, c_custkey, lower(n_name), 'nation' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 2, c_custkey, lower(c_mktsegment), 'segment' FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY entity, fact ORDER BY part, k) AS n FROM u) SELECT entity, fact, CAST(k AS BIGINT) AS k FROM r WHERE n = 1")
def facts_union_distinct(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    named = c.join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    row = lambda df, k, e, f: df.select(F.col(k).cast("long").alias("k"), F.lower(e).alias("entity"), F.lit(f).alias("fact"))
    return E.union_distinct([row(n, "n_nationkey", "n_name", "nation"), row(named, "c_custkey", "n_name", "nation"), row(c, "c_custkey", "c_mktsegment", "segment")], ["entity", "fact"], ["k"])


@query("per_source_cap", f"WITH {R._BM25}, x AS (SELECT bm.item_id, bm.doc_id, score, source, row_number() OVER (PARTITION BY bm.item_id, source ORDER BY score DESC, bm.doc_id) AS k FROM bm JOIN documents d USING (doc_id) WHERE rank <= 20) SELECT item_id, doc_id, score, source FROM x WHERE k <= 2")
def per_source_cap(spark, sf):
    x = R.bm25(spark, sf, 20).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return E.capped(x, ["item_id"], ["source"], [F.desc("score"), F.asc("doc_id")], F.lit(2)).select("item_id", "doc_id", "score", "source")


_TOK = f"CAST(greatest(1, floor({S.word_count('text')} * 1.3)) AS INTEGER)"


@query("token_budget_pack", f"""WITH RECURSIVE {R._BM25}, x AS (SELECT bm.item_id, rank, bm.doc_id, {_TOK} AS tokens FROM bm JOIN documents d USING (doc_id) WHERE rank <= 12),
p(item_id, rank, doc_id, tokens, used, kept) AS (SELECT item_id, rank, doc_id, tokens, CASE WHEN tokens <= 1000 THEN tokens ELSE 0 END, tokens <= 1000 FROM x WHERE rank = 1
UNION ALL SELECT x.item_id, x.rank, x.doc_id, x.tokens, CASE WHEN p.used + x.tokens <= 1000 THEN p.used + x.tokens ELSE p.used END, p.used + x.tokens <= 1000 FROM p JOIN x ON x.item_id = p.item_id AND x.rank = p.rank + 1)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, tokens FROM p WHERE kept""")
def token_budget_pack(spark, sf):
    x = R.bm25(spark, sf, 12).join(table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens")), "doc_id")
    return E.packed(x, "item_id", ["rank", "doc_id"], "tokens").select("item_id", "rank", "doc_id", "tokens")


_GS = S.listed(params.GROUNDING_STOPWORDS)
_SUP = "list_filter([t, regexp_replace(t, 's+$', ''), CASE WHEN ends_with(t, 'es') THEN t[:-3] ELSE t END, CASE WHEN ends_with(t, 'ed') THEN t[:-3] ELSE t END, CASE WHEN ends_with(t, 'ing') THEN t[:-4] ELSE t END], lambda v: list_contains(c, v))"
_TALK = "talk AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"


@query("unsupported_tokens", f"""WITH {_TALK}, k AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}')), lambda t: t NOT IN ({_GS})) AS a, regexp_extract_all(lower(coalesce(before, '')), '[a-z0-9]{{3,}}') AS c FROM talk WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, c, unnest(a) AS t FROM k), m AS (SELECT conv_id, turn, t FROM u WHERE len({_SUP}) = 0) SELECT k.conv_id, k.turn, count(t) AS n, md5(coalesce(string_agg(t, ' ' ORDER BY t), '')) AS tokens FROM k LEFT JOIN m ON m.conv_id = k.conv_id AND m.turn = k.turn GROUP BY k.conv_id, k.turn""")
def unsupported_tokens(spark, sf):
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    c = T.once(c, "u", E.unsupported(F.col("text"), F.col("before")))
    return c.select("conv_id", "turn", F.size("u").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("u"), " ")).alias("tokens"))


@query("grounding_check", f"""WITH {_TALK}, e AS (SELECT conv_id, turn, text, 'before' AS evidence, coalesce(before, '') AS told FROM talk WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, text, 'both', coalesce(before, '') || ' ' || coalesce(text, '') FROM talk WHERE role = 'assistant'),
k AS (SELECT conv_id, turn, evidence, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}')), lambda t: t NOT IN ({_GS})) AS a, list_distinct(regexp_extract_all(lower(told), '[a-z0-9]{{3,}}')) AS c FROM e)
SELECT conv_id, turn, evidence, len(a) = 0 OR len(list_intersect(a, c)) >= greatest(2, ceil(len(a) * 0.4)) AS grounded FROM k""")
def grounding_check(spark, sf):
    """Each answer against the turn before it, and against both turns, as one that repeats its evidence is grounded."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    before, text = F.coalesce("before", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.array(F.struct(F.lit("before").alias("evidence"), before.alias("told")), F.struct(F.lit("both").alias("evidence"), F.concat(before, F.lit(" "), text).alias("told")))
    c = c.select("conv_id", "turn", "text", F.inline(told))
    a = F.filter(T.token_set(F.col("text")), lambda t: ~t.isin(*params.GROUNDING_STOPWORDS))
    return c.select("conv_id", "turn", "evidence", E.grounded(a, T.token_set(F.col("told")), F.lit("explanation")).alias("grounded"))


@query("context_line", "SELECT doc_id, '- [' || coalesce(nullif(source, ''), 'Official Source') || CASE WHEN doc_id % 4 > 0 THEN ' | page ' || CAST(doc_id % 4 AS VARCHAR) ELSE '' END || '] ' || coalesce(text, '') AS line FROM documents")
def context_line(spark, sf):
    return _context_lines(spark, sf, F.col("text"))


def _context_lines(spark, sf, text):
    page = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(" | page "), (F.col("doc_id") % 4).cast("string"))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("- ["), F.coalesce(F.nullif("source", F.lit("")), F.lit("Official Source")), page, F.lit("] "), F.coalesce(text, F.lit(""))).alias("line"))


def _answers(spark, sf):
    best = R.linear(spark, sf).where("k > 0 or bn > 0")
    top = ranked(best, ["item_id"], [F.desc("score"), F.asc("doc_id")], 4)
    asked = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"))
    top = session.kept(top, "top")
    texts = table(spark, sf, "documents").select("doc_id", "text").join(small(top.select("doc_id").distinct()), "doc_id", "left_semi")
    lines = top.join(texts, "doc_id").join(asked, "item_id")
    s = lines.select("item_id", "doc_id", "score", "k", "q", F.explode(D.sentences(F.col("text"))).alias("sentence"))
    hits = F.size(F.array_intersect(T.token_set(F.col("q")), T.token_set(F.col("sentence"))))
    return s.withColumn("hits", hits).where("hits > 0")


@query("answer_status", None)
def answer_status(spark, sf):
    found = _answers(spark, sf).groupBy("item_id").agg(F.max("score").alias("ev"), F.max("k").alias("ch"), F.count("*").alias("n"))
    every = table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left")
    c = E.confidence(F.col("ev"), F.col("ch"), F.lit(None).cast("double"))
    return every.select("item_id", c.alias("confidence"), E.status(c, F.coalesce("n", F.lit(0)), F.coalesce(F.col("ch") >= 0.95, F.lit(False))).alias("status"))


@query("answer_extractive", None)
def answer_extractive(spark, sf):
    s = _answers(spark, sf).select("item_id", "sentence", F.round(F.col("score") + 0.1 * F.col("hits"), 6).alias("s"))
    picked = E.diverse(s.distinct(), "item_id", "sentence", "s")
    return picked.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "sentence"))), lambda x: x["sentence"]), " ").alias("answer"))
