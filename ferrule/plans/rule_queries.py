"""Queries of the sentence rules, answer selection and graph building, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule import params
from ferrule.functions import rules as L
from ferrule.functions import text as T
from ferrule.operators import docs as D
from ferrule.operators import evidence as E
from ferrule.operators.retrieve import ranked

from . import common as S
from . import retrieval_queries as R
from .common import table

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_SENT = f"se AS (SELECT doc_id, source, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, source, {S.lines('text')} AS ss FROM documents))"
_LOW = f"lower({S.squash('s')})"


def _lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(D.lines_of(F.col("text"))).alias("i", "s"))
    return d.withColumn("i", (F.col("i") + 1).cast("long"))


_HEAD = f"({_LOW} = '' OR {_LOW} IN ({S.listed(L.HEADINGS)}) OR (len(list_filter([{S.listed(L.HEADINGS)}], lambda h: contains({_LOW}, h))) >= 2 AND NOT regexp_matches({_LOW}, '\\b({'|'.join(params.SIGNAL_VERBS)})\\b') AND NOT regexp_matches({_LOW}, '[@%+0-9]') AND NOT regexp_matches(coalesce(s, ''), '{L.NAME}')))"
_LAST = f"regexp_extract_all({_LOW}, '[a-z]+')[-1]"
_ADDS = f"(starts_with({_LOW}, '{params.ADDITION}') AND regexp_matches({_LOW}, '\\b({'|'.join(params.ADDITION_VERBS)})\\b'))"
_INC = f"({S.squash('s')} = '' OR NOT {_ADDS} AND ({S.starts(_LOW, L.LOW_VALUE_STARTS)} OR regexp_matches({_LOW}, '^r\\s*[0-9]+(\\.[0-9]+)+\\s+[a-z]') OR length(regexp_replace(s, '[^(]', '', 'g')) > length(regexp_replace(s, '[^)]', '', 'g')) OR (NOT regexp_matches({S.squash('s')}, '[.!?]$') AND ({_LAST} IS NULL OR {_LAST} IN ({S.listed(L.OPEN_ENDINGS)}) OR starts_with({_LOW}, '{params.ADDITION}')))))"
_LV = f"(NOT {_ADDS} AND ({S.starts(_LOW, L.LOW_VALUE_STARTS)} OR {S.any_of(_LOW, L.LOW_VALUE)} OR {S.any_of(S.compact('s'), params.COMPACT_MARKERS)} OR (regexp_matches(s, '[A-Za-z]{{24,}}') AND NOT {S.any_of(_LOW, ('is', 'are'))})))"


_SHOWN = "CASE i % 13 WHEN 3 THEN 'Summary' WHEN 4 THEN 'Objectives, contents' WHEN 5 THEN 'abcdefghijklmnopqrstuvwxyzab' WHEN 6 THEN 'It ends with the' WHEN 7 THEN 'In addition to this it offers a' WHEN 8 THEN 'R 12.3 students must' ELSE s END"


@query("sentence_rules", f"WITH {_SENT.replace('se AS', 'se0 AS')}, se AS (SELECT doc_id, i, {_SHOWN} AS s FROM se0) SELECT doc_id, i, {_HEAD} AS heading, {_INC} AS incomplete, {_LV} AS low_value, regexp_matches(s, '[A-Za-z]{{24,}}') AS spacing FROM se")
def sentence_rules(spark, sf):
    s = F.col("s")
    return _lines(spark, sf).withColumn("s", F.expr(_SHOWN)).select("doc_id", "i", L.is_heading(s).alias("heading"), L.is_incomplete(s).alias("incomplete"), L.is_low_value(s).alias("low_value"), L.has_spacing_artifacts(s).alias("spacing"))


_BIAS = f"CAST(CASE WHEN {S.any_of('x', L.OVERVIEW)} THEN 0.28 ELSE 0 END + CASE WHEN {S.any_of('x', L.LOW_SIGNAL)} THEN -0.42 ELSE 0 END + CASE WHEN {S.any_of('x', L.LOW_VALUE)} THEN -0.9 ELSE 0 END AS DOUBLE)"


@query("section_bias", f"SELECT doc_id, round({_BIAS}, 6) AS bias FROM (SELECT doc_id, lower({S.squash("source || ' ' || text")}) AS x FROM documents)")
def section_bias(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(L.section_bias(F.col("source"), F.col("text")), 6).alias("bias"))


@query("location_and_role", f"""SELECT conv_id, turn, starts_with(q, 'where ') OR {S.any_of("(' ' || q || ' ')", (' located', ' location ', ' address '))} AS location,
CASE WHEN regexp_matches(q, '\\b(hod|head of (the )?department)\\b') THEN 'head of department' WHEN regexp_matches(q, '\\bprincipal\\b') THEN 'principal' WHEN regexp_matches(q, '\\bprofessor\\b') THEN 'professor' END AS role_label FROM (SELECT *, lower({S.squash('text')}) AS q FROM {S.TURNS})""")
def location_and_role(spark, sf):
    return S.turns(spark, sf).select("conv_id", "turn", L.is_location_question(F.col("text")).alias("location"), L.role_label(F.col("text")).alias("role_label"))


_GT = f"CASE WHEN len(list_filter(k, lambda t: t NOT IN ({S.listed(params.GROUNDING_STOPWORDS)}))) > 0 THEN list_filter(k, lambda t: t NOT IN ({S.listed(params.GROUNDING_STOPWORDS)})) ELSE k END"
_KEY = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_DEF = f"""f0 AS (SELECT item_id, lower({S.squash('text')}) AS focus FROM benchmark), f1 AS (SELECT item_id, focus, {_KEY('focus')} AS f, {S.keywords('focus')} AS k0 FROM f0), f2 AS (SELECT *, {S.unique('k0')} AS k FROM f1),
f3 AS (SELECT *, {_GT} AS terms, CASE WHEN len(k) >= 2 AND length(array_to_string(k, '')) >= {params.COMPACT_LENGTH} THEN array_to_string(k, '') END AS form FROM f2),
d0 AS (SELECT item_id AS other, text AS s FROM benchmark), x AS (SELECT f3.*, other, s, ' ' || {_KEY('s')} || ' ' AS pad, lower({S.squash('s')}) AS low FROM f3, d0), h AS (SELECT *, len(list_filter(terms, lambda t: contains(pad, ' ' || t || ' '))) AS hits, f <> '' AND contains(pad, ' ' || f || ' ') AS phrase FROM x)
SELECT item_id, other, CAST(round(CASE WHEN f = '' THEN 0 ELSE CASE WHEN phrase THEN 2.0 + CASE WHEN regexp_matches(split_part(pad, ' ' || f || ' ', 2), '^\\s*({L.DEFINES})\\b') THEN 2.0 ELSE 0 END WHEN form IS NOT NULL AND contains({S.compact('s')}, form) THEN 2.8 ELSE 0 END
+ least(hits, 4) * 0.45 + CASE WHEN len(terms) > 0 AND hits >= greatest(1, len(terms) - 1) THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(low, '\\b({'|'.join(params.STATING_VERBS)})\\b') THEN 0.35 ELSE 0 END + CASE WHEN f <> '' AND starts_with(low, f) THEN 1.0 ELSE 0 END END, 2) AS DOUBLE) AS score FROM h"""


def _focus_pairs(spark, sf):
    b = table(spark, sf, "benchmark")
    f = b.select("item_id", F.lower(T.squash(F.col("text"))).alias("focus"))
    # benchmark items against each other: a fixed, small set of questions
    return f.join(F.broadcast(b.select(F.col("item_id").alias("other"), F.col("text").alias("s"))))


@query("definition_score", f"WITH {_DEF}")
def definition_score(spark, sf):
    return _focus_pairs(spark, sf).select("item_id", "other", L.definition_score(F.col("focus"), F.col("s")).alias("score"))


@query("definition_evidence", f"WITH r AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other) AS rank FROM (WITH {_DEF}) WHERE score >= 1.6) SELECT item_id, other, score, CAST(rank AS INTEGER) AS rank FROM r WHERE score >= best - 1.2 AND rank <= 4")
def definition_evidence(spark, sf):
    d = definition_score(spark, sf).where("score >= 1.6").withColumn("best", F.max("score").over(W.partitionBy("item_id")))
    return ranked(d, ["item_id"], [F.desc("score"), F.asc("other")], 4).where("score >= best - 1.2").select("item_id", "other", "score", "rank")


@query("person_name_cleanup", "SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace('Dr. ' || c_name || ' A B  Assistant Professor, ' || c_mktsegment, '(?i)\\s+(assistant|associate)\\s+professor.*$', ''), '\\b([A-Z])\\s+([A-Z])\\b', '\\1. \\2.', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS name FROM customer")
def person_name_cleanup(spark, sf):
    x = F.concat(F.lit("Dr. "), F.col("c_name"), F.lit(" A B  Assistant Professor, "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", L.person_name(x).alias("name"))


@query("label_aliases", f"""WITH a AS (SELECT p_partkey, list_filter([lower(p_type), lower(regexp_replace(p_type, '([a-z])([A-Z])', '\\1 \\2', 'g')), {S.compact('p_type')}, array_to_string(list_transform(list_filter({S.tokens('p_type')}, lambda t: t NOT IN ({S.listed(params.DEPARTMENT_GENERIC)})), lambda w: substr(w, 1, 1)), '')], lambda x: length(x) >= 2) AS l FROM part)
SELECT p_partkey, array_to_string({S.unique('l')}, '|') AS aliases FROM a""")
def label_aliases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(L.aliases(F.col("p_type")), "|").alias("aliases"))


@query("clean_answer", f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace({S.squash('text')}, '(?i)^(answer|response|final answer)\\s*:\\s*', ''), '\\s+([.,;:!?])', '\\1', 'g'), '^[\"“]+|[\"”]+$', '', 'g')) AS answer FROM conversations WHERE role = 'assistant'")
def clean_answer(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", L.cleaned_answer(F.col("text")).alias("answer"))


@query("generation_evidence", f"WITH {R._FUSED}, x AS (SELECT f.item_id, f.doc_id, f.rank, d.source, row_number() OVER (PARTITION BY f.item_id, d.source ORDER BY f.rank) AS k FROM fused f JOIN documents d USING (doc_id) WHERE f.rank <= 20), y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS r FROM x WHERE k <= 2) SELECT item_id, doc_id, source, CAST(r AS INTEGER) AS rank FROM y WHERE r <= 4")
def generation_evidence(spark, sf):
    f = R.fused(spark, sf).where("rank <= 20").select("item_id", "doc_id", F.col("rank").alias("o"))
    x = f.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return ranked(E.capped(x, ["item_id"], ["source"], [F.asc("o")], F.lit(2)), ["item_id"], [F.asc("o")], 4).select("item_id", "doc_id", "source", "rank")


@query("source_list", f"WITH {R._FUSED}, s AS (SELECT f.item_id, d.source, min(f.rank) AS first FROM fused f JOIN documents d USING (doc_id) WHERE f.rank <= 20 GROUP BY f.item_id, d.source), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first, source) AS k FROM s) SELECT item_id, string_agg(source, ',' ORDER BY k) AS sources FROM r WHERE k <= 4 GROUP BY item_id")
def source_list(spark, sf):
    x = R.fused(spark, sf).where("rank <= 20").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.min("rank").alias("first"))
    top = ranked(x, ["item_id"], [F.asc("first"), F.asc("source")], 4)
    return top.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]), ",").alias("sources"))


@query("focus_filter_with_fallback", f"WITH {R._BM25}, m AS (SELECT bm.item_id, bm.doc_id, lang = 'fr' AS hit, max(lang = 'fr') OVER (PARTITION BY bm.item_id) AS any_hit FROM bm JOIN documents d USING (doc_id) WHERE rank <= 5) SELECT item_id, doc_id FROM m WHERE hit OR NOT any_hit")
def focus_filter_with_fallback(spark, sf):
    x = R.bm25(spark, sf, 5).join(table(spark, sf, "documents").select("doc_id", (F.col("lang") == "fr").alias("hit")), "doc_id")
    return x.withColumn("any_hit", F.max("hit").over(W.partitionBy("item_id"))).where("hit or not any_hit").select("item_id", "doc_id")


@query("best_summary_sentence", f"WITH {_SENT}, w AS (SELECT doc_id, i, s, len(string_split(s, ' ')) AS n FROM se), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i <= 24 AND n BETWEEN 8 AND 48 THEN 0 ELSE 1 END, i) AS k FROM w) SELECT doc_id, i, md5(s) AS s FROM r WHERE k = 1")
def best_summary_sentence(spark, sf):
    n = F.size(F.split("s", " "))
    prefer = F.when((F.col("i") <= 24) & n.between(8, 48), 0).otherwise(1)
    return ranked(_lines(spark, sf).withColumn("prefer", prefer), ["doc_id"], [F.asc("prefer"), F.asc("i")], 1).select("doc_id", "i", F.md5("s").alias("s"))


_SPLIT = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\b(Dr|Mr|Mrs|Ms|Prof)\\. ', '\\1' || chr(1) || ' ', 'g'), '\\b([A-Z])\\. ', '\\1' || chr(1) || ' ', 'g'), '([.!?:])\\s+([A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'), '\\n+', chr(2), 'g')"""
_SS = f"list_filter(list_transform(string_split({_SPLIT}, chr(2)), lambda x: {S.squash("replace(x, chr(1), '.')")}), lambda x: x <> '')"


@query("upload_entities", f"""WITH a AS (SELECT doc_id, {_SS} AS ss FROM documents), e AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM a), f AS (SELECT *, regexp_extract(s, '{D.DEFINITION}', 1) AS label FROM e WHERE i < 240),
g AS (SELECT doc_id, lower(label) AS key, CAST(min(i) AS BIGINT) AS first, arg_min(label, i) AS label, arg_min(s, i) AS description, count(*) AS mentions FROM f WHERE label <> '' GROUP BY doc_id, lower(label)), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM g)
SELECT doc_id, first, label, md5(description) AS description, mentions FROM k WHERE k <= 8""")
def upload_entities(spark, sf):
    return D.defined_entities(table(spark, sf, "documents")).withColumn("description", F.md5("description"))


@query("department_aliases", f"""WITH a AS (SELECT s_suppkey, s_name || ' Engineering (' || substr(s_name, 1, 3) || ' Tech)' AS n FROM supplier), b AS (SELECT s_suppkey, {S.squash("regexp_replace(regexp_replace(lower(n), '&', ' and ', 'g'), '[^a-z0-9() ]', ' ', 'g')")} AS whole,
{S.squash("regexp_replace(lower(regexp_replace(n, '\\s*\\([^)]*\\)', ' ', 'g')), '[^a-z0-9() ]', ' ', 'g')")} AS base, {S.squash("lower(regexp_extract(n, '\\(([^)]+)\\)', 1))")} AS q FROM a)
SELECT s_suppkey, array_to_string(list_filter([whole, base, regexp_replace(base, ' engineering$', ''), array_to_string(list_transform(string_split(base, ' '), lambda w: substr(w, 1, 1)), ''), q], lambda x: length(x) >= 2), '|') AS aliases FROM b""")
def department_aliases(spark, sf):
    n = F.concat(F.col("s_name"), F.lit(" Engineering ("), F.substring("s_name", 1, 3), F.lit(" Tech)"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(L.department_aliases(n), "|").alias("aliases"))


@query("upload_version_sha1", "SELECT source, substr(sha1(string_agg(sha1(text), '' ORDER BY doc_id)), 1, 12) AS version, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source")
def upload_version_sha1(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").groupBy("source")
    marks = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha1("text").alias("h")))), lambda x: x["h"])
    return d.agg(F.substring(F.sha1(F.array_join(marks, "")), 1, 12).alias("version"), F.count("*").alias("n"))


@query("content_overlap", f"""WITH t AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda w: w NOT IN ({S.listed(params.GROUNDING_STOPWORDS)})) AS w FROM benchmark)
SELECT a.item_id, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS overlap FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def content_overlap(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.filter(T.token_set(F.col("text")), lambda w: ~w.isin(*params.GROUNDING_STOPWORDS)).alias("w"))
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return t.join(nxt, "item_id").select("item_id", F.size(F.array_intersect("w", "v")).alias("overlap"))


@query("metadata_fact", f"SELECT n_nationkey, lower(f) = '' OR {S.starts('lower(f)', params.KG_METADATA_PREFIXES)} AS metadata FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Label: ' || n_name WHEN 1 THEN 'Source URL: x' WHEN 2 THEN '' ELSE n_name END AS f FROM nation)")
def metadata_fact(spark, sf):
    k = F.col("n_nationkey") % 4
    f = F.when(k == 0, F.concat(F.lit("Label: "), F.col("n_name"))).when(k == 1, "Source URL: x").when(k == 2, "").otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", L.is_metadata_fact(f).alias("metadata"))


@query("explanation_quality", None)
def explanation_quality(spark, sf):
    x = _focus_pairs(spark, sf).select("item_id", "other", F.concat(F.lit("explain "), F.col("focus")).alias("q"), "s")
    return x.select("item_id", "other", L.quality(F.col("q"), F.lit("overview"), F.col("s"), F.lit(0.5), F.lit(0.0)).alias("quality"))


@query("explanation_evidence", None)
def explanation_evidence(spark, sf):
    x = _focus_pairs(spark, sf).select("item_id", F.col("s").alias("sentence"), L.quality(F.concat(F.lit("explain "), F.col("focus")), F.lit("overview"), F.col("s"), F.lit(0.5), F.lit(0.0)).alias("quality"))
    return E.diverse(x.where("quality >= 0.45").distinct(), "item_id", "sentence", "quality")
