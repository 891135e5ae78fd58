"""Queries of text functions and document processing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule import params
from ferrule.functions import python_udfs
from ferrule.functions import text as T
from ferrule.operators import docs as D
from ferrule.operators import html as H

from . import common as S
from .common import table

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("text_normalize", f"SELECT doc_id, md5({S.squash('text')}) AS squashed, md5({S.searchable('text')}) AS searchable FROM documents")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squash(F.col("text"))).alias("squashed"), F.md5(T.searchable(F.col("text"))).alias("searchable"))


@query("text_keywords", f"WITH k AS (SELECT doc_id, {S.keywords('text')} AS k FROM documents) SELECT doc_id, CAST(len({S.unique('k')}) AS BIGINT) AS n, md5(array_to_string({S.unique('k')}, ' ')) AS keywords FROM k")
def text_keywords(spark, sf):
    k = T.keywords(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("keywords"))


@query("text_compact", f"WITH k AS (SELECT item_id, text, {S.keywords('text')} AS k FROM benchmark) SELECT item_id, {S.compact('text')} AS compact, CASE WHEN len({S.unique('k')}) >= 2 AND length(array_to_string({S.unique('k')}, '')) >= {params.COMPACT_LENGTH} THEN array_to_string({S.unique('k')}, '') END AS form FROM k")
def text_compact(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.compact(F.col("text")).alias("compact"), T.compact_form(F.col("text")).alias("form"))


@query("text_slug", "SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)")
def text_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("text_spacing", "SELECT page_id, regexp_replace(regexp_replace(url, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS spaced FROM pages")
def text_spacing(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.spaced(F.col("url")).alias("spaced"))


@query("chunk_id_sha1", f"SELECT doc_id, substr(sha1(source || '|' || coalesce(CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS VARCHAR), 'None') || '|' || substr({S.squash('text')}, 1, 240)), 1, 16) AS chunk_id FROM documents")
def chunk_id_sha1(spark, sf):
    page = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 7)
    return table(spark, sf, "documents").select("doc_id", T.chunk_id(F.col("source"), page, F.col("text")).alias("chunk_id"))


_POLITE, _OPENING = (params.words_pattern(x).replace("'", "''") for x in (params.POLITE_OPENINGS, params.INTENT_OPENINGS))
_BARE = f"""regexp_replace(regexp_replace(trim(regexp_replace({S.squash('text')}, '(?i)^({_POLITE}\\s+)+', '')), '(?i)^{_OPENING}\\s+', ''), '^[ :;,.?-]+|[ :;,.?-]+$', '', 'g')"""


@query("query_strip_intent", f"SELECT conv_id, turn, CASE WHEN b = '' THEN {S.squash('text')} ELSE b END AS bare FROM (SELECT *, {_BARE} AS b FROM conversations)")
def query_strip_intent(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.without_intent(F.col("text")).alias("bare"))


@query("focus_phrase", f"SELECT conv_id, turn, regexp_replace(lower(CASE WHEN b = '' THEN {S.squash('text')} ELSE b END), '^(the|a|an)\\s+', '') AS focus FROM (SELECT *, {_BARE} AS b FROM conversations)")
def focus_phrase(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.focus_phrase(F.col("text")).alias("focus"))


@query("noise_line_filter", f"WITH l AS (SELECT doc_id, unnest({S.lines('text')}) AS s FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({S.noise('s')}) AS n_noise FROM l GROUP BY doc_id")
def noise_line_filter(spark, sf):
    ls = D.lines_of(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(ls).cast("long").alias("n_lines"), F.size(F.filter(ls, T.is_noise)).cast("long").alias("n_noise")).where("n_lines > 0")


def _penalty_sql(x: str) -> str:
    low = f"lower({S.squash(x)})"
    return f"CASE WHEN {S.any_of(low, params.FRONT_MATTER)} THEN 0.26 ELSE 0 END + CASE WHEN {S.any_of(S.compact(x), params.COMPACT_MARKERS)} THEN 0.2 ELSE 0 END + CASE WHEN {S.any_of(low, params.LOW_SIGNAL)} THEN 0.12 ELSE 0 END + least(0.12, 0.04 * len(regexp_extract_all({low}, '[a-z]{{24,}}')))"


@query("section_penalty", f"SELECT doc_id, CAST(round({_penalty_sql('t')}, 6) AS DOUBLE) AS penalty FROM (SELECT doc_id, {S.marked('text', 'doc_id')} AS t FROM documents)")
def section_penalty(spark, sf):
    shown = T.once(table(spark, sf, "documents").select("doc_id", "text"), "t", F.expr(S.marked("text", "doc_id")))
    return shown.select("doc_id", F.round(T.section_penalty(F.col("t")), 6).alias("penalty"))


@query("clean_repeated_lines", f"""WITH l AS (SELECT doc_id, {S.lines('text')} AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY i) AS k FROM e WHERE NOT {S.noise('s')})
SELECT doc_id, count(*) AS n_lines, md5(string_agg(s, chr(10) ORDER BY i)) AS cleaned FROM f WHERE k = 1 OR len(string_split(s, ' ')) > 10 GROUP BY doc_id""")
def clean_repeated_lines(spark, sf):
    return D.clean_page(table(spark, sf, "documents")).withColumn("cleaned", F.md5("cleaned"))


@query("clean_dedupe_lines", f"""WITH l AS (SELECT doc_id, {S.lines('text')} AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(s)) AS n FROM e),
f AS (SELECT * FROM c WHERE regexp_full_match(s, '\\[PAGE\\s+[0-9]+\\]') OR (NOT {S.noise('s')} AND NOT (n > 2 AND len(string_split(s, ' ')) <= 6))),
g AS (SELECT *, lag(lower(s)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM f)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(s, chr(10) ORDER BY i)) AS cleaned FROM g WHERE b IS NULL OR b <> lower(s) OR len(string_split(s, ' ')) > 20 GROUP BY doc_id""")
def clean_dedupe_lines(spark, sf):
    return D.clean_document(table(spark, sf, "documents")).withColumn("cleaned", F.md5("cleaned"))


@query("line_frequency", f"WITH l AS (SELECT doc_id, unnest({S.lines('text')}) AS s FROM documents) SELECT doc_id, md5(lower(s)) AS line, count(*) AS n FROM l GROUP BY doc_id, lower(s) HAVING count(*) > 1")
def line_frequency(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", F.explode(D.lines_of(F.col("text"))).alias("s"))
    return e.groupBy("doc_id", F.md5(F.lower("s")).alias("line")).agg(F.count("*").alias("n")).where("n > 1")


_MARKED = "regexp_replace(text, '\\n', chr(10) || '[PAGE 7] ', 'g')"


@query("page_sections", f"""WITH p AS (SELECT doc_id, string_split(replace('[PAGE ]' || {_MARKED}, '[PAGE', chr(1) || '[PAGE'), chr(1)) AS ps FROM documents),
e AS (SELECT doc_id, unnest(list_filter(ps, lambda x: x <> '')) AS p, generate_subscripts(list_filter(ps, lambda x: x <> ''), 1) - 1 AS seq FROM p),
s AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, TRY_CAST(nullif(regexp_extract(p, '^\\[PAGE\\s*([0-9]*)\\]', 1), '') AS INTEGER) AS page, {S.squash("regexp_replace(p, '^\\[PAGE\\s*[0-9]*\\]', '')")} AS section FROM e)
SELECT doc_id, seq, page, md5(section) AS section FROM s WHERE section <> ''""")
def page_sections(spark, sf):
    marked = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n[PAGE 7] ").alias("text"))
    return D.page_sections(marked).withColumn("section", F.md5("section"))


_SENT = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\b(Dr|Mr|Mrs|Ms|Prof)\\. ', '\\1' || chr(1) || ' ', 'g'), '\\b([A-Z])\\. ', '\\1' || chr(1) || ' ', 'g'), '([.!?:])\\s+([A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'), '\\n+', chr(2), 'g')"""
_SENTS = f"list_filter(list_transform(string_split({_SENT}, chr(2)), lambda x: {S.squash("replace(x, chr(1), '.')")}), lambda x: x <> '')"


@query("sentence_split", f"WITH s AS (SELECT doc_id, {_SENTS} AS ss FROM documents) SELECT doc_id, CAST(len(ss) AS BIGINT) AS n, md5(array_to_string(ss, chr(10))) AS sentences FROM s")
def sentence_split(spark, sf):
    s = D.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\n")).alias("sentences"))


@query("sentence_dedupe", f"""WITH s AS (SELECT doc_id, unnest({_SENTS}) AS s FROM documents), k AS (SELECT doc_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS key FROM s)
SELECT key, min(doc_id) AS first_doc, count(*) AS n FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1""")
def sentence_dedupe(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(D.sentences(F.col("text"))).alias("s"))
    return s.groupBy(T.sentence_key(F.col("s")).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("key <> '' and n > 1")


@query("chunk_fixed_stride", f"""WITH t AS (SELECT doc_id, {S.squash('text')} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(0, length(t) - {params.CHUNK_OVERLAP} - 1) + 1, {params.CHUNK_SIZE - params.CHUNK_OVERLAP})) AS a FROM t WHERE t <> '')
SELECT doc_id, CAST(a // {params.CHUNK_SIZE - params.CHUNK_OVERLAP} AS BIGINT) AS chunk_index, md5(substr(t, a + 1, {params.CHUNK_SIZE})) AS text FROM c""")
def chunk_fixed_stride(spark, sf):
    return D.fixed_chunks(table(spark, sf, "documents")).withColumn("text", F.md5("text"))


@query("chunk_recursive", None)
def chunk_recursive(spark, sf):
    return D.recursive_chunks(table(spark, sf, "documents"))


@query("html_title", f"SELECT page_id, {S.squash("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", D.html_title(F.col("html")).alias("title"))


def _html_sql() -> str:
    x = "coalesce(html, '')"
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "form", "svg", "aside"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"


def _plain_sql() -> str:
    x = "regexp_replace(regexp_replace(regexp_replace(CASE WHEN m <> '' THEN m ELSE x END, '(?i)<h[1-4]\\b[^>]*>', chr(10) || chr(1), 'g'), '(?i)</?(p|div|h[1-6]|li|br|tr|td|section)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


@query("html_text", f"""WITH a AS (SELECT page_id, {_html_sql()} AS x FROM pages), b AS (SELECT *, regexp_extract(x, '(?is)<(?:main|article)\\b[^>]*>(.*?)</(?:main|article)>', 1) AS m FROM a),
c AS (SELECT page_id, {_plain_sql()} AS t FROM b), l AS (SELECT page_id, {S.lines('t')} AS ls FROM c), e AS (SELECT page_id, unnest(ls) AS s0, generate_subscripts(ls, 1) AS i FROM l), g AS (SELECT page_id, i, replace(s0, chr(1), '') AS s FROM e WHERE len(string_split(s0, ' ')) >= 3 OR starts_with(s0, chr(1)) AND length(s0) > 1),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(s) ORDER BY i) AS k FROM g)
SELECT page_id, count(*) AS n_lines, md5(string_agg(s, chr(10) ORDER BY i)) AS text FROM f WHERE k = 1 GROUP BY page_id""")
def html_text(spark, sf):
    return D.html_text(table(spark, sf, "pages")).select("page_id", "n_lines", F.md5("cleaned").alias("text"))


_HTML = "CASE page_id % 3 WHEN 1 THEN replace(html, '<article>', '<article><h2>Short news</h2><div><h4>Dr. Anna Berg</h4> Head of store</div>') WHEN 2 THEN replace(html, '</article>', '<ul><li>Posted on : 1 May</li></ul><h2>Open day</h2><h2>Second day</h2></article>') ELSE html END"
_HEAD_TEXT = S.squash("replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&copy;', '©'), '&amp;', '&')")


@query("html_headings", f"""WITH p AS (SELECT page_id, {_HTML} AS html FROM pages), a AS (SELECT page_id, {_html_sql()} AS x FROM p), h AS (SELECT page_id, unnest(regexp_extract_all(x, '(?is)<h[1-4]\\b[^>]*>.*?</h[1-4]>')) AS h, generate_subscripts(regexp_extract_all(x, '(?is)<h[1-4]\\b[^>]*>.*?</h[1-4]>'), 1) AS i FROM a),
t AS (SELECT page_id, i, lower(substr(h, 2, 2)) AS tag, {_HEAD_TEXT} AS text FROM h) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS k, tag, text FROM t WHERE text <> ''""")
def html_headings(spark, sf):
    return H.headings(_tree(spark, sf))


def _tree(spark, sf):
    """Elements of the pages, some of which say more in their structure."""
    return H.nodes(table(spark, sf, "pages").select("page_id", F.expr(_HTML).alias("html")))


@query("html_people", "SELECT page_id, 'Dr. Anna Berg' AS name, 'Head of store' AS designation FROM pages WHERE page_id % 3 = 1 AND contains(html, '<article>')")
def html_people(spark, sf):
    return H.people(_tree(spark, sf)).where("name = 'Dr. Anna Berg'").select("page_id", "name", "designation")


@query("html_news", "SELECT page_id, unnest(['Open day', 'Second day']) AS title, '1 May' AS posted_on FROM pages WHERE page_id % 3 = 2 AND contains(html, '</article>')")
def html_news(spark, sf):
    return H.dated_items(_tree(spark, sf)).where("posted_on is not null").select("page_id", "title", "posted_on")


@query("html_links", f"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base, regexp_extract_all(coalesce(html, ''), '(?is)<a\\s+href="([^"]*)"[^>]*>(.*?)</a>') AS ls FROM pages),
e AS (SELECT page_id, base, unnest(ls) AS a, generate_subscripts(ls, 1) AS i FROM a),
h AS (SELECT page_id, base, i, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS h, {S.squash("regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]*>', '', 'g')")} AS label FROM e)
SELECT page_id, CASE WHEN starts_with(h, '/') THEN base || h ELSE h END AS url, arg_min(label, i) AS label FROM h WHERE label <> '' GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY page_id, CASE WHEN starts_with(h, '/') THEN base || h ELSE h END"))
def html_links(spark, sf):
    return D.html_links(table(spark, sf, "pages"))


def _gram_sql(k: int) -> str:
    every = f"list_transform(range(1, len(t) - {k} + 2), lambda i: array_to_string(t[i : i + {k - 1}], ' '))"
    if k == 1:
        every = f"list_filter({every}, lambda p: length(p) >= 3 OR regexp_matches(p, '[0-9]'))"
    return f"CASE WHEN len(t) >= {k} THEN {every} ELSE [] END"


@query("ngram_phrases", f"""WITH a AS (SELECT item_id, list_filter({S.tokens('text')}, lambda w: w NOT IN ({S.listed(params.STOPWORDS)})) AS t FROM benchmark),
b AS (SELECT item_id, CASE WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END || {_gram_sql(4)} || {_gram_sql(3)} || {_gram_sql(2)} || {_gram_sql(1)} AS p FROM a), u AS (SELECT item_id, {S.unique('p')} AS p FROM b)
SELECT item_id, unnest(p) AS phrase, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS priority FROM u""")
def ngram_phrases(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(D.phrases(F.col("text"))).alias("priority", "phrase"))
    return b.select("item_id", "phrase", F.col("priority").cast("long").alias("priority"))


@query("token_estimate", f"SELECT doc_id, CAST(greatest(1, floor({S.word_count('text')} * 1.3)) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("department_initials", f"SELECT n_nationkey, upper(substr(n_name, 1, 1)) AS head, array_to_string(list_transform(list_filter({S.tokens('n_name')}, lambda t: t NOT IN ({S.listed(params.DEPARTMENT_GENERIC)})), lambda w: substr(w, 1, 1)), '') AS initials FROM nation")
def department_initials(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.upper(F.substring("n_name", 1, 1)).alias("head"), T.initials(F.col("n_name")).alias("initials"))


@query("sse_word_chunks", f"""WITH w AS (SELECT doc_id, list_filter(string_split({S.squash('text')}, ' '), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 8)) AS a FROM w)
SELECT doc_id, CAST(a // 8 AS BIGINT) AS seq, md5(array_to_string(w[a + 1 : a + 8], ' ')) AS chunk FROM c""")
def sse_word_chunks(spark, sf):
    w = F.filter(F.split(T.squash(F.col("text")), " "), lambda x: x != "")
    d = table(spark, sf, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    e = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(8)), lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("seq", "c"))
    return e.select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("c").alias("chunk"))


@query("text_nfkc", None)
def text_nfkc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", python_udfs.nfkc(F.col("text")).alias("text"))


@query("text_similarity", None)
def text_similarity(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("item_id"), python_udfs.similarity(F.col("a.text"), F.col("b.text")).alias("ratio"))
