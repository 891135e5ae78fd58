"""The queries op1 to op13, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, blocks, bpe, crf, itemsets, lloyd, lm, minhash, sentencepiece_scan, suffix_dedup, token_output, url_filter, warc, wumanber

#: Rules of op2: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_records(pages: DataFrame) -> DataFrame:
    """Each page as one to three full responses, and a later or earlier re-fetch of its URL that was answered "not modified".

    Pages divisible by 4 have a second response, those divisible by 8 a third, each with its own tag and digest. Every
    third revisit gives a last-modified value only, every fifth a tag of another version, every seventh comes before
    the responses, every other one writes its tag as weak.
    """
    n, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    version = lambda k: html if not k else F.concat(html, F.lit(f"#{k}"))
    tag = lambda k: F.concat(F.lit('"'), F.substring(F.md5(version(k)), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day-"), (n % 365).cast("string"))
    headers = lambda **x: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in x]), F.array(*x.values()))
    size = F.octet_length(html)
    latest = F.when(n % 8 == 0, tag(2)).when(n % 4 == 0, tag(1)).otherwise(tag(0))
    out = []
    for k, of in ((0, pages), (1, pages.where(n % 4 == 0)), (2, pages.where(n % 8 == 0))):
        out.append(of.select(
            (4 * n + k).alias("record_id"), "url", (10 * n + k).alias("ts"), F.lit("response").alias("kind"), tag(k).alias("etag"), day.alias("last_modified"), F.sha1(version(k)).alias("digest"), size.cast("long").alias("length"),
            headers(Content_Type=F.lit("text/html"), Content_Length=size.cast("string"), ETag=tag(k), Date=(10 * n).cast("string"), Cache_Control=F.lit("max-age=60")).alias("headers"),
        ))
    out.append(pages.select(
        (4 * n + 3).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), F.when(n % 7 == 0, 10 * n - 5).otherwise(10 * n + 5).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(n % 3 == 0, None).when(n % 5 == 0, F.lit('"stale"')).when(n % 2 == 0, F.concat(F.lit("W/"), latest)).otherwise(latest).alias("etag"), F.when(n % 3 == 0, day).alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("length"),
        headers(Content_Length=F.lit("0"), Date=(10 * n + 5).cast("string"), Cache_Control=F.lit("max-age=90"), Server=F.lit("edge")).alias("headers"),
    ))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(capture_records(table(spark, sf_dir, "pages")))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return done.select("record_id", "canonical_url", "ts", "status", "matched_id", "matched_ts", "http_status", "digest", "length", flat.alias("headers"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.report(wumanber.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_scan.report(sentencepiece_scan.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{blocks.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    done = blocks.checkpointed(token_output.digests(token_output.read(spark, folder)))
    token_output.remove(folder)  # the query's result is the digests
    return done


def op11_closed_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = itemsets.work_folder(spark)
    done = blocks.checkpointed(itemsets.report(*itemsets.itemsets(table(spark, sf_dir, "sale_lines"), "sale_id", "item_id", folder)))
    itemsets.remove(folder)
    return done


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = lloyd.work_folder(spark)
    done = blocks.checkpointed(lloyd.report(*lloyd.cluster(table(spark, sf_dir, "embeddings"), folder)))
    lloyd.remove(folder)
    return done


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_revisits, op2_url_filter, op3_lm_score, op4_quality_crf, op5_minhash_dedup, op6_decontaminate, op7_sentencepiece, op8_suffix_dedup, op9_ann_search, op10_token_output,
        op11_closed_itemsets, op12_bpe, op13_dual_tree_lloyd,
    )
}

_KEY = """regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) > 0
     THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') ELSE '' END"""

def _lloyd_sql(rounds: int) -> str:
    """Rounds one after another, each as an assignment and its means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT k, j, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r}),
a{r} AS MATERIALIZED (SELECT k, j, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, j) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v JOIN a{r} USING (k)) GROUP BY j, i),
m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return ",\n".join(steps)


ORACLE_SQL = {
    "op1_warc_revisits": f"""
WITH p AS (SELECT page_id AS n, url, coalesce(html, '') AS h, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
k AS (SELECT *, {_KEY} AS key, 'day-' || CAST(n % 365 AS VARCHAR) AS day, strlen(h) AS size FROM p),
v AS (SELECT k.*, j, h || CASE WHEN j = 0 THEN '' ELSE '#' || j END AS text_ FROM k, (VALUES (0), (1), (2)) AS t(j) WHERE j = 0 OR j = 1 AND n % 4 = 0 OR j = 2 AND n % 8 = 0),
full_ AS (SELECT 4 * n + j AS record_id, key, 10 * n + j AS ts, '"' || substr(md5(text_), 1, 16) || '"' AS etag, day AS last_modified, sha1(text_) AS digest, size, n FROM v),
last_ AS (SELECT n, max_by(etag, record_id) AS tag FROM full_ GROUP BY n),
rev AS (SELECT 4 * n + 3 AS record_id, key, CASE WHEN n % 7 = 0 THEN 10 * n - 5 ELSE 10 * n + 5 END AS ts, 10 * n + 5 AS date_,
  CASE WHEN n % 3 = 0 THEN NULL WHEN n % 5 = 0 THEN '"stale"' ELSE tag END AS etag, CASE WHEN n % 3 = 0 THEN day END AS last_modified FROM k JOIN last_ USING (n)),
j AS (SELECT r.*, f.record_id AS matched_id, f.ts AS matched_ts, f.etag AS fe, f.last_modified AS fl, f.digest AS fd, f.size AS fs,
  row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC NULLS LAST) AS rn
  FROM rev r LEFT JOIN full_ f ON f.key = r.key AND f.ts < r.ts),
s AS (SELECT *, CASE WHEN key IS NULL THEN 'no_url' WHEN matched_id IS NULL THEN 'no_response'
  WHEN etag IS NOT NULL AND fe IS NOT NULL THEN CASE WHEN etag = fe THEN 'resolved' ELSE 'mismatch' END
  WHEN last_modified IS NOT NULL AND fl IS NOT NULL THEN CASE WHEN last_modified = fl THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS status FROM j WHERE rn = 1)
SELECT record_id, key AS canonical_url, ts, status, matched_id, matched_ts, CASE WHEN status IN ('resolved', 'unvalidated') THEN 200 ELSE 304 END AS http_status,
  CASE WHEN status IN ('resolved', 'unvalidated') THEN fd END AS digest, CASE WHEN status IN ('resolved', 'unvalidated') THEN fs END AS length,
  CASE WHEN status IN ('resolved', 'unvalidated') THEN 'cache-control=max-age=90|content-length=' || CAST(fs AS VARCHAR) || '|content-type=text/html|date=' || CAST(date_ AS VARCHAR) || '|etag=' || fe END AS headers
FROM s""",
    "op2_url_filter": """
WITH r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS k, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT u.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC NULLS LAST) AS n
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE n = 1""",
    "op6_decontaminate": """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, w[i : i + least(len(w), 10) - 1] AS p FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, m, i, w[i : i + m - 1] AS p FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(i)),
hit AS (SELECT doc_id, i, dw.m AS m, item FROM dw JOIN bw ON dw.p = bw.p AND dw.m = bw.m),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM hit), unnest(range(i, i + m)) AS t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_closed_itemsets": """
WITH RECURSIVE l AS (SELECT DISTINCT sale_id AS b, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT b) AS baskets, greatest(8, CAST(ceil(count(DISTINCT b) / 5000) AS BIGINT)) AS least FROM l),
one AS (SELECT i, count(*) AS s FROM l GROUP BY i HAVING count(*) >= (SELECT least FROM n)),
o AS (SELECT b, i FROM l SEMI JOIN one USING (i)),
sets AS (
  SELECT [i] AS items, i AS last, list(b) AS held FROM o GROUP BY i
  UNION ALL
  SELECT list_append(items, i), i, list(b) FROM (SELECT items, last, unnest(held) AS b FROM sets) f JOIN o USING (b) WHERE i > last GROUP BY items, i HAVING count(*) >= (SELECT least FROM n)),
f AS (SELECT items, CAST(len(held) AS BIGINT) AS support FROM sets),
part AS (SELECT list_filter(items, lambda x: x <> c) AS items, c, support, items AS of_ FROM (SELECT *, unnest(items) AS c FROM f WHERE len(items) > 1)),
open_ AS (SELECT DISTINCT f.items FROM f JOIN part p ON p.items = f.items AND p.support = f.support),
closed AS (SELECT * FROM f ANTI JOIN open_ USING (items)),
rule AS (SELECT p.of_ AS items, p.c, f.support AS a, one.s, row_number() OVER (PARTITION BY p.of_ ORDER BY f.support, p.c) AS k
  FROM part p JOIN f ON f.items = p.items JOIN one ON one.i = p.c, n WHERE 100 * p.support >= 10 * f.support AND p.support * CAST(n.baskets AS HUGEINT) > f.support * CAST(one.s AS HUGEINT)),
r AS (SELECT items, count(*) AS n_rules, max(CASE WHEN k = 1 THEN c END) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS told FROM rule GROUP BY items)
SELECT array_to_string(closed.items, ',') AS items, CAST(len(closed.items) AS BIGINT) AS n_items, support, coalesce(n_rules, 0) AS n_rules, best_item, sha256(coalesce(told, '')) AS rules_sha256
FROM closed LEFT JOIN r USING (items)""",
    "op13_dual_tree_lloyd": f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS k, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, e) - 1 AS j, e AS c FROM v WHERE vec_id IS NOT NULL QUALIFY j < 8),
{_lloyd_sql(10)}
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN v USING (k) JOIN c10 USING (j)""",
}
