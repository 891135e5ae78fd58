"""Queries of ingestion state, history and, beyond the reference, windows over events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.operators import docs as D
from ferrule.operators import ingest as I

from .common import table

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_SNAP = "n AS (SELECT page_id, sha256(coalesce(html, '')) AS m FROM pages WHERE page_id % 10 <> 9), o AS (SELECT page_id, sha256(coalesce(CASE WHEN page_id % 4 = 0 THEN html || '!' ELSE html END, '')) AS m FROM pages WHERE page_id % 10 <> 1)"


def _snapshots(spark, sf):
    p = table(spark, sf, "pages")
    old = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return p.where("page_id % 10 <> 9").select("page_id", I.fingerprint(F.col("html")).alias("m")), p.where("page_id % 10 <> 1").select("page_id", I.fingerprint(old).alias("m"))


@query("page_fingerprint", "SELECT page_id, sha256(coalesce(html, '')) AS fingerprint FROM pages")
def page_fingerprint(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.fingerprint(F.col("html")).alias("fingerprint"))


@query("change_detection", f"WITH {_SNAP} SELECT page_id, CASE WHEN n.m IS NULL THEN 'gone' WHEN o.m IS NULL THEN 'new' WHEN n.m <> o.m THEN 'changed' ELSE 'same' END AS change FROM n FULL JOIN o USING (page_id)")
def change_detection(spark, sf):
    return I.changes(*_snapshots(spark, sf), "page_id", "m")


@query("changed_count", f"WITH {_SNAP} SELECT count(*) FILTER (o.m IS NULL OR n.m <> o.m) AS changed, count(*) AS n FROM n LEFT JOIN o USING (page_id)")
def changed_count(spark, sf):
    c = I.changes(*_snapshots(spark, sf), "page_id", "m").where("change <> 'gone'")
    return c.agg(F.count_if(F.col("change").isin("new", "changed")).alias("changed"), F.count("*").alias("n"))


@query("upsert_latest", f"WITH {_SNAP}, u AS (SELECT page_id, m, 1 AS v FROM n UNION ALL SELECT page_id, m, 0 FROM o) SELECT page_id, arg_max(m, v) AS m, max(v) AS v FROM u GROUP BY page_id")
def upsert_latest(spark, sf):
    n, o = _snapshots(spark, sf)
    return I.latest(n.withColumn("v", F.lit(1)).unionByName(o.withColumn("v", F.lit(0))), ["page_id"], [F.desc("v")])


@query("index_version_hash", f"WITH {_SNAP}, r AS (SELECT substr(m, 1, 3) AS r, sha256(string_agg(m, '' ORDER BY m)) AS h, count(*) AS n FROM n GROUP BY 1) SELECT substr(sha256(string_agg(h, '' ORDER BY r)), 1, 12) AS version, CAST(sum(n) AS BIGINT) AS n FROM r")
def index_version_hash(spark, sf):
    return I.version(_snapshots(spark, sf)[0], "m")


@query("run_log_latest", "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def run_log_latest(spark, sf):
    return I.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "ts")


_STAGE = "CASE event_type WHEN 'signup' THEN 15 WHEN 'view' THEN 40 WHEN 'click' THEN 75 WHEN 'purchase' THEN 90 ELSE 100 END"


@query("upload_state_latest", f"SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN p = 100 THEN 'indexed' ELSE event_type END AS status, p AS progress FROM (SELECT *, {_STAGE} AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upload_state_latest(spark, sf):
    last = run_log_latest(spark, sf)
    p = F.when(F.col("event_type") == "signup", 15).when(F.col("event_type") == "view", 40).when(F.col("event_type") == "click", 75).when(F.col("event_type") == "purchase", 90).otherwise(100)
    return last.select("user_id", F.when(F.col("event_type") == "error", "failed").when(p == 100, "indexed").otherwise(F.col("event_type")).alias("status"), p.alias("progress"))


@query("status_counts", "SELECT count(*) FILTER (event_type <> 'error') AS pending, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) AS users FROM events")
def status_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.count_if(F.col("event_type") != "error").alias("pending"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("user_id").alias("users"))


@query("lru_keep_latest", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) GROUP BY user_id ORDER BY 2 DESC, 3 DESC LIMIT 128")
def lru_keep_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return I.keep_recent(e, "user_id", [F.desc("ts"), F.desc("event_id")], 128)


@query("history_tail", "SELECT event_id, ts, event_type, coalesce(CAST(value AS VARCHAR), '') <> '' AS has_value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_tail(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "event_type", F.col("value").isNotNull().alias("has_value"))


@query("readiness_snapshot", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'empty' WHEN (SELECT count(*) FROM embeddings) = 0 THEN 'unindexed' ELSE 'ready' END AS state")
def readiness_snapshot(spark, sf):
    one = lambda t, n: table(spark, sf, t).agg(F.count("*").alias(n))
    errors = table(spark, sf, "events").where("event_type = 'error'").agg(F.count("*").alias("errors"))
    x = one("documents", "documents").join(one("embeddings", "vectors")).join(errors)  # three rows of one
    return x.withColumn("state", I.readiness(F.col("documents"), F.col("vectors"), F.lit(False)))


@query("readiness_checks", """WITH c AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM embeddings) AS v, (SELECT count(*) FROM nation) AS f)
SELECT 'backend' AS name, true AS ok, 'API reachable' AS detail FROM c UNION ALL SELECT 'llm', false, '' FROM c UNION ALL SELECT 'vector', v > 0 AND d > 0, d || ' chunks' FROM c UNION ALL SELECT 'kg', f > 0, CASE WHEN f > 0 THEN 'Connected' ELSE 'Unavailable' END FROM c
UNION ALL SELECT 'documents', d > 0, CAST(d AS VARCHAR) FROM c UNION ALL SELECT 'index_version', false, 'uninitialized' FROM c""")
def readiness_checks(spark, sf):
    n = lambda t: table(spark, sf, t).agg(F.count("*").alias(t))
    x = n("documents").join(n("embeddings")).join(n("nation"))  # three rows of one
    checks = I.readiness_checks(F.col("documents"), F.col("embeddings"), F.col("documents"), F.col("nation"), F.lit(None).cast("string"), F.lit(""))
    return x.select(F.explode(checks).alias("c")).select("c.name", "c.ok", "c.detail")


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carry_forward(spark, sf):
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf, "events").select("event_id", D.carry_forward(None, v, ["user_id"], ["ts", "event_id"]).alias("last_purchase"))


@query("stale_purge", "SELECT page_id FROM pages WHERE page_id % 10 <> 1 EXCEPT SELECT page_id FROM pages WHERE page_id % 10 <> 9")
def stale_purge(spark, sf):
    n, o = _snapshots(spark, sf)
    return o.select("page_id").join(n.select("page_id"), "page_id", "left_anti")


@query("entity_merge_first_nonempty", "SELECT source, arg_min(lang, doc_id) FILTER (lang <> '' AND doc_id % 3 <> 0) AS lang, arg_min(text, doc_id) FILTER (text <> '') AS head, count(*) AS n FROM documents GROUP BY source")
def entity_merge_first_nonempty(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.col("text").alias("head"))
    return I.merged(d, "source", "doc_id", ["lang", "head"], []).join(d.groupBy("source").agg(F.count("*").alias("n")), "source")


@query("entity_merge_list_union", "WITH f AS (SELECT user_id, event_type, min(ts) AS t, min(event_id) AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1 GROUP BY user_id, event_type) SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS types FROM f GROUP BY user_id")
def entity_merge_list_union(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.array("event_type").alias("types"))
    return I.merged(e, "user_id", "event_id", [], ["types"]).select("user_id", F.array_join("types", ",").alias("types"))


@query("department_faculty_count", "SELECT n_name, count(s_suppkey) AS faculty FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def department_faculty_count(spark, sf):
    n = table(spark, sf, "nation")
    return n.join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("faculty"))


@query("domain_lexicon", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{3,}')) AS word FROM part) GROUP BY word")
def domain_lexicon(spark, sf):
    w = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return table(spark, sf, "part").select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# Beyond the reference: event-time windows, rollups and an as-of join.


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    e = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("events_sliding", "SELECT time_bucket(INTERVAL 1 hour, ts) - o * INTERVAL 1 hour AS start, count(*) AS n FROM events, (VALUES (0), (1), (2)) x(o) GROUP BY 1")
def events_sliding(spark, sf):
    e = table(spark, sf, "events").select(F.explode(F.array(*[F.expr(f"cast(date_trunc('hour', ts) as timestamp_ntz) - interval {k} hours") for k in range(3)])).alias("start"))
    return e.groupBy("start").agg(F.count("*").alias("n"))


@query("events_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 hour THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    b = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    s = table(spark, sf, "events").withColumn("b", b).withColumn("k", F.sum("b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).drop("k")


@query("orders_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def orders_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("orders_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("asof_last_event", "SELECT e.event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events e")
def asof_last_event(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("click_id"))
