"""URL rules by hashed host-suffix and path-prefix expressions.

A rule is a host and a path, written one after the other ("example.com/en/"). A URL becomes the
expressions (host suffix at a label, path prefix of a length that some rule has). Expressions and rules
meet by an equi-join on the first 4 bytes of their SHA-256; the full digest then confirms, and of the rules
that fit a URL the longest wins, of equally long ones the one with the longer host, then block over allow.

Cases. A null URL, or one without "://", has empty host and path and fits no rule but one whose host and
path are empty. Where no rule fits, the rule is null and the verdict is the method's own, allow: a URL that
is not listed is not blocked. Repeated pages each give a row; an empty table gives none; rules given twice
count once. A very long host or path has as many expressions as it has labels times lengths of rules' paths. A null id is one of its own.
Columns other than the id and the URL are not read, so their names can't clash.

Rows that agree in id, host and path are brought together first and counted, and given out again in the end. That is
the only shuffle where rules are broadcast: what the join finds stays in the partition of its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
#: Rules are broadcast if their strings, digests and 200 bytes for each make no more than this; more are shuffled by hash prefix.
BROADCAST_BYTES, RULE_BYTES = 32 << 20, 200
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (host, path, verdict)."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All host suffixes, each with the path's prefixes of these lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages."""
    given = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull()).distinct()
    # the lengths that occur in rules: no more than the longest rule has characters
    lengths = sorted(r[0] for r in given.select(F.length("path")).distinct().collect())
    size = given.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + F.lit(RULE_BYTES).cast("long")), F.lit(0))).first()[0]
    few = size <= BROADCAST_BYTES
    digest = lambda x: F.sha2(x, 256)
    listed = given.select(
        F.concat("host", "path").alias("_rule"), F.length("host").alias("_host_length"), F.col("verdict").alias("_verdict"), digest(F.concat("host", "path")).alias("_digest")
    ).withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = urls.groupBy(id_col, "host", "path").agg(F.count("*").cast("int").alias("_copies"))
    spread = urls.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths)).alias("_expression"))
    spread = spread.withColumn("_expression_digest", digest(F.col("_expression"))).withColumn("_prefix", F.substring("_expression_digest", 1, PREFIX_HEX))
    met = spread.join(F.broadcast(listed) if few else listed, "_prefix", "left")
    fits = F.col("_digest") == F.col("_expression_digest")
    best = F.max(F.when(fits, F.struct(F.length("_rule"), "_host_length", F.col("_verdict") == "block", "_rule", "_verdict")))
    return (
        met.groupBy(id_col, "host", "path").agg(best.alias("_best"), F.max("_copies").alias("_copies"))
        .select(id_col, "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"))
        .drop("_copy")
    )
