"""Not-modified revisits resolved by an as-of join to the latest earlier full response.

A revisit ("not modified") record holds no body: its content is that of the latest full response of the
same canonical URL strictly before it. The two agree only if the revisit's validators do: an entity tag,
where both have one, decides (by weak comparison: W/"v" agrees with "v"); else the last-modified value, where both have one. A resolved revisit is a
200 response whose headers are the response's, with those replaced that a 304 may carry (PERMITTED).

The join is a running maximum over the distinct times of a URL, cut into blocks of time at quantiles of all records,
one for about BLOCK_ROWS of them: within a block by window, and across blocks from one summary row a URL and block.
Only times go through the windows; the response is joined at its time in the end. So a URL that has a third of
all records fills many tasks, whatever their times, and many records of one URL and time are one row there.

Cases. Very long URLs and headers are kept as they are. Null URL or time: status no_url or no_time. No earlier response: no_response. Different validators:
mismatch; no validator in common: unvalidated, which is taken as resolved by time alone. Equal times: a
response at the revisit's own time isn't earlier; of several equally late ones the largest record id counts.
Full responses aren't returned. Repeated rows each count; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header fields, in lower case, that a 304 response may bring up to date (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
BLOCK_ROWS, MOST_BLOCKS = 200_000, 1 << 14


def canonical(url: Column) -> Column:
    """Host in lower case without default port, no scheme and fragment, no trailing slash, query parameters sorted without utm_*."""
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def lower_keys(headers: Column) -> Column:
    """The header map with names in lower case; of names that then agree the last stays; null counts as no headers."""
    entries = F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"]))


def block_of(ts: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds ts has reached, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    padded = F.array(*[F.lit(b).cast("long") for b in bounds])
    reached = lambda i: (i <= len(bounds)) & (F.try_element_at(padded, F.greatest(F.least(i, F.lit(len(bounds))), F.lit(1))) <= ts)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)]), F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))


def resolve(records: DataFrame, time_blocks: int | None = None) -> DataFrame:
    """records: record_id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified, digest, length, headers (map).

    One row a revisit: record_id, canonical_url, ts, status, matched_id, matched_ts, http_status, digest, length, headers.
    """
    r = records.select(
        "record_id", canonical(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), F.coalesce(F.col("kind") == "response", F.lit(False)).alias("full"), "etag", "last_modified", "digest", "length",
        lower_keys(F.col("headers")).alias("headers"),
    )
    times = records.select(F.col("ts").cast("long").alias("ts"))
    n = time_blocks or min(MOST_BLOCKS, max(1, times.count() // BLOCK_ROWS))
    bounds = sorted(set(times.agg(F.percentile_approx("ts", [k / n for k in range(1, n)], 4 * n)).first()[0] or [])) if n > 1 else []
    timed = r.where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    seen = timed.groupBy("key", "ts").agg(F.max("full").alias("full")).withColumn("block", block_of(F.col("ts"), bounds))
    response = F.when(F.col("full"), F.col("ts"))
    summary = seen.groupBy("key", "block").agg(F.max(response).alias("latest"))
    carried = summary.select("key", "block", F.max("latest").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    within = seen.select("key", "block", "ts", F.max(response).over(W.partitionBy("key", "block").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)).alias("here"))
    asof = within.join(carried, ["key", "block"]).select("key", "ts", F.coalesce("here", "before").alias("_at"))
    body = F.struct("record_id", "etag", "last_modified", "digest", "length", F.to_json("headers").alias("headers"))
    bodies = timed.where("full").groupBy("key", F.col("ts").alias("_at")).agg(F.max(body).alias("m"))
    revisits = r.where(~F.col("full")).drop("full")
    both = revisits.join(asof, ["key", "ts"], "left").join(bodies, ["key", "_at"], "left")  # rows without URL or time meet none
    tag = lambda x: F.regexp_replace(x, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("m.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("m.last_modified").isNotNull()
    status = (
        F.when(F.col("key").isNull(), "no_url").when(F.col("ts").isNull(), "no_time").when(F.col("m").isNull(), "no_response")
        .when(tags, F.when(tag(F.col("etag")) == tag(F.col("m.etag")), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("m.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    both = both.withColumn("status", status)
    whole = F.col("status").isin("resolved", "unvalidated")
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(F.from_json("m.headers", "map<string,string>"), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return both.select(
        "record_id", F.col("key").alias("canonical_url"), "ts", "status", F.col("m.record_id").alias("matched_id"), F.col("_at").alias("matched_ts"),
        F.when(whole, 200).otherwise(304).alias("http_status"), F.when(whole, F.col("m.digest")).alias("digest"), F.when(whole, F.col("m.length")).alias("length"),
        F.when(whole, F.map_concat(old, new)).alias("headers"),
    )
