"""Structured Streaming: change detection with upserts, event-time windows, the upload state machine.

Each has a batch twin in ferrule.operators or ferrule.plans, which says what its result must be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import ingest

#: The order of upload stages.
STAGES = ("uploaded", "chunking", "embedding", "kg_sync", "indexed", "failed")


def upsert_changes(pages: DataFrame, state_path: str, changed_path: str, checkpoint: str, key: str = "page_id", body: str = "html"):
    """Start a query that keeps {key, fingerprint, version} at state_path and appends what is new or changed to changed_path.

    A micro-batch reads the version before its own and writes its own, so a repeated batch gives the same result.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = ingest.latest(batch, [key], [F.desc(ingest.fingerprint(F.col(body)))]).withColumn("fingerprint", ingest.fingerprint(F.col(body)))
        old = _state(spark, state_path, new.select(key, "fingerprint"), n)
        what = ingest.changes(new, old, key, "fingerprint").where("change in ('new', 'changed')")
        new.join(what, key).write.mode("overwrite").parquet(f"{changed_path}/batch={n}")
        both = new.select(key, "fingerprint").withColumn("v", F.lit(1)).unionByName(old.withColumn("v", F.lit(0)))
        ingest.latest(both, [key], [F.desc("v")]).drop("v").write.mode("overwrite").parquet(f"{state_path}/v={n}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, path: str, like: DataFrame, n: int) -> DataFrame:
    """The state that batch n starts from; empty for the first."""
    return spark.read.schema(like.schema).parquet(f"{path}/v={n - 1}") if n else like.limit(0)


def windowed_counts(events: DataFrame, late: str = "1 hour", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type; events over `late` behind the latest are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """The last event of each key so far, for the complete or update mode."""
    return events.withWatermark("ts", late).groupBy(key).agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select(key, "e.*")
