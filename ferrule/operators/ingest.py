"""Incremental ingestion: change detection, upserts, merging, versions, state, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fingerprint(x: Column) -> Column:
    return F.sha2(F.coalesce(x, F.lit("")), 256)


def changes(new: DataFrame, old: DataFrame, key: str, mark: str, forced: bool = False) -> DataFrame:
    """(key, change): new, changed, same or gone; compare before parsing, so that only what changed is parsed."""
    n, o = new.select(key, F.col(mark).alias("_n")), old.select(key, F.col(mark).alias("_o"))
    change = F.when(F.col("_n").isNull(), "gone").when(F.col("_o").isNull(), "new").when(F.lit(forced) | (F.col("_n") != F.col("_o")), "changed").otherwise("same")
    return n.join(o, key, "full").select(key, change.alias("change"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in order: an upsert, a run log, an LRU keep."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def keep_recent(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The `most` keys used last."""
    return latest(df, [key], order).orderBy(*order).limit(most)


def version(marks: DataFrame, mark: str) -> DataFrame:
    """One row (version, n): 12 hex digits of the hash of all fingerprints in order.

    Fingerprints are hashed within 4,096 ranges of their first digits before the last hash, so no task holds them all.
    """
    ranged = marks.groupBy(F.substring(mark, 1, 3).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(mark)), ""), 256).alias("h"), F.count("*").alias("n"))
    return ranged.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ""), 256), 1, 12).alias("version"), F.sum("n").alias("n"))


def merged(items: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row a key: of scalars the first that isn't empty, of lists the distinct values in order of coming."""
    first = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c) for c in scalars]
    union = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return items.groupBy(key).agg(*first, *union)


def readiness(n_documents: Column, n_chunks: Column, running: Column) -> Column:
    return F.when(running, "running").when(n_documents == 0, "empty").when(n_chunks == 0, "unindexed").otherwise("ready")


def readiness_checks(chunks: Column, vectors: Column, documents: Column, facts: Column, version: Column, model: Column) -> Column:
    """The six checks of a snapshot as rows (name, ok, detail): the engine itself, the model, the vectors, the graph, the documents, the index version."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
    return F.array(
        row("backend", F.lit(True), F.lit("API reachable")), row("llm", model != "", text(model)), row("vector", (vectors > 0) & (chunks > 0), F.concat(text(chunks), F.lit(" chunks"))),
        row("kg", facts > 0, F.when(facts > 0, "Connected").otherwise("Unavailable")), row("documents", documents > 0, text(documents)), row("index_version", F.coalesce(version, F.lit("uninitialized")) != "uninitialized", F.coalesce(version, F.lit("uninitialized"))),
    )


def lookup(asked: DataFrame, sources: DataFrame, key: str = "url") -> DataFrame:
    """Sources by key, a row for each that is asked for, known or not."""
    return asked.select(key).join(sources, key, "left")


def healed(state: Column, alive: Column, ready: Column) -> Column:
    """The state after a restart: a run that says it is running but isn't ended idle, or in error if nothing is ready."""
    return F.when((state == "running") & ~alive, F.when(ready, "idle").otherwise("error")).otherwise(state)


#: The steps of an upload, with the progress that each shows; a failed one has ended too.
UPLOAD_STEPS = (("uploaded", 15), ("chunking", 40), ("embedding", 75), ("kg_sync", 90), ("indexed", 100))
FAILED_PROGRESS = 100


def step_after(state: Column, failed: Column) -> Column:
    """The next state of an upload; a failed one fails, and what is indexed or failed stays."""
    names = [s for s, _ in UPLOAD_STEPS]
    out = state
    for a, b in zip(names[:-1], names[1:], strict=True):
        out = F.when(state == a, F.when(failed, "failed").otherwise(b)).otherwise(out)
    return out


def progress(state: Column) -> Column:
    out = F.when(state == "failed", FAILED_PROGRESS).otherwise(0)
    for name, value in UPLOAD_STEPS:
        out = F.when(state == name, value).otherwise(out)
    return out


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, what isn't valid replaced: the fallback where no reader takes a file."""
    return F.make_valid_utf8(content.cast("string"))


def faqs(documents: DataFrame, rules: list[tuple[str, str, str, str]], id_col: str, title: str, text: str) -> DataFrame:
    """(id, question, answer): for documents whose title holds a term, the questions whose marker their text holds ('' always does).

    rules: (term in the title, marker in the text, question, answer).
    """
    r = documents.sparkSession.createDataFrame(rules, "term string, marker string, question string, answer string")
    return documents.join(F.broadcast(r), F.contains(F.lower(title), F.col("term")) & F.contains(F.coalesce(text, F.lit("")), F.col("marker"))).select(id_col, "question", "answer")


def rebuilt(official: DataFrame, uploads: DataFrame, key: str) -> DataFrame:
    """All documents that an index is made of: official ones with a text, and uploads; a key that both have is the upload's."""
    u = uploads.withColumn("source_type", F.lit("upload"))
    o = official.where("length(trim(coalesce(text, ''))) > 0").withColumn("source_type", F.lit("official")).join(u.select(key), key, "left_anti")
    return o.unionByName(u)


def appended(index: DataFrame, chunks: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """An index with the chunks of one more document; chunks that it had before are replaced. keys: those of the chunks, where telling them from the chunks costs more."""
    gone = (chunks if keys is None else keys).select(key)
    return index.join(gone.hint("shuffle_hash"), key, "left_anti").unionByName(chunks)


class SingleFlight:
    """Runs one job at a time in the background; a call while one runs doesn't start another."""

    def __init__(self):
        import threading

        self._lock, self._thread = threading.Lock(), None

    def run(self, job, force: bool = False) -> bool:
        import threading

        with self._lock:
            if self._thread is not None and self._thread.is_alive() and not force:
                return False
            self._thread = threading.Thread(target=job, daemon=True)
            self._thread.start()
            return True

    def wait(self) -> None:
        if self._thread is not None:
            self._thread.join()
