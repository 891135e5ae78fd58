"""Readers and writers of the logical tables: manifests, knowledge bases, logs, golden questions, pages of PDFs, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schemas


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Source manifest: a JSON array."""
    return spark.read.schema(schemas.SOURCES).option("multiLine", True).json(path)


def official_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array, without those whose text is empty."""
    return spark.read.schema(schemas.DOCUMENTS).option("multiLine", True).json(path).where("length(trim(text)) > 0")


def golden(spark: SparkSession, *paths: str) -> DataFrame:
    """Golden questions of several files, with or without context; rows without a question are left out."""
    out = None
    for p in paths:
        x = spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(p)
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.where("question is not null and trim(question) <> ''")


def section(spark: SparkSession, path: str, name: str, ddl: str) -> DataFrame:
    """One list section of a knowledge-base JSON object, a row an element."""
    whole = spark.read.schema(f"{name} array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(ddl))}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(name).alias("x")).select("x.*")


def _columns(ddl: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def status_map(spark: SparkSession, path: str) -> DataFrame:
    """An upload registry, a JSON object keyed by file name, as rows."""
    row = "struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in _columns(schemas.UPLOAD_STATUS)) + ">"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{row}>").alias("m"))
    return whole.select(F.explode("m").alias("file", "x")).select("file", "x.*")


def append_log(rows: DataFrame, path: str) -> None:
    """Query log rows, appended as CSV."""
    rows.write.mode("append").option("header", True).csv(path)


def history(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """The last log rows, newest first, missing strings as ''."""
    rows = spark.read.schema(schemas.QUERY_LOG).option("header", True).csv(path)
    return rows.orderBy(F.desc("ts"), "question").limit(most).fillna("")


def pages_to_text(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """A document's page texts as one text with [PAGE n] markers, for page_sections()."""
    part = F.concat(F.lit("[PAGE "), F.col(page_col).cast("string"), F.lit("]\n"), F.coalesce(text_col, F.lit("")))
    return pages.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with vectors as Parquet, by category, so that a category filter prunes files."""
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reconcile(listing: DataFrame, registry: DataFrame, key: str = "name") -> DataFrame:
    """Registry rows of files that exist, and default rows for files that it doesn't know."""
    return listing.select(key).join(registry, key, "left").withColumn("status", F.coalesce("status", F.lit("uploaded"))).withColumn("progress", F.coalesce("progress", F.lit(15)))


def last_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of an evaluation CSV: the last row, and the means over all rows."""
    rows = spark.read.option("header", True).option("multiLine", True).option("inferSchema", True).csv(path)
    numbered = rows.withColumn("_i", F.monotonically_increasing_id())
    numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "integer", "long")]
    return numbered.orderBy(F.desc("_i")).limit(1).drop("_i"), rows.agg(*[F.avg(c).alias(c) for c in numeric])


def knowledge_base(spark: SparkSession, path: str, sections: dict[str, str]) -> dict[str, DataFrame]:
    """All list sections of a knowledge-base file by name; empty ones where the file isn't there or lacks them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return {name: section(spark, path, name, ddl) if there else spark.createDataFrame([], ddl) for name, ddl in sections.items()}


def snapshot_key(parts: DataFrame, name: str, mark: str) -> str:
    """A key for what was computed from several inputs (name, fingerprint): it changes when any of them does."""
    row = parts.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", name, mark))), ""), 256), 1, 16)).first()
    return row[0]


def cached_table(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table kept under folder/key, made and kept if it isn't there."""
    path = f"{folder}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
