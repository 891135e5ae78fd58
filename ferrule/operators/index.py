"""A stored keyword index: blocks of documents with their postings, in generations that are swapped whole.

A generation is a manifest: its segments (folders of blocks, written once), which of their blocks count no longer, the terms with
their document frequencies, and the statistics. Manifests are numbered; the greatest number is the index. What is added or removed writes
new segments (blocks that hold a replaced document are written again without it) and then the next manifest, which
can't be there already; so a failed build leaves the last generation as it is, a reader keeps the one it opened, and the result is that of a whole build.

Search reads every block once for a slice of questions of bounded size, scores a block's postings in numpy, and gives out each block's best. What
is exchanged is k rows for each question and block. Ids must be unique and sortable.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule import params, session
from ferrule.functions import block_search as S
from ferrule.functions import text as T

#: Documents and bytes of text of a block, questions in a chunk, bytes of questions that are broadcast at once.
BLOCK_DOCS, BLOCK_BYTES, CHUNK, QUESTION_BYTES = 512, 2 << 20, 256, 32 << 20
#: An index of titles of up to so many is broadcast and questions are dealt out; a larger one has blocks enough.
FEW_TITLES = 100_000
#: What a stored block looks like, by name: an index of another format is not taken for one of this. Files that a fingerprint looks at.
FORMAT, MOST_FILES = "blocks 4", 10_000
#: Bytes of a row group of blocks: a reader holds a whole one of the columns it asks for, decoded, for each task.
ROW_GROUP = 16 << 20
#: What a block's columns of bytes hold, by column: Arrow streams of lists, so that a search reads what it needs. They are compressed here, as
#: rows of them go through the JVM's heap, its Arrow buffers and the workers; only what can't be told from the rest is in them.
PARTS = {
    "postings": ("terms", "dl", "held", "place", "tf"),
    "texts": ("text", "title"),
    "ladder": ("title_held", "title_place"),
}
ZSTD = 3


def _packed(parts: dict) -> bytes:
    lists = []
    for v in parts.values():
        v = v if isinstance(v, pa.Array) else pa.array(v, pa.uint16() if len(v) and 0 <= v.min() and v.max() < 1 << 16 else pa.int32())
        lists.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(lists, names=list(parts))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> dict:
    with pa.ipc.open_stream(data.as_buffer()) as stream:
        batch = stream.read_next_batch()
    out = {}
    for name in batch.schema.names:
        v = batch.column(name).values
        out[name] = v if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def _blocks(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Blocks of docs (id, text, title); both texts are brought to searchable form, which those in it keep. A null text is empty, a null title adds nothing.

    texts: whether they are in the blocks, beside the postings.
    """

    def run(batches):
        for rows in _gathered(batches):
            parts = _made(rows)
            if not texts:
                parts["text"] = parts["title"] = pa.array([], pa.string())
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), parts["ids"])
            words = pa.array([int(parts["dl"].sum())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), words, ids, *[pa.array([_packed({k: parts[k] for k in of})], pa.binary()) for of in PARTS.values()]], names=["block", "words", "ids", *PARTS])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block string, words long, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in PARTS))


def _gathered(batches) -> Iterator[pa.Table]:
    """The rows of a block after another, in order of id."""
    held, rows, size = [], 0, 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().sort_by("id")
    for batch in batches:
        for lo, hi in _runs(batch):
            part = batch.slice(lo, hi - lo)
            if rows and (rows + hi - lo > BLOCK_DOCS or size + part.nbytes > BLOCK_BYTES):
                yield whole()
                held, rows, size = [], 0, 0
            held.append(part)
            rows, size = rows + hi - lo, size + part.nbytes
    if held:
        yield whole()


def _made(rows: pa.Table) -> dict:
    """The parts of the block of these rows (id, text, title)."""
    column = lambda c: rows.column(c).combine_chunks() if rows.column(c).num_chunks == 1 else pa.concat_arrays(rows.column(c).chunks)
    return S.make(column("id"), S.searchable(column("text").fill_null("")), S.searchable(column("title")))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of documents that are far below a block."""
    step = max(1, min(64, BLOCK_DOCS // 4))
    for lo in range(0, batch.num_rows, step):
        yield lo, min(batch.num_rows, lo + step)


class KeywordIndex:
    """One generation of the index in folder."""

    def __init__(self, spark: SparkSession, folder: str, number: int, manifest: dict):
        self.spark, self.folder, self.number, self.manifest = spark, folder, number, manifest

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> KeywordIndex | None:
        """The newest generation, None if there is none."""
        files = session.Files(spark, folder)
        numbers = [int(m[1]) for x in files.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", x))]
        return cls(spark, folder, max(numbers), json.loads(files.read(f"manifest-{max(numbers):08d}.json"))) if numbers else None

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str, text: Column, title: Column | None = None) -> KeywordIndex:
        """A generation of these documents alone."""
        return cls._next(docs.sparkSession, folder, [cls._segment(docs, folder, id_col, text, title)])

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text: Column, title: Column | None = None, texts: bool = True) -> KeywordIndex:
        """The index of docs in the shared folder. It is built if there is none of the same files and plan; where docs come from anything but files, each time, and it goes with the driver.

        texts: False where only postings are searched (bm25, holding); they are less than half of an index, which holds no texts then and is one of its own.
        """
        session.ship(docs.sparkSession)
        picked = _picked(docs, id_col, text, title)
        mark = fingerprint(picked)
        folder = f"{session.shared_folder(docs.sparkSession)}/keyword-{'index' if texts else 'postings'}-{mark or uuid.uuid4().hex}"
        if mark is None:
            atexit.register(session.forget, folder)
        return (cls.open(docs.sparkSession, folder) if mark else None) or cls._next(docs.sparkSession, folder, [cls._write(picked, folder, texts)])

    def add(self, docs: DataFrame, id_col: str, text: Column, title: Column | None = None) -> KeywordIndex:
        """The next generation, with these documents; those of the same ids are replaced."""
        return self._changed(docs.select(F.col(id_col).alias("id")), [self._segment(docs, self.folder, id_col, text, title)])

    def remove(self, ids: DataFrame, id_col: str) -> KeywordIndex:
        """The next generation, without these documents."""
        return self._changed(ids.select(F.col(id_col).alias("id")), [])

    def _changed(self, ids: DataFrame, more: list[dict]) -> KeywordIndex:
        gone = ids.distinct()
        hit = f"{self.folder}/dropped-{uuid.uuid4().hex}"
        held = self.blocks().select("block", F.explode("ids").alias("id")).join(gone, "id", "left_semi").select("block").distinct()
        held.write.parquet(hit)
        dropped = self.spark.read.parquet(hit)
        if dropped.isEmpty():
            return self._next(self.spark, self.folder, [*self.manifest["segments"], *more])
        rest = _documents(self.blocks().join(dropped, "block", "left_semi")).join(gone, "id", "left_anti")
        kept = self._write(rest.select("id", "text", "title"), self.folder)
        old = [{**s, "dropped": [*s["dropped"], hit]} for s in self.manifest["segments"]]
        return self._next(self.spark, self.folder, [*old, kept, *more])

    @classmethod
    def _segment(cls, docs: DataFrame, folder: str, id_col: str, text: Column, title: Column | None) -> dict:
        picked = docs if docs.columns == ["id", "text", "title"] and id_col == "id" else _picked(docs, id_col, text, title)
        return cls._write(picked, folder)

    @staticmethod
    def _write(picked: DataFrame, folder: str, texts: bool = True) -> dict:
        session.ship(picked.sparkSession)
        name = f"{folder}/segment-{uuid.uuid4().hex}"
        # a block is a row of megabytes: the size of a row group is looked at after each one, and no dictionary of whole blocks is made
        small = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
        _blocks(picked, texts).write.options(**small).parquet(name)
        return {"folder": name, "dropped": []}

    @classmethod
    def _next(cls, spark: SparkSession, folder: str, segments: list[dict]) -> KeywordIndex:
        files = session.Files(spark, folder)
        last = cls.open(spark, folder)
        new = cls(spark, folder, last.number + 1 if last else 1, {"segments": segments})
        terms = f"{folder}/terms-{uuid.uuid4().hex}"
        new.blocks().select("postings").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(terms)
        count = new.blocks().agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("length")).first()
        raw = F.log(F.lit(count.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = spark.read.parquet(terms).agg(F.avg(raw).alias("m")).first().m
        new.manifest |= {"terms": terms, "n": count.n, "length": count.length, "mean_idf": mean or 0.0}
        files.create(f"manifest-{new.number:08d}.json", json.dumps(new.manifest))
        return new

    def blocks(self) -> DataFrame:
        """The blocks that count."""
        out = None
        for s in self.manifest["segments"]:
            one = self.spark.read.parquet(s["folder"])
            for d in s["dropped"]:
                one = one.join(self.spark.read.parquet(d), "block", "left_anti")
            out = one if out is None else out.unionByName(one)
        return out

    def documents(self) -> DataFrame:
        """(id, text, title) of the documents that count, in searchable form."""
        return _documents(self.blocks())

    def terms(self) -> DataFrame:
        """(term, df, idf)."""
        raw = F.log(F.lit(self.manifest["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return self.spark.read.parquet(self.manifest["terms"]).select("term", "df", F.when(raw < 0, params.BM25_EPSILON * F.lit(self.manifest["mean_idf"])).otherwise(raw).alias("idf"))

    def prune(self, keep: int = 2) -> None:
        """Delete all generations but the last ones, and what no kept one names."""
        files = session.Files(self.spark, self.folder)
        listed = [x for x in files.names() if x.startswith("manifest-")]
        for x in listed[:-keep]:
            files.remove(x)
        named = "\n".join(files.read(x) for x in listed[-keep:])
        for x in files.names():
            if not x.startswith("manifest-") and x not in named:
                files.remove(x)

    # --- search ------------------------------------------------------------------------------------------------------

    def bm25(self, queries: DataFrame, query_id: str, query_text: Column, k: int, among: DataFrame | None = None) -> DataFrame:
        """(query, id, score, rank): the k best documents of each question by BM25; a term that a question has twice counts twice.

        among: one column, the ids that may be given; statistics stay those of all.
        """
        terms = queries.select(F.col(query_id).alias("q"), F.explode(T.tokens(query_text)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qn"))
        weighted = terms.join(self.terms(), "term").groupBy("q").agg(F.collect_list(F.struct("term", (F.col("qn") * F.col("idf")).alias("w"))).alias("t"))
        asked = weighted.select("q", F.struct(F.col("t.term").alias("words"), F.col("t.w").alias("weights")).alias("a"))
        how = (params.BM25_K1, params.BM25_B, max(self.manifest["length"] / max(1, self.manifest["n"]), 1e-9))

        def answer(chunk: pa.StructArray):
            search = S.Bm25(_asked(chunk) | {"weight": _flat(chunk, "weights")}, k, *how)
            return lambda block: [(i, p, (s,)) for i, p, s in search.of(block)]

        hits = self._search(asked, queries.select(query_text.alias("t")), answer, ["score"], ["postings"], among)
        scored = hits.select("q", "id", F.round("score", 6).alias("score")).where("score > 0")
        return _ranked(scored, [F.desc("score"), F.asc("id")], k, query_id)

    def lexical(self, queries: DataFrame, query_id: str, query_text: Column, k: int | None, among: DataFrame | None = None) -> DataFrame:
        """(query, id, keyword_score, title_score, rank): the k best by the keyword ladder, or (without rank) all that a question's words touch.

        Phrases within words and parts of words, which rank below the rest, are looked for only for questions that have fewer than k documents without them.
        """
        asked = _laddered(queries, query_id, query_text)

        def search(some: DataFrame, parts: bool) -> DataFrame:
            answer = lambda chunk: _climbed(chunk, k, parts)
            hits = self._search(some, queries.select(query_text.alias("t")), answer, ["keyword_score", "title_score"], ["postings", "texts", "ladder"], among)
            return hits.select("q", "id", *[F.round(c, 6).alias(c) for c in ("keyword_score", "title_score")])

        order = [F.desc("keyword_score"), F.desc("title_score"), F.asc("id")]
        if k is None:
            return _renamed(search(asked, True), query_id)
        strong = _ranked(search(asked, False), order, k, "q")
        strong = session.kept(strong, "strong")  # it is asked twice: for its rows and for the questions that have enough of them
        enough = strong.groupBy("q").count().where(F.col("count") >= k).select("q")
        rest = asked.join(enough, "q", "left_anti")
        if rest.isEmpty():
            return _renamed(strong, query_id)
        return _renamed(strong.join(enough, "q", "left_semi").unionByName(_ranked(search(rest, True), order, k, "q")), query_id)

    def titles(self, queries: DataFrame, query_id: str, query_text: Column, k: int | None) -> DataFrame:
        """(query, id, score, rank): the k titles that share most with each question, or (without rank) all that share anything; for an index of titles without texts."""
        q = T.once(queries.select(F.col(query_id).alias("q"), query_text.alias("_q")), "kw", T.keywords(F.col("_q")))
        asked = q.select("q", F.struct(F.col("kw").alias("words"), T.compact_form(F.col("_q")).alias("form")).alias("a"))

        def answer(chunk: pa.StructArray):
            search = S.Titles(_asked(chunk) | {"form": chunk.field("form").to_pylist()}, k)
            return lambda block: [(i, p, (s,)) for i, p, s in search.of(block)]

        hits = self._search(asked, queries.select(query_text.alias("t")), answer, ["score"], ["postings", "texts", "ladder"], dealt=self.manifest["n"] <= FEW_TITLES)
        scored = hits.select("q", "id", F.round("score", 6).alias("score"))
        return _renamed(scored, query_id) if k is None else _ranked(scored, [F.desc("score"), F.asc("id")], k, query_id)

    def holding(self, queries: DataFrame, query_id: str, query_text: Column) -> DataFrame:
        """(query, id) of all documents that hold every word between the first and the last of a question: those that can hold it whole. Questions of fewer than three words have none."""
        words = T.tokens(F.col("_q"))
        q = T.once(queries.select(F.col(query_id).alias("q"), query_text.alias("_q")), "_w", words).where("size(_w) > 2")
        asked = q.select("q", F.struct(F.array_distinct(F.slice("_w", F.lit(2), F.size("_w") - 2)).alias("words")).alias("a"))

        def answer(chunk: pa.StructArray):
            search = S.Holding(_asked(chunk))
            return lambda block: [(i, p, (n,)) for i, p, n in search.of(block)]

        return _renamed(self._search(asked, queries.select(query_text.alias("t")), answer, ["words"], ["postings"]).select("q", "id"), query_id)

    def _search(self, asked: DataFrame, texts: DataFrame, answer, scores: list[str], columns: list[str], among: DataFrame | None = None, dealt: bool = False) -> DataFrame:
        """(q, id, scores) of all blocks for all questions (q, a), a slice of questions after another."""
        packed, chunks, slices = _chunked(asked, texts)

        filtered = among is not None

        def run(batches):
            searches, block = {}, None
            for batch in batches:
                for r in range(batch.num_rows):
                    ids = batch.column("ids")[r].values
                    if block is None or not ids.equals(block.ids):  # the rows of a block, one for each chunk of questions, follow one another
                        parts = {"ids": ids}
                        for c in columns:
                            parts |= _unpacked(batch.column(c)[r])
                        block = S.Block(parts, batch.column("allowed")[r].values.to_numpy(zero_copy_only=False) if filtered else None)
                    asked_, chunk = batch.column("asked")[r].values, batch.column("chunk")[r].as_py()
                    if chunk not in searches:
                        searches[chunk] = answer(asked_.field("a"))
                    found = searches[chunk](block)
                    if found:
                        yield _hits(asked_, block, found, scores)

        blocks = self.blocks()
        if among is not None:  # each block learns which of its documents are meant
            ids = blocks.select("block", F.posexplode("ids").alias("place", "id")).join(among.toDF("id"), "id", "left_semi")
            blocks = blocks.join(ids.groupBy("block").agg(F.collect_list("place").alias("allowed")), "block")
        blocks = blocks.select("ids", *columns, *(["allowed"] if among is not None else []))
        schema = f"q {asked.schema['q'].dataType.simpleString()}, id {blocks.schema['ids'].dataType.elementType.simpleString()}, " + ", ".join(f"{s} double" for s in scores)
        out = None
        for s in range(slices):
            some = packed.where(F.pmod("chunk", F.lit(slices)) == s) if slices > 1 else packed
            if dealt:
                hits = some.repartition(min(chunks, 1000), "chunk").crossJoin(F.broadcast(blocks)).mapInArrow(run, schema)
            else:
                hits = blocks.crossJoin(F.broadcast(some)).mapInArrow(run, schema)  # a slice has at most about QUESTION_BYTES
            out = hits if out is None else out.unionByName(hits)
        return out


def scanned(docs: DataFrame, id_col: str, text: Column, title: Column, queries: DataFrame, query_id: str, query_text: Column) -> DataFrame:
    """(query, id, keyword_score, title_score): all that a question's words touch, by the keyword ladder. As every document is looked at, each block is made, searched and forgotten in one pass, and none is stored."""
    spark, scores = docs.sparkSession, ["keyword_score", "title_score"]
    session.ship(spark)
    asked = _laddered(queries, query_id, query_text)
    packed, _, slices = _chunked(asked, queries.select(query_text.alias("t")))

    def searching(sent):
        def run(batches):
            with pa.ipc.open_stream(pa.py_buffer(sent.value)) as stream:
                chunks = [b.column("asked")[r].values for b in stream for r in range(b.num_rows)]
            searches = [(c, _climbed(c.field("a"), None, True)) for c in chunks]
            for rows in _gathered(batches):
                block = S.Block(_made(rows))
                for c, search in searches:
                    found = search(block)
                    if found:
                        yield _hits(c, block, found, scores)

        return run

    picked = _picked(docs, id_col, text, title)
    schema = f"q {asked.schema['q'].dataType.simpleString()}, id {picked.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in scores)
    out = None
    for s in range(slices):
        rows = (packed.where(F.pmod("chunk", F.lit(slices)) == s) if slices > 1 else packed).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        hits = picked.mapInArrow(searching(spark.sparkContext.broadcast(sink.getvalue().to_pybytes())), schema)
        out = hits if out is None else out.unionByName(hits)
    return _renamed(out.select("q", "id", *[F.round(c, 6).alias(c) for c in scores]), query_id)


def _laddered(queries: DataFrame, query_id: str, query_text: Column) -> DataFrame:
    """(q, a): questions as the keyword ladder takes them."""
    q = T.once(queries.select(F.col(query_id).alias("q"), query_text.alias("_q")), "kw", T.keywords(F.col("_q")))
    return q.select("q", F.struct(F.col("kw").alias("words"), T.compact_form(F.col("_q")).alias("form"), F.trim(T.searchable(F.col("_q"))).alias("phrase")).alias("a"))


def _climbed(chunk: pa.StructArray, k: int | None, parts: bool):
    ladder = S.Ladder(_asked(chunk) | {"form": chunk.field("form").to_pylist(), "phrase": chunk.field("phrase").to_pylist()}, k, parts)
    return lambda block: [(i, p, (a, b)) for i, p, a, b in ladder.of(block)]


def _chunked(asked: DataFrame, texts: DataFrame) -> tuple[DataFrame, int, int]:
    """Questions (q, a) in chunks, the number of these, and that of the slices which they are sent in. texts: those of the questions, as t."""
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(16 * F.octet_length("t") + 64), F.lit(0)).alias("bytes")).first()  # a word of two characters becomes some 30 bytes
    chunks = max(1, math.ceil(size.n / CHUNK), math.ceil(size.bytes / (QUESTION_BYTES // 8)))
    slices = max(1, math.ceil(2 * size.bytes / QUESTION_BYTES))
    return asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("q", "a")).alias("asked")), chunks, slices


def _hits(asked: pa.StructArray, block: S.Block, found: list, scores: list[str]) -> pa.RecordBatch:
    """(q, id, scores) of what was found of a chunk's questions in a block."""
    n = np.array([len(p) for _, p, _ in found])
    q = asked.field("q").take(pa.array(np.repeat([i for i, _, _ in found], n)))
    ids = block.ids.take(pa.array(np.concatenate([p for _, p, _ in found])))
    return pa.RecordBatch.from_arrays([q, ids, *[pa.array(np.concatenate([s[j] for _, _, s in found]).astype(np.float64)) for j in range(len(scores))]], names=["q", "id", *scores])


def _frequencies(batches):
    """(term, df) of each block's text."""
    for batch in batches:
        for data in batch.column("postings"):
            parts = _unpacked(data)
            df = parts["held"]
            yield pa.RecordBatch.from_arrays([parts["terms"].filter(pa.array(df > 0)), pa.array(df[df > 0])], names=["term", "df"])


def _documents(blocks: DataFrame) -> DataFrame:
    """(id, text, title) of blocks."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                parts = _unpacked(batch.column("texts")[r])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, parts["text"], parts["title"]], names=["id", "text", "title"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.select("ids", "texts").mapInArrow(run, f"id {kind}, text string, title string")


def _flat(chunk: pa.StructArray, name: str) -> np.ndarray:
    return chunk.field(name).flatten().to_numpy(zero_copy_only=False)


def _asked(chunk: pa.StructArray) -> dict:
    """Questions as numbers of their distinct words."""
    words = chunk.field("words")
    every = words.flatten().dictionary_encode()
    n = np.array([len(x) if x is not None else 0 for x in words.to_pylist()])
    return {"id": range(len(chunk)), "words": every.dictionary, "word": every.indices.to_numpy(zero_copy_only=False), "first": np.concatenate([[0], np.cumsum(n)])}


def _ranked(df: DataFrame, order: list[Column], k: int, query_id: str) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return _renamed(ranked, query_id)


def _renamed(df: DataFrame, query_id: str) -> DataFrame:
    return df.withColumnRenamed("q", query_id) if query_id != "q" else df


def _picked(docs: DataFrame, id_col: str, text: Column, title: Column | None) -> DataFrame:
    """(id, text, title) as they are; a missing title is null."""
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), (title if title is not None else F.lit(None).cast("string")).alias("title"))


def fingerprint(df: DataFrame) -> str | None:
    """A hash of df's plan and of the names, sizes and times of the files it reads; None if it reads anything else, over MOST_FILES of them, or calls UDFs. For such tables build an index once and open it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if any(leaves.apply(k).getClass().getSimpleName() != "LogicalRelation" for k in range(leaves.size())) or re.search("udf", plan.toString(), re.IGNORECASE):
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    told, names = [FORMAT, re.sub(r"#\d+", "", plan.toString())], sorted(df.inputFiles())
    if len(names) > MOST_FILES:
        return None
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        s = path.getFileSystem(conf).getFileStatus(path)
        told.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:32]
