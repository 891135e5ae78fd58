"""Nearest neighbours by score-aware (anisotropic) 4-bit product quantisation, table scans and exact reranking.

The smallest Euclidean distance is the greatest inner product of (q, 1) with (x, -|x|^2/2), so search is for
maximum inner product. Vectors are cut into pairs of components with 16 codewords each. Codewords and codes
minimise |r|^2 + (eta - 1) <r, x>^2/|x|^2: residual error along the vector, which moves its high scores, costs
eta times as much as error across it. Codes are chosen by coordinate descent, codewords by least squares. A
search adds up, from one table a byte (two codes), the inner products of all vectors of a block; the best
RERANK go to exact distances on the original vectors, in double precision. A vector is at least as far from the
query as its codewords are, less the length of its residual; in rising order of that bound the others follow,
until it passes the k-th distance found. So nothing nearer is left out; where codes tell little apart (a dense
cluster), most of a block is compared.

The codebook is fitted on at most SAMPLE_VECTORS vectors (by hash of id), and so are coarse centres, one for about
BLOCK_VECTORS vectors; every vector is indexed, in blocks of that size of vectors of one centre (a centre with more
has several blocks, by hash of id). How it is spread: each query first goes to one block of its nearest centre, whose
k-th distance is a bound for what may come. Queries with their bounds are written to the shared folder in files of
about QUERY_BYTES; each task holds the index blocks that it gets, HELD_BYTES at a time, and reads the files one after another.
A block whose ball (its middle and greatest distance from it) lies beyond a query's bound is passed over, and only what
lies within the bound is given out. So the driver sees no query, and what is exchanged in the end is near the answer.

Cases. Vectors null, zero or with null or non-finite components, without id, or not of the most frequent length
take no part. Ids must be whole numbers (TypeError). A query is never its own answer, nor are rows with its id. Of repeated rows of a query one counts;
repeated candidates each count. Equal distances go by the smaller id. Fewer than k candidates: all of them. Texts play no part.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks

SAMPLE_VECTORS, RERANK, BLOCK_VECTORS, QUERY_BYTES, HELD_BYTES, SWEEPS, ROUNDS, THRESHOLD, STEP = 16_384, 400, 16_384, 8 << 20, 64 << 20, 2, 6, 0.2, 1024
MOST_CENTRES = 4096


class Codebook:
    """16 codewords for each pair of components."""

    def __init__(self, sample: np.ndarray):
        n, d = sample.shape
        self.d, self.m = d, -(-d // 2)
        self.weight = max(0.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)
        x = self.pairs(sample)
        rng = np.random.default_rng(7)
        self.words = np.stack([x[rng.choice(n, 16, replace=n < 16), j] for j in range(self.m)]) if n else np.zeros((self.m, 16, 2))
        for _ in range(ROUNDS if n else 0):
            codes = self.assign(x, 1)
            self.refit(x, codes)

    def pairs(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.m * 2))
        out[:, : self.d] = x
        return out.reshape(len(x), self.m, 2)

    def assign(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        """Codes of least anisotropic error: the nearest at first, then one pair after another with the others fixed."""
        square = np.maximum((x**2).sum(axis=(1, 2)), 1e-30)
        codes = np.empty(x.shape[:2], dtype=np.uint8)
        along = np.zeros(len(x))
        for s in range(sweeps + 1):
            for j in range(self.m):
                r = x[:, j, None, :] - self.words[j]
                plain = (r**2).sum(axis=2)
                part = (r * x[:, j, None, :]).sum(axis=2)
                if s:
                    along -= np.take_along_axis(part, codes[:, j, None].astype(np.int64), axis=1)[:, 0]
                    plain = plain + self.weight * (along[:, None] + part) ** 2 / square[:, None]
                codes[:, j] = plain.argmin(axis=1)
                along += np.take_along_axis(part, codes[:, j, None].astype(np.int64), axis=1)[:, 0]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword where it makes the least error for its vectors, the other pairs fixed."""
        square = np.maximum((x**2).sum(axis=(1, 2)), 1e-30)
        part = np.stack([((x[:, j] - self.words[j][codes[:, j]]) * x[:, j]).sum(axis=1) for j in range(self.m)], axis=1)
        along = part.sum(axis=1)
        for j in range(self.m):
            u = x[:, j]
            w = self.weight / square
            s = along - part[:, j] + (u**2).sum(axis=1)
            for k in range(16):
                mine = codes[:, j] == k
                if mine.any():
                    v = u[mine]
                    left = np.eye(2) * len(v) + (v * w[mine, None]).T @ v
                    self.words[j][k] = np.linalg.solve(left, (v * (1 + w[mine] * s[mine])[:, None]).sum(axis=0))
            new = ((u - self.words[j][codes[:, j]]) * u).sum(axis=1)
            along += new - part[:, j]
            part[:, j] = new

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte, one row of bytes for each pair of pairs."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code, the inner products of its 256 values."""
        q = np.zeros(self.m * 2)
        q[: self.d] = query
        t = np.einsum("jkc,jc->jk", self.words, q.reshape(self.m, 2))
        if len(t) % 2:
            t = np.concatenate([t, np.zeros((1, 16))])
        return (t[1::2, :, None] + t[::2, None, :]).reshape(-1, 256).astype(np.float32)

    def bounds(self, query: np.ndarray, inner: np.ndarray, square: np.ndarray, error: np.ndarray) -> np.ndarray:
        """What each vector's distance is at least, from the inner product of its codewords (single precision, slack for its rounding), their squared length and the residual's."""
        both = (query**2).sum() + square
        apart = both * (1 - (self.m + 8) * 2.0**-22) - 2 * inner.astype(np.float64)
        low = np.sqrt(np.maximum(apart, 0)) - error
        return np.where(np.isfinite(low), np.maximum(low * (1 - 1e-9) - error * 1e-9, 0), 0)


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; of equal ones the first."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    more = np.flatnonzero(score > least)
    return np.concatenate([more, np.flatnonzero(score == least)[: k - len(more)]])


def centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n coarse centres by a few rounds of k-means."""
    rng = np.random.default_rng(11)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS if len(c) > 1 else 0):
        mine = nearest(sample, c)
        for k in np.unique(mine).tolist():
            c[k] = sample[mine == k].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(x[lo : lo + 4096] @ c.T - half).argmax(axis=1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Block:
    """Ids, packed codes, what the bounds need, and original vectors of an index block."""

    @staticmethod
    def pack(ids: np.ndarray, x: np.ndarray, book: Codebook) -> dict[str, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        wide = x.astype(np.float64)
        pairs = book.pairs(wide)
        codes = book.assign(pairs, SWEEPS)
        near = book.words[np.arange(book.m), codes]
        middle = wide.mean(axis=0)
        return {
            "id": ids, "x": x, "code": book.pack(codes), "half": ((wide**2).sum(axis=1) / 2).astype(np.float32), "square": (near**2).sum(axis=(1, 2)), "error": np.sqrt(((pairs - near) ** 2).sum(axis=(1, 2))),
            "middle": middle, "radius": np.sqrt(((wide - middle) ** 2).sum(axis=1).max(keepdims=True)),
        }

    def __init__(self, part: dict[str, np.ndarray], book: Codebook):
        self.part, self.book = part, book

    def beyond(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether all of the block lies farther from each query than its bound."""
        apart = np.sqrt(((q - self.part["middle"]) ** 2).sum(axis=1))
        return apart * (1 - 1e-9) - self.part["radius"] * (1 + 1e-9) > bound

    def search(self, q: np.ndarray, own: int, near: tuple[np.ndarray, np.ndarray], k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of `near` and of the block's vectors that are no farther than bound."""
        part, book = self.part, self.book

        def closer(near, cand):
            cand = cand[part["id"][cand] != own]
            dist = np.sqrt(((part["x"][cand].astype(np.float64) - q) ** 2).sum(axis=1))
            cand, dist = cand[dist <= bound], dist[dist <= bound]
            near = (np.concatenate([near[0], part["id"][cand]]), np.concatenate([near[1], dist]))
            order = np.lexsort(near)[:k]
            return near[0][order], near[1][order]

        def worst(near):
            return min(bound, near[1][-1]) if len(near[1]) >= k else bound

        inner = np.zeros(len(part["id"]), dtype=np.float32)
        for t, c in zip(book.tables(q), part["code"], strict=True):
            inner += t[c]
        cand = top(inner - part["half"], RERANK)
        near = closer(near, cand)
        low = book.bounds(q, inner, part["square"], part["error"])
        rest = low <= worst(near)
        rest[cand] = False
        rest = np.flatnonzero(rest)
        rest = rest[np.argsort(low[rest], kind="stable")]
        for lo in range(0, len(rest), STEP):
            if low[rest[lo]] > worst(near):
                break
            near = closer(near, rest[lo : lo + STEP])
        return near


NONE = (np.zeros(0, np.int64), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of `vectors` found for each of `queries`, by Euclidean distance."""
    spark = vectors.sparkSession
    blocks.prepare(spark)
    for t in (vectors, queries):
        blocks.whole_ids(t, id_col)
    base, asked = (t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))) for t in (vectors, queries))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, total = sizes["d"], sizes["count"]
    base, asked = base.where(F.size("v") == d), asked.where(F.size("v") == d)
    most = max(256, min(SAMPLE_VECTORS, (32 << 20) // (8 * d)))
    sample = np.array([r[0] for r in base.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()], dtype=np.float64)
    book, coarse = Codebook(sample), centres(sample, min(MOST_CENTRES, -(-total // BLOCK_VECTORS)))

    def place(batches):
        for batch in batches:
            cell = nearest(matrix(batch.column(1)).astype(np.float64), coarse) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], names=["id", "v", "cell"])

    kinds = [t.schema["v"].dataType.simpleString() for t in (base, asked)]
    placed = base.mapInArrow(place, f"id long, v {kinds[0]}, cell long")
    counts = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # MOST_CENTRES rows at most
    parts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(c, 0) // BLOCK_VECTORS))) for c in range(len(coarse))]), (F.col("cell") + 1).cast("int"))
    salted = lambda t: t.select("cell", F.pmod(F.xxhash64("id"), parts).alias("salt"), "id", "v")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_VECTORS))

    def build(table: pa.Table) -> pa.Table:
        part = Block.pack(table.column("id").combine_chunks().to_numpy(), matrix(table.column("v").combine_chunks()), book)
        return pa.table({"cell": table.column("cell").slice(0, 1), "salt": table.column("salt").slice(0, 1), "data": pa.array([blocks.dump(part)], pa.binary())})

    indexed = blocks.checkpointed(salted(placed).repartition(n, "cell", "salt").groupBy("cell", "salt").applyInArrow(blocks.tidy(build), "cell long, salt long, data binary"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(place, f"id long, v {kinds[1]}, cell long")

    def bounded(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q = right.column("id").to_numpy(), matrix(right.column("v").combine_chunks()).astype(np.float64) if right.num_rows else np.zeros((0, d))
        bound = np.full(len(ids), np.inf)
        for data in left.column("data") if len(ids) else ():
            block = Block(blocks.load(data.as_buffer()), book)
            for i in range(len(ids)):
                dist = block.search(q[i], ids[i], NONE, k, bound[i])[1]
                if len(dist) >= k:
                    bound[i] = dist[-1]
        return pa.table({"id": pa.array(ids, pa.int64()), "v": right.column("v"), "bound": pa.array(bound)})

    first = salted(asked).repartition(n, "cell", "salt").groupBy("cell", "salt")
    bounds = indexed.repartition(n, "cell", "salt").groupBy("cell", "salt").cogroup(first).applyInArrow(blocks.tidy_two(bounded), f"id long, v {kinds[1]}, bound double")
    folder = f"{blocks.shared_folder(spark)}/queries-{uuid.uuid4().hex}"
    each = max(1, QUERY_BYTES // (8 * d))
    n_files = max(1, -(-asked.count() // each))
    bounds.repartition(n_files, "id").write.option("maxRecordsPerFile", each).parquet(folder)

    def run(batches):
        import pyarrow.parquet as pq

        where, path = blocks.file_system(folder)
        files = sorted(x.path for x in where.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet"))

        def answers(held):
            for name in files:
                table = pq.read_table(name, filesystem=where)
                if not table.num_rows:
                    continue
                ids, q, bound = table.column("id").to_numpy(), matrix(table.column("v").combine_chunks()).astype(np.float64), table.column("bound").to_numpy().copy()
                best = [NONE] * len(ids)
                for block in held:
                    for i in np.flatnonzero(~block.beyond(q, bound)).tolist():
                        best[i] = block.search(q[i], ids[i], best[i], k, bound[i])
                        if len(best[i][1]) >= k:
                            bound[i] = min(bound[i], best[i][1][-1])
                n = [len(a) for a, _ in best]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([a for a, _ in best])), pa.array(np.concatenate([b for _, b in best]))], names=["query_id", id_col, "score"])

        held, size = [], 0
        for batch in batches:
            for data in batch.column(2):
                held.append(Block(blocks.load(data.as_buffer()), book))
                size += held[-1].part["x"].nbytes
                if size >= HELD_BYTES:
                    yield from answers(held)
                    held, size = [], 0
        if held:
            yield from answers(held)

    found = indexed.mapInArrow(blocks.tidy_batches(run), f"query_id long, {id_col} long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")

