"""Shuffles of packed blocks: a row holds many records, compressed, for one bucket.

A job that must bring millions of small records together sends, from each block, one row for each bucket.
That costs the JVM a few rows instead of millions, and compresses well. A bucket's share of the data is bounded
because the number of buckets follows the input (`buckets`).

With n blocks and n buckets that would be n * n rows. So a block sends no more than FAN rows: with more
buckets than that, a row is for a group of buckets, and relays, each of which takes the rows of as many senders
for one group, sort them out further (`Route`). Rows grow with n, not with its square; each level of
relays writes the records once more.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ferrule import session

from . import words

BLOCK_BYTES, FLUSH_BYTES, FAN = 8 << 20, 32 << 20, 1024
#: The kind of a row that holds documents.
DOCS = 0
#: Stands for a null document id.
NULL_ID = np.iinfo(np.int64).min
SCHEMA = "bucket long, part long, kind int, data binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_PRIMES = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def prepare(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 8 MB (or one text), so that very long texts don't fill a worker; the package at the workers."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def buckets(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many buckets df's data make: its bytes over block_bytes, and no fewer than the shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(stored_bytes(df) / block_bytes))


def stored_bytes(df: DataFrame) -> int:
    """The size of the files that df reads; where it reads anything else, that of its strings, which takes a pass over them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(k) for k in range(leaves.size())]
    if all(x.getClass().getSimpleName() == "LogicalRelation" for x in leaves):
        return sum(int(str(x.stats().sizeInBytes())) for x in leaves)
    strings = [F.coalesce(F.octet_length(f.name).cast("long"), F.lit(0)) for f in df.schema if isinstance(f.dataType, Y.StringType | Y.BinaryType)]
    return df.agg(F.coalesce(F.sum(sum(strings, F.lit(8))), F.lit(0))).first()[0]


def whole_ids(df: DataFrame, id_col: str) -> None:
    """Document ids must be whole numbers; anything else is refused before any work."""
    if not isinstance(kind := df.schema[id_col].dataType, Y.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {kind.simpleString()}")


_zip: list = []


def _compressors():
    if not _zip:
        _zip.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
    return _zip


def dump(parts: dict[str, np.ndarray], level: int = 1) -> bytes:
    """Arrays by name as bytes; those of whole numbers byte by byte of all numbers, which compresses better."""
    head, body = [], []
    for k, v in parts.items():
        v = np.ascontiguousarray(v)
        planes = v.ndim == 1 and v.dtype.kind in "iu" and v.itemsize > 1
        head.append((k, v.dtype.str, v.shape, planes))
        body.append((v.view(np.uint8).reshape(-1, v.itemsize).T if planes else v).tobytes())
    h = pickle.dumps(head, protocol=5)
    data = b"".join([len(h).to_bytes(4, "little"), h, *body])
    return _compressors()[0].compress(data) if level == 1 else zstandard.ZstdCompressor(level=level).compress(data)


def load(data) -> dict[str, np.ndarray]:
    raw = _compressors()[1].decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for k, kind, shape, planes in pickle.loads(raw[4:at]):
        kind, n = np.dtype(kind), math.prod(shape)
        v = np.frombuffer(raw, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        at += len(v)
        out[k] = np.ascontiguousarray(v.reshape(kind.itemsize, -1).T).view(kind).reshape(-1) if planes else v.view(kind).reshape(shape)
    return out


class Route:
    """The way of records to n buckets: how many buckets a row is for (`widths`), level by level, the last level's for one."""

    def __init__(self, n: int):
        self.n, levels = n, 1
        while FAN**levels < n:
            levels += 1
        self.fan = math.ceil(round(n ** (1 / levels), 6))
        self.widths = [self.fan**k for k in range(levels - 1, -1, -1)]

    def rows(self, items: Iterable[tuple[int, int, dict]], own: int, level: int = 0) -> pa.RecordBatch:
        """(bucket, kind, arrays) as a record batch of SCHEMA, sent by the block (or bucket) `own`.

        Arrays of one name that meet in a bucket may be put end to end, so what they mean must allow that.
        """
        width, parts = self.widths[level], max(1, math.ceil(self.n / self.fan ** (level + 1)))
        if width > 1:
            group: dict[tuple[int, int], list] = {}
            for bucket, kind, x in items:
                group.setdefault((bucket // width, kind), []).append((bucket, x))
            items = [(g, kind, _bundle(x)) for (g, kind), x in group.items()]
        return rows(items, own % parts if width > 1 else 0)

    def table(self, items: Iterable[tuple[int, int, dict]], own: int) -> pa.Table:
        return pa.Table.from_batches([self.rows(items, own)])

    def relayed(self, df: DataFrame) -> DataFrame:
        """df, of rows(), with a row for each bucket: what the relays make of it."""
        for level in range(len(self.widths) - 1):
            df = df.repartition(self.n, "bucket", "part").groupBy("bucket", "part").applyInArrow(tidy(_relay(self, level)), SCHEMA)
        return df

    def spread(self, df: DataFrame) -> DataFrame:
        """df, of rows(), dealt by bucket; for groupBy('bucket') that follows."""
        return self.relayed(df).repartition(self.n, "bucket")


def rows(items: Iterable[tuple[int, int, dict]], part: int = 0) -> pa.RecordBatch:
    """(bucket, kind, arrays) as a record batch of SCHEMA."""
    items = list(items)
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _, _ in items], pa.int64()), pa.array([part] * len(items), pa.int64()), pa.array([k for _, k, _ in items], pa.int32()), pa.array([dump(x) for _, _, x in items], pa.binary())],
        schema=_ARROW,
    )


def _bundle(items: list[tuple[int, dict]]) -> dict:
    """Arrays for several buckets in one: those of each name end to end, and how long each bucket's are."""
    out = {"": np.array([b for b, _ in items], dtype=np.int64)}
    for k in items[0][1]:
        out[k] = np.concatenate([np.asarray(x[k]) for _, x in items])
        out[f"#{k}"] = np.array([len(x[k]) for _, x in items], dtype=np.int64)
    return out


def _relay(route: Route, level: int):
    """Sorts the bundles of several senders out by bucket, or by smaller group."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for kind, several in by_kind(table).items():
            x = joined(several)
            order = np.argsort(x[""], kind="stable")
            to = x[""][order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            moved = {}
            for k in x:
                if k and k[0] != "#":
                    size = x[f"#{k}"]
                    start = (np.cumsum(size) - size)[order]
                    size = size[order]
                    moved[k] = x[k][np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())], np.concatenate([[0], np.cumsum(size)])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                out.append((int(to[a]), kind, {k: v[cut[a] : cut[b]] for k, (v, cut) in moved.items()}))
        return pa.Table.from_batches([route.rows(out, table.column("part")[0].as_py(), level + 1)])

    return run


def split(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterable[tuple[int, dict]]:
    """The rows of equally long columns, for each bucket that has any."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    ends = [*cuts.tolist(), len(sorted_)]
    columns = {k: v[order] for k, v in columns.items()}
    lo = 0
    for hi in ends:
        yield int(sorted_[lo]), {k: v[lo:hi] for k, v in columns.items()}
        lo = hi


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of whole-number ids: Spark's pmod(xxhash64(id), n), so that plain rows and packed ones meet."""
    p1, p2, p3, p4, p5 = _PRIMES
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    with np.errstate(over="ignore"):
        h = (np.uint64(50) + p5) ^ turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h ^= h >> np.uint64(32)
    return np.where(ids == NULL_ID, 42 % n, h.view(np.int64) % n).astype(np.int64)


def dealt(docs: DataFrame, n: int, id_col: str, text_col: str, rest: list[str] | None = None) -> DataFrame:
    """docs as SCHEMA rows by bucket of id: ids and texts, and the columns `rest` as Arrow streams. A task sends about FLUSH_BYTES at a time."""
    from pyspark import TaskContext

    whole_ids(docs, id_col)
    route = Route(n)

    def run(batches):
        own, held, size = TaskContext.get().partitionId(), [], 0

        def flush():
            table = pa.Table.from_batches(held)
            ids = table.column(0).combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            buf, at = words.buffers(table.column(1))
            items = []
            for b, x in split(bucket_of(ids, n), {"row": np.arange(len(ids))}):
                r = x["row"]
                part = {"id": ids[r], "len": np.diff(at)[r], "text": np.concatenate([buf[at[i] : at[i + 1]] for i in r.tolist()])}
                if rest:
                    sink = pa.BufferOutputStream()
                    others = table.select(list(range(2, table.num_columns))).take(pa.array(r))
                    with pa.ipc.new_stream(sink, others.schema) as w:
                        w.write_table(others)
                    stream = np.frombuffer(sink.getvalue(), dtype=np.uint8)
                    part |= {"rest": stream, "rest_n": np.array([len(stream)])}
                items.append((b, DOCS, part))
            return route.rows(items, own)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_rest{k}") for k, c in enumerate(rest or [])])
    return route.spread(picked.mapInArrow(tidy_batches(run), SCHEMA))


def packed(docs: DataFrame, n: int, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """docs as SCHEMA rows, dealt to n blocks: runs of documents of about `chunk` bytes of text, whichever come one after another."""
    from pyspark import TaskContext

    whole_ids(docs, id_col)

    def run(batches):
        place = int(words.mix(np.array([TaskContext.get().partitionId() + 1], dtype=np.uint64))[0] % np.uint64(n))
        held, size = [], 0

        def flush():
            ids, buf, at = (np.concatenate([h[k] for h in held]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array([place % n], pa.int64()), pa.array([0], pa.int64()), pa.array([DOCS], pa.int32()), pa.array([dump({"id": ids, "len": at, "text": buf}, 3)], pa.binary())], schema=_ARROW)

        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            buf, at = words.buffers(batch.column(1))
            for lo, hi in words.runs(at, chunk):
                held.append((ids[lo:hi], buf[at[lo] : at[hi]], np.diff(at[lo : hi + 1])))
                size += at[hi] - at[lo]
                if size >= chunk // 2:
                    yield flush()
                    held, size, place = [], 0, place + 1
        if held:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(tidy_batches(run), SCHEMA).repartition(n, "bucket")


def some_rows(df: DataFrame, id_col: str, bytes_: int) -> DataFrame:
    """A sample by hash of the id: documents of about bytes_ in all."""
    share = min(1.0, bytes_ / max(1, stored_bytes(df)))
    return df.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def trim() -> None:
    """Give freed memory back to the system: workers live on, and the next group need not be as large."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f):
    """f of one Arrow table, with its memory given back when it is done; a worker that then idles holds little."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        trim()
        return out

    return run


def tidy_two(f):
    """tidy() for a function of two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        trim()
        return out

    return run


def tidy_batches(f):
    """tidy() for a function of an iterator of batches: after each batch that it yields, and at its end."""

    def run(batches):
        for batch in f(batches):
            yield batch
            del batch
            trim()

    return run


def by_kind(table: pa.Table) -> dict[int, list[dict]]:
    """The unpacked rows of a group, by kind."""
    out: dict[int, list[dict]] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        out.setdefault(kind, []).append(load(data.as_buffer()))
    return out


def joined(parts: list[dict]) -> dict | None:
    """Equally named arrays of all parts, end to end."""
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else None


def send(kind: int, bucket: np.ndarray, columns: dict) -> list:
    return [(b, kind, x) for b, x in split(bucket, columns)]


def gather(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that were sent as id, len and text, together: ids, buffer, offsets."""
    x = joined(parts) or {"id": np.zeros(0, np.int64), "len": np.zeros(0, np.int64), "text": np.zeros(0, np.uint8)}
    return x["id"], x["text"], np.concatenate([[0], np.cumsum(x["len"])]).astype(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir; a temporary folder stands in only where none is set and the master is local, as in tests."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        sc.setCheckpointDir(where)
    # a path without a scheme is one of the cluster's default file system
    return where if ":/" in where else spark._jvm.org.apache.hadoop.fs.Path(where).getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(where)).toString()


def file_system(uri: str):
    """The pyarrow file system of a URI, and the path in it; s3a is Hadoop's name for s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder of spark.checkpoint.dir; a folder of its own is used only where none is set, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table | None]:
    """dealt() documents of a bucket in order of id, ties by bytes: ids, tie numbers, buffer, offsets, other columns."""
    parts = by_kind(table).get(DOCS, [])
    ids, buf, at = gather([{k: x[k] for k in ("id", "len", "text")} for x in parts])
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(same):
        raw = buf.tobytes()
        key = {int(ids[order[i]]) for i in same}
        order = np.array(sorted(order.tolist(), key=lambda r: (ids[r], raw[at[r] : at[r + 1]] if int(ids[r]) in key else b"")), dtype=np.int64)
    size = np.diff(at)[order]
    new = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    moved = np.concatenate([buf[at[r] : at[r + 1]] for r in order.tolist()]) if len(order) else buf
    ids = ids[order]
    first = np.searchsorted(ids, ids, side="left")
    streams = [s for x in parts if "rest" in x for s in np.split(x["rest"], np.cumsum(x["rest_n"])[:-1])]
    rest = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(s.tobytes())).read_all() for s in streams]).take(pa.array(order)) if streams else None
    return ids, np.arange(len(ids)) - first, moved, new, rest
