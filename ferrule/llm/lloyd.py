"""Centroid clustering: Lloyd's rounds with a cover tree over the vectors and a tree over the centroids.

Vectors are whole numbers, floor(scale * x), so sums, means and squared distances are exact. Blocks of at most BLOCK
vectors each get a cover tree once: a node's children are centres more than half its scale apart, each with the vectors within
half of it. In every round a tree over the centroids is made, and both are walked at once. A pair (node of vectors, node
of centroids) is dropped if even its nearest points lie further apart than the node's farthest vector can lie from some
centroid. A node left with one centroid goes to it whole, with its sum from running sums; where both are leaves, the vectors are
compared with the centroids that are left, in whole numbers, ties to the smaller number. Bounds are in double precision with slack, so that no tie is dropped.

How it is spread. Vectors are packed in blocks where they are read, without a shuffle, and written with their trees to the shared
folder; each round is a job over the blocks, whose tasks send k sums and counts. Only those and the k centroids meet at the driver: k and the
number of components are parameters and don't grow with the input.

Cases. Vectors null, of another number of components, or with a null or non-finite component take no part, and give no row. Rows without id take part, but
don't start a centroid. Repeated rows count each. Fewer than k vectors start as many centroids; a centroid without vectors stays
where it is. Equal hashes go by id and then by vector. Ids must be whole numbers (TypeError), components below LARGEST / scale (OverflowError: squares would not
fit 64 bits). Empty tables give no row. Other columns are not read. Texts play no part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

BLOCK, LEAF, LARGEST = 2048, 16, 1 << 27
#: Components in sums at once, where vectors are compared with centroids.
CELLS = 1 << 22


class Tree:
    """A cover tree as arrays: node k holds the points order[low[k]:high[k]], its centre, its radius, and children first[k]:last[k]."""

    NAMES = ("order", "low", "high", "centre", "radius", "first", "last")

    def __init__(self, parts: dict[str, np.ndarray]):
        for k in self.NAMES:
            setattr(self, k, parts[k])

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    @property
    def leaf(self) -> np.ndarray:
        return self.first == self.last

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        x = points.astype(np.float64)
        square = (x * x).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))
        slack = 1e-6 * np.sqrt(square.max())
        order = np.arange(len(x))
        low, high, centre, first, last = [0], [len(x)], [0], [], []
        radius = [apart[0].max()]
        for k in _growing(low):
            a, b, c, r = low[k], high[k], centre[k], radius[k]
            first.append(len(low))
            if b - a > leaf and r > slack:
                half, left, done = 2.0 ** (np.ceil(np.log2(r)) - 1), order[a:b].copy(), a
                while len(left):
                    d = apart[c, left]
                    near = d <= half
                    near |= left == c
                    mine = left[near]
                    order[done : done + len(mine)] = mine
                    low.append(done)
                    done += len(mine)
                    high.append(done)
                    centre.append(c)
                    radius.append(d[near].max())
                    left = left[~near]
                    c = left[0] if len(left) else c
            last.append(len(low))
        place = np.empty(len(x), dtype=np.int64)
        place[order] = np.arange(len(x))
        return cls({
            "order": order, "low": np.array(low), "high": np.array(high), "centre": place[np.array(centre)],
            "radius": np.array(radius) + slack, "first": np.array(first), "last": np.array(last),
        })


def _growing(nodes: list):
    """Numbers of nodes, those that are added on the way too."""
    k = 0
    while k < len(nodes):
        yield k
        k += 1


def _children(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of several ranges, its place in the list of them and its numbers, one range after another."""
    n = last - first
    rep = np.repeat(np.arange(len(n)), n)
    return rep, np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + first[rep]


class Walk:
    """The nearest centroid of each point of a tree (in the tree's order), and how much had to be compared."""

    def __init__(self, points: np.ndarray, tree: Tree, centroids: np.ndarray):
        self.x, self.tree, self.c, self.to = points, tree, centroids, Tree.of(centroids, 1)
        self.label = np.full(len(points), -1, dtype=np.int64)
        self.compared = self.visited = 0  # vectors with centroids, nodes with nodes
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []  # nodes that went to one centroid
        self.single: list[np.ndarray] = []  # points that were compared
        self.run()

    def run(self) -> None:
        t, u = self.tree, self.to
        xf, cf = self.x.astype(np.float64), self.c[u.order].astype(np.float64)
        size = u.high - u.low
        q, r, known = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.inf)
        while len(q):
            self.visited += len(q)
            head = np.flatnonzero(np.diff(q, prepend=-1))
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(q))))
            d = np.sqrt(((xf[t.centre[q]] - cf[u.centre[r]]) ** 2).sum(axis=1))
            reach = t.radius[q] + u.radius[r]
            bound = np.minimum(np.minimum.reduceat(d + reach, head), known[head])
            keep = d - reach <= bound[group] * (1 + 1e-9) + 1e-6
            q, r, group = q[keep], r[keep], group[keep]
            head = np.flatnonzero(np.diff(q, prepend=-1))
            n = np.diff(np.append(head, len(q)))
            group_, node = np.repeat(np.arange(len(head)), n), q[head]
            bound = bound[group[head]]
            one = np.add.reduceat(size[r], head) == 1
            if one.any():
                self.whole.append((node[one], u.order[u.low[r[head[one]]]]))
            deepest = np.maximum.reduceat(np.where(u.leaf[r], -1.0, u.radius[r]), head)
            compare = ~one & t.leaf[node] & (deepest < 0)
            if compare.any():
                self.compare(q[compare[group_]], r[compare[group_]])
            split = ~one & ~t.leaf[node] & (t.radius[node] >= deepest)
            other = ~(one | compare | split)
            out = []
            s = np.flatnonzero(split)
            if len(s):  # each child of the node takes the node's centroids along
                rep, child = _children(t.first[node[s]], t.last[node[s]])
                rep2, pair = _children(head[s][rep], (head + n)[s][rep])
                out.append((child[rep2], r[pair], bound[s][rep][rep2]))
            o = np.flatnonzero(other[group_])
            if len(o):
                inner = ~u.leaf[r[o]]
                rep, child = _children(np.where(inner, u.first[r[o]], r[o]), np.where(inner, u.last[r[o]], r[o] + 1))
                out.append((q[o][rep], child, bound[group_[o]][rep]))
            if not out:
                break
            q, r, known = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(q, kind="stable")
            q, r, known = q[order], r[order], known[order]
        for node, j in self.whole:
            rep, point = _children(t.low[node], t.high[node])
            self.label[point] = j[rep]

    def compare(self, q: np.ndarray, r: np.ndarray) -> None:
        """Points of leaves with all centroids of their leaves."""
        t, u = self.tree, self.to
        rep, c = _children(u.low[r], u.high[r])
        rep2, p = _children(t.low[q[rep]], t.high[q[rep]])
        c = u.order[c[rep2]]
        order = np.lexsort((c, p))
        p, c = p[order], c[order]
        self.compared += len(p)
        d = distances(self.x, self.c, p, c)
        head = np.flatnonzero(np.diff(p, prepend=-1))
        least = np.minimum.reduceat(d, head)
        hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(head, len(p)))))
        point, at = np.unique(p[hit], return_index=True)
        self.label[point] = c[hit[at]]
        self.single.append(point)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points of each centroid, from running sums where nodes went whole."""
        k, d = self.c.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        if self.whole:
            running = np.concatenate([np.zeros((1, d), np.int64), np.cumsum(self.x, axis=0, dtype=np.int64)])
            for node, j in self.whole:
                np.add.at(total, j, running[self.tree.high[node]] - running[self.tree.low[node]])
                np.add.at(count, j, self.tree.high[node] - self.tree.low[node])
        for point in self.single:
            np.add.at(total, self.label[point], self.x[point])
            np.add.at(count, self.label[point], 1)
        return count, total


def distances(x: np.ndarray, c: np.ndarray, p: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[p], c[j]), in whole numbers."""
    out = np.empty(len(p), dtype=np.int64)
    step = max(1, CELLS // max(1, x.shape[1]))
    for lo in range(0, len(p), step):
        apart = x[p[lo : lo + step]].astype(np.int64) - c[j[lo : lo + step]]
        out[lo : lo + step] = np.einsum("ij,ij->i", apart, apart)
    return out


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """(data): blocks of vectors in the order of their trees, with ids and trees; vectors: (id, v) without bad ones."""

    def run(batches):
        held, size = [], 0

        def flush(rows: pa.Table):
            doc = rows.column("id").combine_chunks()
            raw = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            whole = np.floor(scale * raw)
            if np.abs(whole).max(initial=0) >= LARGEST:
                raise OverflowError("components are too large for exact squares")
            x = whole.astype(np.int32)
            tree = Tree.of(x)
            data = {"id": doc.fill_null(0).to_numpy().astype(np.int64)[tree.order], "known": doc.is_valid().to_numpy(zero_copy_only=False)[tree.order], "x": x[tree.order], **tree.parts()}
            return pa.RecordBatch.from_arrays([pa.array([blocks.dump(data)], pa.binary())], names=["data"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield flush(rows.slice(0, BLOCK))
                held, size = rows.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield flush(pa.Table.from_batches(held))

    return vectors.mapInArrow(blocks.tidy_batches(run), "data binary")


def _walks(batches, centroids: np.ndarray):
    for batch in batches:
        for data in batch.column(0):
            block = blocks.load(data.as_buffer())
            yield block, Walk(block["x"], Tree(block), centroids)


def _summed(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of each centroid that has vectors."""
    k, d = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, walk in _walks(batches, centroids):
            n, s = walk.sums()
            count, total = count + n, total + s
        cells = np.concatenate([count[:, None], total], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), d + 1)), pa.array(np.tile(np.arange(d + 1), k)), pa.array(cells)], names=["j", "at", "n"])

    cells = packed.mapInArrow(blocks.tidy_batches(run), "j long, at long, n long").groupBy("j", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out: dict[int, list[int]] = {}
    for r in cells.collect():  # k times (d + 1) numbers
        out.setdefault(r.j, [0] * (d + 1))[r.at] = int(r.n)
    return {j: (v[0], v[1:]) for j, v in out.items() if v[0]}


def cluster(vectors: DataFrame, folder: str, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector of dims components, and the final centroids. Blocks and result lie in folder.

    Centroids start as the k vectors whose ids have the smallest SHA-256 of "salt:id".
    """
    spark = vectors.sparkSession
    blocks.prepare(spark)
    blocks.whole_ids(vectors, id_col)
    v = F.col("v")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    _packed(kept, scale).write.parquet(f"{folder}/blocks")
    packed = spark.read.parquet(f"{folder}/blocks")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    start = kept.where("id is not null").orderBy(name, "id", "v").limit(k).collect()
    centroids = np.floor(scale * np.array([r.v for r in start], dtype=np.float64)).astype(np.int64).reshape(len(start), dims)
    if len(start):
        for _ in range(rounds):
            for j, (n, total) in _summed(packed, centroids).items():
                centroids[j] = [s // n for s in total]

    def last(batches):
        for block, walk in _walks(batches, centroids):
            far = distances(block["x"], centroids, np.arange(len(walk.label)), walk.label)
            yield pa.RecordBatch.from_arrays([pa.array(block["id"], mask=~block["known"]), pa.array(walk.label, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    schema = "vec_id long, cluster int, distance long"
    done = packed.mapInArrow(blocks.tidy_batches(last), schema) if len(start) else packed.where("false").select(F.lit(0).cast("long").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    done.write.parquet(f"{folder}/assigned")
    return spark.read.schema(schema).parquet(f"{folder}/assigned"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with its cluster's and the whole inertia, and the SHA-256 of its centroid's components."""
    per = {r.cluster: int(r.n) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # at most k rows
    rows = [(j, n, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in per.items()]
    known = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def work_folder(spark) -> str:
    return f"{blocks.shared_folder(spark)}/clusters-{uuid.uuid4().hex}"


def remove(folder: str) -> None:
    """Delete what cluster() wrote."""
    where, path = blocks.file_system(folder)
    where.delete_dir(path)
