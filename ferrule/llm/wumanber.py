"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words. Patterns are the windows of `window` words of each benchmark item; an item of
fewer words is one shorter pattern; windows that several items share are one pattern. For each pattern length
a block shift table says how many words a position can be passed over; where the shift is 0, the block's hash
bucket lists the patterns that end with this block, and a direct comparison confirms them. Positions of many
documents move at once, as numpy lanes; a lane is a stretch of one document, so a long document is many lanes.

A benchmark of up to TABLE_BYTES of text goes to the tasks with the plan. A larger one is cut into parts by hash of
the item; executors make each part's tables and write them to the shared folder, and each task reads them, one after
another, for every HELD_BYTES of documents. So documents are read once, and neither driver nor task holds more
than one part.

Cases. A null text or one without words has no windows, 0 words, 0 hits and is clean. A null or wordless
item gives no pattern; items with the same words all count. Repeated rows each give a row. A very long text is one
task's as a whole. An item whose id is null is searched for and hits words, but isn't named among the items. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, words

#: Text of the benchmark, in bytes, that one set of tables holds, and documents for which each set of several is read once.
TABLE_BYTES, HELD_BYTES = 16 << 20, 16 << 20
_LANE = 256
_BITS = 20


class Automaton:
    """Shift and bucket tables for all patterns of m words: stretches of the items' text."""

    def __init__(self, m: int, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, more: np.ndarray, place: np.ndarray, item: np.ndarray):
        self.m, self.b = m, min(2, m)
        self.buf, self.starts, self.ends, self.hashes = buf, starts, ends, hashes
        key = [words.chain(*[h[place + j] for j in range(m)]) for h in (hashes, more)]
        order = np.lexsort((item, key[1], key[0]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[0][order[1:]] != key[0][order[:-1]]) | (key[1][order[1:]] != key[1][order[:-1]])
        self.place = place[order[new]]  # the first word of each distinct pattern
        self.item, self.item_at = item[order], np.append(np.flatnonzero(new), len(order))
        self.shift = np.full(1 << _BITS, m - self.b + 1, dtype=np.int32)
        for end in range(self.b, m + 1):
            np.minimum.at(self.shift, self.block([hashes[self.place + j] for j in range(end - self.b, end)]), m - end)
        last = self.block([hashes[self.place + j] for j in range(m - self.b, m)])
        self.order = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.order], np.arange((1 << _BITS) + 1))

    @staticmethod
    def block(h: list[np.ndarray]) -> np.ndarray:
        return (words.chain(*h) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def search(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word number of an occurrence's first word, pattern)."""
        m, b, hashes, first = self.m, self.b, run.hashes, run.first
        n = np.diff(first)
        lanes = np.maximum(0, -(-(n - m + 1) // _LANE))
        text = np.repeat(np.arange(len(n)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = first[text] + k * _LANE + m - 1
        end = np.minimum(pos + _LANE, first[text + 1])
        found = []
        while len(pos):
            skip = self.shift[self.block([hashes[pos - j] for j in range(b - 1, -1, -1)])]
            found.append(pos[skip == 0])
            pos = pos + np.maximum(skip, 1)
            left = pos < end
            pos, end = pos[left], end[left]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        key = self.block([hashes[at - j] for j in range(b - 1, -1, -1)])
        size = self.first[key + 1] - self.first[key]
        slot = np.repeat(self.first[key], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at, pattern = np.repeat(at, size) - m + 1, self.order[slot]
        for j in range(m):
            same = hashes[at + j] == self.hashes[self.place[pattern] + j]
            at, pattern = at[same], pattern[same]
        for j in range(m):  # the words themselves
            same = equal_bytes(run.buf, run.starts[at + j], run.ends[at + j], self.buf, self.starts[self.place[pattern] + j], self.ends[self.place[pattern] + j])
            at, pattern = at[same], pattern[same]
        return at, pattern

    def items(self, pattern: np.ndarray) -> np.ndarray:
        """Items of any of these patterns."""
        lo, n = self.item_at[pattern], self.item_at[pattern + 1] - self.item_at[pattern]
        return np.unique(self.item[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])


def equal_bytes(a: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Whether stretches of a are those of b, pair by pair."""
    n = a_hi - a_lo
    out = n == b_hi - b_lo
    n, cut = n[out], np.cumsum(n[out])
    step = np.arange(n.sum()) - np.repeat(cut - n, n)
    wrong = np.concatenate([[0], np.cumsum(a[np.repeat(a_lo[out], n) + step] != b[np.repeat(b_lo[out], n) + step])])
    out[out] = wrong[cut] == wrong[cut - n]
    return out


class Run:
    """Texts lo to hi of a column as words: spans, hashes, each text's first word; and what is found in them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        base = offsets[lo]
        self.lo, self.hi = lo, hi
        self.buf = words.lower(buf[base : offsets[hi]])
        self.starts, self.ends, self.first = words.spans(self.buf, offsets[lo : hi + 1] - base, words.ALNUM)
        self.hashes = words.span_hash(words.prefix_hash(self.buf), self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.change = np.zeros(len(self.starts) + 1, dtype=np.int32)
        self.items: dict[int, set[str]] = {}

    def look(self, automata: list[Automaton], names: list[str | None]) -> None:
        for a in automata:
            at, pattern = a.search(self)
            if len(at):
                np.add.at(self.change, at, 1)
                np.add.at(self.change, at + a.m, -1)
                text = np.searchsorted(self.first, at, side="right") - 1
                for t in np.unique(text).tolist():
                    self.items.setdefault(t, set()).update(names[i] for i in a.items(np.unique(pattern[text == t])).tolist())

    def hit(self) -> np.ndarray:
        return np.cumsum(self.change[:-1]) > 0


def patterns(texts: pa.Array, window: int) -> list[Automaton]:
    """One automaton for each length of pattern; a pattern's items are places in texts."""
    buf, offsets = words.buffers(texts)
    buf = words.lower(buf)
    starts, ends, first = words.spans(buf, offsets, words.ALNUM)
    if not len(starts):
        return []
    hashes, more = (words.span_hash(words.prefix_hash(buf, k), starts, ends, k) for k in (0, 1))
    n = np.diff(first)
    out = []
    for m in np.unique(np.minimum(n[n > 0], window)).tolist():
        of = np.flatnonzero(n >= window if m == window else n == m)
        count = n[of] - m + 1
        item = np.repeat(of, count)
        place = np.repeat(first[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out.append(Automaton(m, buf, starts, ends, hashes, more, place, item))
    return out


def tables_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[Callable[[], Iterator[tuple[list[Automaton], list]]], int]:
    """What gives a task the automata and items' names of each part in turn, and how many parts there are."""
    picked = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = picked.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    if total <= TABLE_BYTES:
        items = picked.toArrow()  # TABLE_BYTES of text at most
        made: list = []

        def one():
            if not made:
                made.append((patterns(items.column(1).combine_chunks(), window), items.column(0).to_pylist()))
            yield made[0]

        return one, 1
    n = -(-total * 2 // TABLE_BYTES)
    folder = f"{blocks.shared_folder(benchmark.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    where, path = blocks.file_system(folder)
    where.create_dir(path, recursive=True)

    def write(table: pa.Table) -> pa.Table:
        import pickle

        where, path = blocks.file_system(folder)
        name = f"part-{uuid.uuid4().hex}"  # of this attempt
        with where.open_output_stream(f"{path}/{name}") as f:
            pickle.dump((patterns(table.column("t").combine_chunks(), window), table.column("i").to_pylist()), f)
        return pa.table({"name": [name]})

    parts = picked.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition(n, "part").groupBy("part").applyInArrow(blocks.tidy(write), "name string").collect()
    names = sorted(r.name for r in parts)

    def several():
        import pickle

        where, path = blocks.file_system(folder)
        for name in names:
            with where.open_input_stream(f"{path}/{name}") as f:
                yield pickle.loads(f.read())

    return several, len(names)


def scan(batches: Iterator[pa.RecordBatch], column: int, tables: Callable, held_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[Run]]]:
    """Each batch with its texts as runs in which all parts of the tables have been looked for."""
    held, size = [], 0

    def done():
        for automata, names in tables():
            for _, runs in held:
                for run in runs:
                    run.look(automata, names)
        yield from held

    for batch in batches:
        buf, offsets = words.buffers(batch.column(column))
        held.append((batch, [Run(buf, offsets, lo, hi) for lo, hi in words.runs(offsets)]))
        size += len(buf)
        if size >= held_bytes:
            yield from done()
            held, size = [], 0
    yield from done()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans): words, words hit, ids of the items that occur, and the hit runs as word numbers."""
    blocks.prepare(docs.sparkSession)
    schema = docs.select(id_col).schema.simpleString()[7:-1] + ", n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    tables, parts = tables_of(benchmark, item_col, item_text_col, window)
    held = HELD_BYTES if parts > 1 else 0

    def run(batches):
        for batch, runs in scan(batches, 1, tables, held):
            n, hits, found, spans_ = [], [], [], []
            for r in runs:
                hit = r.hit()
                total = np.concatenate([[0], np.cumsum(hit)])
                n.append(np.diff(r.first))
                hits.append(total[r.first[1:]] - total[r.first[:-1]])
                for t in range(r.hi - r.lo):
                    found.append(sorted(r.items.get(t, set()) - {None}))
                    part = hit[r.first[t] : r.first[t + 1]].astype(np.int8) if hits[-1][t] else np.zeros(0, np.int8)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], part, [0]])))
                    spans_.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            columns = [batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(np.concatenate(hits) if hits else [], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans_, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_hit", "items", "spans"])

    return docs.select(id_col, text_col).mapInArrow(blocks.tidy_batches(run), schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of decontaminate()'s result."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """docs, all columns, without the documents in which a window of an item occurs."""
    blocks.prepare(docs.sparkSession)
    k = docs.columns.index(text_col)
    tables, parts = tables_of(benchmark, item_col, item_text_col, window)
    held = HELD_BYTES if parts > 1 else 0

    def run(batches):
        for batch, runs in scan(batches, k, tables, held):
            keep = np.ones(batch.num_rows, dtype=bool)
            for r in runs:
                keep[[r.lo + t for t in r.items]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(blocks.tidy_batches(run), docs.schema)
