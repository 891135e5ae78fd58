"""Removal of repeated byte strings by two-stage suffix sorting.

Removed is each byte that a string of `length` bytes covers that also starts earlier: in a document with a
smaller id, or earlier in the same one. Strings never cross documents and are judged on the input.

How it is spread. Equal strings have the same lowest k-gram hash at the same place. So the windows of a
text, cut where that k-gram (the anchor) changes, are short segments that need to meet only segments of the
same anchor. Equal segments are counted once, first within a block of documents, then over all. Where an
anchor still has several different segments, their text goes to one bucket by anchor, and there, for each of PARTS parts of the anchors,

1. a suffix array is built over the bucket's text: suffixes smaller than their successors are sorted
   directly, all others induced by scans over the buckets of first bytes (Itoh and Tanaka's two stages);
2. adjacent suffixes with a common prefix of `length` bytes form groups; all of a group but its first are
   repeats.

Order to the depth of `length` bytes is enough, so sorting stops there. An anchor with very many different
segments would fill one bucket: its windows go out one by one, by the hash of the whole window (128 bits), which
spreads them. Anchors that a sample of documents (by hash of the id) shows to be such go that way from the start;
those that the counts show afterwards (segments of over WIDE bytes) once they are counted. This settles routing only, never a result.

Cases. A null text counts as empty; a text under `length` bytes loses nothing. Rows with equal ids are
ordered by their bytes; null ids come first. Empty tables give none. A very long text is one task's, as a whole,
in runs; texts up to 2 GB. `length` from 32 to 32,768, ids must be whole numbers; else an error. Other columns are kept by dedup() and
not read by report(). dedup() drops bytes of a character that was cut; a document that repeats others
wholly stays, with empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks, words

K = 32
DOCS, RUNS, MARKS, NEEDED, SEGMENTS, WINDOWS = range(6)
assert DOCS == blocks.DOCS
#: The sample that finds hot anchors: bytes for each bucket, and the documents in it that show an anchor with different segments.
SAMPLE_BYTES, SAMPLE_LEAST, HOT_SEEN, HOT_EACH = 64 << 10, 16 << 20, 16, 80
WIDE, LONGEST, PARTS = 4 << 20, 1 << 15, 8


def segments(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, text number, first window, windows) of the texts in buf."""
    n, w = len(buf), length - K + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = words.prefix_hash(buf)
    _, inverse = words.powers(n + 1)
    g = (sums[K:] - sums[:-K]) * inverse[: n - K + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0x9FB21C651E98DF25)
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - K + 1, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: -(w - span)], low[w - span :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first, last = at[:-1], at[1:] - length
    whole = last >= first
    edge = np.zeros(n - length + 2, dtype=np.int8)
    edge[first[whole]] += 1
    edge[last[whole] + 1] -= 1
    begin = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = np.empty(len(begin), dtype=bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[first[whole]] = True
    a = np.flatnonzero(begin & new)
    doc = np.searchsorted(at, a, side="right") - 1
    stop = np.minimum(np.append(a[1:], n), last[doc] + 1)
    p = place[a]
    anchor = words.span_hash(sums, p, p + K)
    return anchor, words.span_hash(words.prefix_hash(buf, 1), a, stop - 1 + length, 1), doc, a, stop - a


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of text in an order that agrees with their first `depth` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    keys = eight(text, depth)
    after = np.append(text[1:].astype(np.int16), -1)
    differs = np.flatnonzero(text != after)  # the last of each run of one byte
    smaller = (text[differs] < after[differs])[np.searchsorted(differs, np.arange(n))]
    direct = sort_direct(np.flatnonzero(smaller), keys, depth)
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        part = []
        while len(level):  # a run of one byte: each level lies one byte before the last
            part.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == c]
        part.append(direct[bounds[c] : bounds[c + 1]])
        done = np.concatenate(part)
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        before = before[text[before] > c]
        heads_ = text[before]
        order = np.argsort(heads_, kind="stable")
        before, heads_ = before[order], heads_[order]
        cuts = np.flatnonzero(np.diff(heads_)) + 1
        for x in np.split(before, cuts):
            if len(x):
                waiting[text[x[0]]].append(x)
    return np.concatenate(out)


def eight(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position the next 8 bytes as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    out = np.zeros(len(text) + depth + 8, dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(out)]
    return out


def sort_direct(starts: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """starts by their first `depth` bytes, 8 at a time; only those that still tie are sorted further."""
    order = starts[np.argsort(keys[starts], kind="stable")]
    group = np.zeros(len(order), dtype=np.int64)
    if len(order):
        group[1:] = np.cumsum(keys[order[1:]] != keys[order[:-1]])
    slots = np.arange(len(order))
    for done in range(8, depth, 8):
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = size[group] > 1
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        at = order[slots]
        k = keys[at + done]
        by = np.lexsort((k, group))
        order[slots] = at[by]
        k, g = k[by], group[by]
        new = np.empty(len(g), dtype=bool)
        new[0] = True
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
    return order


def repeats(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Flags for the positions `windows` (a flag each byte of text) whose `length` bytes also start at an earlier such position."""
    sa = suffix_array(text, length)
    sa = sa[windows[sa]]
    out = np.zeros(len(text), dtype=bool)
    if len(sa) < 2:
        return out
    keys = eight(text, length)
    same = np.arange(1, len(sa))
    for j in [*range(0, length - 7, 8), max(0, length - 8)]:
        same = same[keys[sa[same] + j] == keys[sa[same - 1] + j]]
    new = np.ones(len(sa), dtype=bool)
    new[same] = False
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(sa, heads)
    out[sa] = sa != np.repeat(least, np.diff(np.append(heads, len(sa))))
    return out


def hot_anchors(docs: DataFrame, id_col: str, text_col: str, length: int, n: int) -> np.ndarray:
    """Anchors that many sampled documents show with different segments: at most HOT_EACH for each bucket."""

    def run(batches):
        for batch in batches:
            buf, at = words.buffers(batch.column(0))
            for lo, hi in words.runs(at):
                anchor, segment, _, _, _ = segments(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], length)
                pair = np.unique(np.stack([anchor, segment], axis=1), axis=0) if len(anchor) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].astype(np.int64)), pa.array(pair[:, 1].astype(np.int64))], names=["anchor", "segment"])

    few = blocks.some_rows(docs.select(id_col, text_col), id_col, max(SAMPLE_LEAST, n * SAMPLE_BYTES)).select(text_col)
    seen = few.mapInArrow(blocks.tidy_batches(run), "anchor long, segment long").distinct().groupBy("anchor").count().where(F.col("count") >= HOT_SEEN)
    return np.array(sorted(r[0] for r in seen.orderBy(F.desc("count"), "anchor").limit(n * HOT_EACH).collect()), dtype=np.int64).astype(np.uint64)


def _runs_to_marks(doc: np.ndarray, tie: np.ndarray, s: np.ndarray, e: np.ndarray) -> dict:
    return {"doc": doc, "tie": tie.astype(np.int32), "s": s.astype(np.int32), "e": e.astype(np.int32)}


def _find(docs: DataFrame, n: int, hot: np.ndarray, length: int) -> DataFrame:
    """Rows of kind MARKS by the bucket of their document: the byte ranges to remove."""
    hot, route, most = np.sort(hot), blocks.Route(n), WIDE

    def local(table: pa.Table) -> pa.Table:  # segments of a block; all but the first of equal ones are marked here
        ids, tie, buf, at, _ = blocks.ordered(table)
        own = table.column("bucket")[0].as_py()
        found = []
        for lo, hi in words.runs(at):
            anchor, segment, doc, a, m = segments(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], length)
            if len(hot) and len(anchor):
                i = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                is_hot = hot[i] == anchor
                if is_hot.any():
                    part = buf[at[lo] : at[hi]]
                    one = np.repeat(a[is_hot], m[is_hot]) + np.arange(m[is_hot].sum()) - np.repeat(np.cumsum(m[is_hot]) - m[is_hot], m[is_hot])
                    whole = [words.span_hash(words.prefix_hash(part, j), one, one + length, j) for j in (0, 1)]
                    rest = ~is_hot
                    anchor, segment = np.concatenate([anchor[rest], whole[0]]), np.concatenate([segment[rest], whole[1]])
                    doc, a, m = np.concatenate([doc[rest], np.repeat(doc[is_hot], m[is_hot])]), np.concatenate([a[rest], one]), np.concatenate([m[rest], np.ones(len(one), np.int64)])
            found.append((anchor, segment, doc + lo, a - (at[lo:hi] - at[lo])[doc] if len(doc) else a, m))
        out = []
        if found:
            anchor, segment, doc, a, m = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((a, doc, segment))
            anchor, segment, doc, a, m = anchor[order], segment[order], doc[order], a[order], m[order]
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (segment[1:] != segment[:-1]) | (anchor[1:] != anchor[:-1])
            old = ~new
            if old.any():
                s, e, d = merged(doc[old], a[old], a[old] + m[old] - 1 + length)
                out.append((own, MARKS, _runs_to_marks(ids[d], tie[d], s, e)))
            d = doc[new]
            out += blocks.send(RUNS, (anchor[new] % np.uint64(n)).astype(np.int64), {"anchor": anchor[new], "segment": segment[new], "doc": ids[d], "tie": tie[d].astype(np.int32), "a": a[new].astype(np.int32), "m": m[new].astype(np.uint16)})
        return route.table(out, own)

    def overall(table: pa.Table) -> pa.Table:  # first of equal segments over all blocks; anchors with several
        kinds = blocks.by_kind(table)
        own = table.column("bucket")[0].as_py()
        out = [(own, MARKS, x) for x in kinds.get(MARKS, [])]
        if x := blocks.joined(kinds.get(RUNS, [])):
            order = np.lexsort((x["a"], x["tie"], x["doc"], x["segment"], x["anchor"]))
            x = {k: v[order] for k, v in x.items()}
            other = np.ones(len(order), dtype=bool)
            other[1:] = x["anchor"][1:] != x["anchor"][:-1]
            new = other.copy()
            new[1:] |= x["segment"][1:] != x["segment"][:-1]
            old = {k: v[~new] for k, v in x.items()}
            end = old["a"].astype(np.int64) + old["m"] - 1 + length
            out += blocks.send(MARKS, blocks.bucket_of(old["doc"], n), _runs_to_marks(old["doc"], old["tie"], old["a"], end))
            which = np.cumsum(other) - 1
            several = new & (np.bincount(which, weights=new)[which] > 1)
            size = np.bincount(which, weights=new * (x["m"].astype(np.int64) - 1 + length))[which]
            need = {k: x[k][several] for k in ("anchor", "doc", "tie", "a", "m")} | {"wide": size[several] > most}
            out += blocks.send(NEEDED, blocks.bucket_of(need["doc"], n), need)
        return route.table(out, own)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:  # text of the segments that have to be sorted
        kinds = blocks.by_kind(right)
        own = (right if right.num_rows else left).column("bucket")[0].as_py()
        out = [(own, MARKS, x) for x in kinds.get(MARKS, [])]
        need = blocks.joined(kinds.get(NEEDED, []))
        if need and left.num_rows:
            ids, tie, buf, at, _ = blocks.ordered(left)
            row = np.searchsorted(ids, need["doc"]) + need["tie"]
            for r in np.unique(row[need["wide"]]).tolist():  # windows of a document, one by one
                mine = need["wide"] & (row == r)
                a, m = need["a"][mine].astype(np.int64), need["m"][mine].astype(np.int64)
                p = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
                h = [words.span_hash(words.prefix_hash(buf[at[r] : at[r + 1]], j), p, p + length, j) for j in (0, 1)]
                out += blocks.send(WINDOWS, (h[0] % np.uint64(n)).astype(np.int64), {"h": h[0], "g": h[1], "doc": np.full(len(p), ids[r]), "tie": np.full(len(p), tie[r], dtype=np.int32), "a": p.astype(np.int32)})
            row, need = row[~need["wide"]], {k: v[~need["wide"]] for k, v in need.items() if k != "wide"}
            to = (need["anchor"] % np.uint64(n)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            start, size = (at[row] + need["a"])[order], (need["m"].astype(np.int64) - 1 + length)[order]
            ends = np.cumsum(size)
            flat = buf[np.repeat(start - (ends - size), size) + np.arange(size.sum())]
            place = np.arange(len(order))
            for b, x in blocks.split(to[order], {"i": place}):
                i = x["i"]
                rows_ = order[i]
                lo, hi = ends[i[0]] - size[i[0]], ends[i[-1]]
                out.append((b, SEGMENTS, {"part": (need["anchor"][rows_] // np.uint64(n) % np.uint64(PARTS)).astype(np.uint8), "doc": need["doc"][rows_], "tie": need["tie"][rows_], "a": need["a"][rows_], "m": need["m"][rows_], "text": flat[lo:hi]}))
        return route.table(out, own)

    def sort(table: pa.Table) -> pa.Table:  # the suffix array of a bucket
        kinds = blocks.by_kind(table)
        own = table.column("bucket")[0].as_py()
        out = [(own, MARKS, x) for x in kinds.get(MARKS, [])]
        every = blocks.joined(kinds.pop(SEGMENTS, []))
        for part in range(PARTS if every else 0):  # segments of an anchor are in one part; a part's suffix array is small
            size = every["m"].astype(np.int64) - 1 + length
            mine = every["part"] == part
            if not mine.any():
                continue
            x = {k: v[mine] for k, v in every.items() if k != "text"} | {"text": every["text"][np.repeat(mine, size)]}
            size = size[mine]
            start = np.cumsum(size) - size
            order = np.lexsort((x["a"], x["tie"], x["doc"]))
            size, m = size[order], x["m"][order].astype(np.int64)
            begin = np.cumsum(size) - size
            text = x["text"][np.repeat(start[order] - begin, size) + np.arange(size.sum())]
            edge = np.zeros(len(text) + 1, dtype=np.int8)
            edge[begin] += 1
            edge[begin + m] -= 1
            again = repeats(text, np.cumsum(edge[:-1], dtype=np.int8) > 0, length)
            step = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            seg = np.searchsorted(begin, s, side="right") - 1
            r = order[seg]
            low = x["a"][r] + (s - begin[seg])
            out += blocks.send(MARKS, blocks.bucket_of(x["doc"][r], n), _runs_to_marks(x["doc"][r], x["tie"][r], low, low + (e - s) - 1 + length))
        if x := blocks.joined(kinds.get(WINDOWS, [])):
            order = np.lexsort((x["a"], x["tie"], x["doc"], x["g"], x["h"]))
            x = {k: v[order] for k, v in x.items()}
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (x["h"][1:] == x["h"][:-1]) & (x["g"][1:] == x["g"][:-1])
            doc, tie, low = (x[k][again] for k in ("doc", "tie", "a"))
            out += blocks.send(MARKS, blocks.bucket_of(doc, n), _runs_to_marks(doc, tie, low, low + length))
        return route.table(out, own)

    grouped = lambda df: route.spread(df).groupBy("bucket")
    first = grouped(docs.groupBy("bucket").applyInArrow(blocks.tidy(local), blocks.SCHEMA)).applyInArrow(blocks.tidy(overall), blocks.SCHEMA)
    marks = grouped(docs.groupBy("bucket").cogroup(grouped(first)).applyInArrow(blocks.tidy_two(cut), blocks.SCHEMA)).applyInArrow(blocks.tidy(sort), blocks.SCHEMA)
    return route.spread(marks)


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges s:e of documents, those that touch made one."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    base = doc * np.int64(1 << 32)
    top = np.maximum.accumulate(base + e)
    new = np.ones(len(s), dtype=bool)
    new[1:] = base[1:] + s[1:] > top[:-1]
    heads = np.flatnonzero(new)
    return s[heads], np.maximum.reduceat(base + e, heads) - base[heads], doc[heads]


def _removed(table: pa.Table, marks: list[dict]):
    ids, tie, buf, at, other = blocks.ordered(table)
    edge = np.zeros(len(buf) + 1, dtype=np.int32)
    if x := blocks.joined(marks):
        row = np.searchsorted(ids, x["doc"]) + x["tie"]
        np.add.at(edge, at[row] + x["s"], 1)
        np.add.at(edge, at[row] + x["e"], -1)
    return ids, buf, at, np.cumsum(edge[:-1]) > 0, other


def _kept(buf: np.ndarray, at: np.ndarray, gone: np.ndarray) -> Iterator[bytes]:
    total = np.concatenate([[0], np.cumsum(~gone)])[at]
    raw = buf[~gone]
    return (raw[a:b].tobytes() for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True))


def _start(docs: DataFrame, id_col: str, text_col: str, rest: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """Documents by bucket, and the byte ranges to remove."""
    if not K <= length <= LONGEST:
        raise ValueError(f"length must be from {K} to {LONGEST}")
    blocks.prepare(docs.sparkSession)
    n = blocks.buckets(docs.select(id_col, text_col))
    base = blocks.dealt(docs, n, id_col, text_col, rest)
    return base, _find(base, n, hot_anchors(docs, id_col, text_col, length, n), length)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    base, marks = _start(docs, id_col, text_col, [], length)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, buf, at, gone, _ = _removed(left, blocks.by_kind(right).get(MARKS, []))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = at[:-1][at[:-1] < len(buf)]
        begin[inner] = gone[inner]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        digest = [hashlib.sha256(x).hexdigest() for x in _kept(buf, at, gone)]
        return pa.table({"id": pa.array(ids, mask=ids == blocks.NULL_ID), "n_bytes": np.diff(at), "n_removed": total(gone).astype(np.int64), "n_spans": total(begin).astype(np.int64), "kept_sha256": pa.array(digest, pa.string())}).rename_columns([id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return base.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(blocks.tidy_two(finish), f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """docs, all columns, with the repeated bytes cut from the text."""
    rest = [c for c in docs.columns if c != text_col]
    base, marks = _start(docs, id_col, text_col, rest, length)
    schema, names = docs.schema, docs.columns
    empty = to_arrow_schema(schema).empty_table()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        _, buf, at, gone, other = _removed(left, blocks.by_kind(right).get(MARKS, []))
        text = pa.array((x.decode("utf-8", "ignore") for x in _kept(buf, at, gone)), pa.string())
        del buf, gone
        return pa.table([text if c == text_col else other.column(rest.index(c)) for c in names], names=names) if len(at) > 1 else empty

    return base.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(blocks.tidy_two(finish), schema)
