"""Near-duplicates by DartMinHash: weighted signatures, banded joining, exact confirmation, classes.

A document is a multiset of shingles of `shingle` words; an element's weight is its count, so its region is
as many unit cells. On each cell darts arrive as a Poisson process, drawn by hashing cell and dart number:
the same for every document that has the cell. A dart falls on one coordinate of the signature, and the
earliest dart of each coordinate stays. Two documents agree in a coordinate with a probability that is
exactly their weighted Jaccard similarity. Darts are thrown only up to the time by which all coordinates are
likely hit, about t (ln t + 3) darts whatever the length; documents with a gap go on for twice the time.

Bands of the signature meet in buckets. A band value held by several documents (a group) doesn't pair all of
them: its leaders are the documents that share most bands with others, and some by a fixed random order, and
each member meets each leader. So a hub of thousands of copies leads, and most groups are one class after that.
Groups of more than 2 x LEADERS members that aren't (open groups) are compared wholly: groups that share documents
form a clump, whose documents are dealt to blocks of about CLUMP_BYTES, and each two blocks meet in a task that finds
the overlap of all pairs not yet in one class. Each pair is confirmed by the exact weighted Jaccard similarity of
whole texts. Classes are the components of the confirmed links, found by alternating large-star and small-star
steps. Copies within a block of documents are linked before that. So every pair that shares a band is compared, or
is in one class without that. An open clump's work grows with the square of its size, its shuffle with size times blocks.

Chance of missing a pair at similarity 0.8 in all 40 bands of 6: 6e-6; at 0.85: 3e-9.

Pairs meet at the member's documents, to which the leader's text is sent once for each bucket: so a hub's pairs are
spread over its members.

Cases. Ids must be whole numbers (TypeError). A very long text is one task's as a whole. Fewer words than a shingle: all of them are one shingle. No word, null text: never linked. A null id is
never linked and its class is null. Rows with one id are one document, whose text is the first in byte order;
keep_one() keeps one of them. A class is named by its smallest id. Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks, words

BANDS, ROWS, LEADERS = 40, 6, 8
CLUMP_BYTES, TILE, DENSE, EXPAND = 16 << 20, 1024, 7000, 4 << 20
BAND, SIZE, SCORED, PAIR, LEADER, COPY, WANTED = range(1, 8)
_RUN = (4 << 20) - 4096


def elements(buf: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit cells (hash of shingle and occurrence) by text, sorted within each; the texts' first cells (len + 1); hash of each word sequence."""
    part = words.lower(buf)
    starts, ends, first = words.spans(part, at, words.ALNUM)
    n = np.diff(first)
    w = words.span_hash(words.prefix_hash(part), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    sums = words.prefix_hash(w)
    whole = words.span_hash(sums, first[:-1], first[1:])
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    cut = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    text = np.repeat(np.arange(len(n)), count)
    a = first[text] + np.arange(cut[-1]) - cut[text]
    h = words.span_hash(sums, a, np.minimum(a + shingle, first[text + 1]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    occurrence = np.arange(len(h)) - heads[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    again = occurrence > 0
    if again.any():
        h = np.where(again, words.mix(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
        h = h[np.lexsort((h, text))]
    return h, cut, whole


def darts(cells: np.ndarray, cut: np.ndarray, t: int) -> np.ndarray:
    """Signatures: for each text (with a cell) and coordinate the mark of its earliest dart."""
    n = np.diff(cut)
    best = np.full(len(n) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    until = t * (np.log(t) + 3) / np.maximum(n, 1)
    todo = np.flatnonzero(n > 0)
    while len(todo):
        size = n[todo]
        text = np.repeat(todo, size)
        e = cells[np.repeat(cut[todo] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        time, k = np.zeros(len(e)), 0
        while len(e):
            u = words.mix(e + np.uint64((k * 0xD1B54A32D192ED03) & (2**64 - 1)))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = time < until[text]
            e, text, time, u = e[hit], text[hit], time[hit], u[hit]
            f = words.mix(u ^ np.uint64(0x8CB92BA72F3D8DD7))
            coordinate = (f & np.uint64(0xFFFFFFFF)) % np.uint64(t)
            np.minimum.at(best, text * t + coordinate.astype(np.int64), time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | f >> np.uint64(32))
            k += 1
        gap = (best.reshape(-1, t)[todo] == np.iinfo(np.uint64).max).any(axis=1)
        todo = todo[gap]
        until[todo] *= 2
    return (best & np.uint64(0xFFFFFFFF)).reshape(-1, t)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each text and band."""
    s = signatures.reshape(-1, bands, rows)
    return words.chain(np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2]), *[s[:, :, r] for r in range(rows)])


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of equal values in h, which is sorted."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


def one_way(pair: np.ndarray, doc: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Distinct (leader, member) pairs; of those that stand both ways only the one whose leader has the higher score, or else the smaller id."""
    if not len(pair):
        return pair
    ids, at = np.unique(doc, return_index=True)
    s = score[at]
    swap = pair[:, 0] > pair[:, 1]
    key = np.where(swap[:, None], pair[:, ::-1], pair)
    order = np.lexsort((key[:, 1], key[:, 0]))
    pair, key = pair[order], key[order]
    same = np.flatnonzero((key[1:] == key[:-1]).all(axis=1))
    first, second = pair[same], pair[same + 1]
    better = s[np.searchsorted(ids, first[:, 0])] - s[np.searchsorted(ids, second[:, 0])]
    drop = np.where((better > 0) | ((better == 0) & (first[:, 0] < second[:, 0])), same + 1, same)
    return np.delete(pair, drop, axis=0)


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, least node) that link what u and v link."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up) if root(x) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): the least node that it is linked to."""
    e = blocks.checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = blocks.checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def _select(ids, buf, at, wanted: np.ndarray):
    """Texts of the ids `wanted`, as a buffer with offsets."""
    row = np.searchsorted(ids, wanted)
    size = np.diff(at)[row]
    new = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return np.concatenate([buf[at[r] : at[r + 1]] for r in row.tolist()]) if len(row) else np.zeros(0, np.uint8), new


def _cells_of(part: np.ndarray, cut: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the texts in a buffer, and each text's first (len + 1)."""
    out, first, base = [], [np.zeros(1, np.int64)], 0
    for lo, hi in words.runs(cut, _RUN):
        h, c, _ = elements(part[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo], shingle)
        out.append(h)
        first.append(c[1:] + base)
        base += c[-1]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(first)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, count of each, one run after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _postings(cells: np.ndarray, cut: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of some texts, the first place and number of their postings, and the postings: places in rows."""
    size = np.diff(cut)[rows]
    e = cells[_ranges(cut[rows], size)]
    order = np.argsort(e, kind="stable")
    e = e[order]
    first, count = _groups(e)
    return e[first], first, count, np.repeat(np.arange(len(rows)), size)[order]


def _overlaps(left: tuple, right: tuple, m: int, n: int) -> np.ndarray:
    """Numbers of cells that m texts and n others share, each with each: frequent cells by a matrix product, others from postings."""
    _, a, b = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    fa, ca, fb, cb = left[1][a], left[2][a], right[1][b], right[2][b]
    dense = ca * cb > DENSE
    out = np.zeros((m, n), dtype=np.float32)
    if dense.any():
        x, y = (np.zeros((k, dense.sum()), dtype=np.float32) for k in (m, n))
        for z, post, f, c in ((x, left[3], fa[dense], ca[dense]), (y, right[3], fb[dense], cb[dense])):
            z[post[_ranges(f, c)], np.repeat(np.arange(len(f)), c)] = 1
        out += x @ y.T
    fa, ca, fb, cb = fa[~dense], ca[~dense], fb[~dense], cb[~dense]
    work = np.cumsum(ca * cb)
    lo = 0
    while lo < len(fa):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + EXPAND, side="right")))
        k = np.repeat(np.arange(lo, hi), ca[lo:hi])
        i = np.repeat(left[3][_ranges(fa[lo:hi], ca[lo:hi])], cb[k])
        out += np.bincount(i * n + right[3][_ranges(fb[k], cb[k])], minlength=m * n).reshape(m, n)
        lo = hi
    return out


def linked(cells: np.ndarray, cut: np.ndarray, label: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of texts, by place, of similarity `threshold` that join all classes which such pairs join; texts of one label are one class already.

    All pairs of a text of side 0 and one of side 1 are looked at, or all pairs if no text is of side 1.
    """
    size = np.diff(cut)
    _, of = np.unique(label, return_inverse=True)
    up = np.arange(of.max() + 1) if len(of) else np.zeros(0, np.int64)
    tiles = []
    for s in (0, 1):
        rows = np.flatnonzero(side == s)
        rows = rows[np.argsort(size[rows], kind="stable")]
        tiles.append([rows[k : k + TILE] for k in range(0, len(rows), TILE)])
    one = not tiles[1]
    posts = [[_postings(cells, cut, r) for r in t] for t in tiles]
    out = []
    for x, left in enumerate(tiles[0]):
        for y, right in enumerate(tiles[0] if one else tiles[1]):
            if one and y < x or min(size[left[-1]], size[right[-1]]) < threshold * max(size[left[0]], size[right[0]]) - 1e-9:
                continue
            differ = of[left][:, None] != of[right]
            if not differ.any():
                continue
            both = _overlaps(posts[0][x], posts[0 if one else 1][y], len(left), len(right))
            ok = differ & (both >= threshold * (size[left][:, None] + size[right] - both) - 1e-9)
            while (some := np.flatnonzero(ok.any(axis=1))).size:
                for i, j in zip(left[some].tolist(), right[ok[some].argmax(axis=1)].tolist(), strict=True):
                    a, b = of[i], of[j]
                    while up[a] != a:
                        a = up[a]
                    while up[b] != b:
                        b = up[b]
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((i, j))
                while (up[up] != up).any():
                    up = up[up]
                of = up[of]
                ok &= of[left][:, None] != of[right]
    return out


def met(h: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (leader, member) of each group h that are compared: all of groups of up to 2 x LEADERS, else those with the best by score and by a fixed order."""
    a, b = [], []
    for most, keys in ((2 * LEADERS, (doc, -score)), (LEADERS, (doc, words.mix(doc.astype(np.uint64))))):
        order = np.lexsort((*keys, h))
        d = doc[order]
        first, size = _groups(h[order])
        for k in range(most):
            some = (size > k) & ((k < LEADERS) | (size <= 2 * LEADERS))
            leader = np.repeat(d[first[some] + k], size[some])
            member = d[np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())]
            a.append(leader)
            b.append(member)
    return np.concatenate(a), np.concatenate(b)


def _clump_links(docs: DataFrame, id_col: str, text_col: str, sized: DataFrame, of: DataFrame, n: int, shingle: int, threshold: float) -> DataFrame | None:
    """(u, v): links between the classes `of` of documents that share a large group, from all pairs in it; None if each such group is one class."""

    def large(batches):
        for batch in batches:
            for x in blocks.by_kind(pa.Table.from_batches([batch])).get(SIZE, []):
                keep = x["size"] > 2 * LEADERS
                yield pa.RecordBatch.from_arrays([pa.array(x["h"][keep].view(np.int64)), pa.array(x["doc"][keep])], names=["h", "doc"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, label, block, lo = (table.column(c).to_numpy() for c in ("doc", "label", "block", "lo"))
        cells, cut = _cells_of(*words.buffers(table.column("text").combine_chunks()), shingle)
        pair = np.array(linked(cells, cut, label, (block != lo).astype(np.int64), threshold), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": ids[pair[:, 0]], "v": ids[pair[:, 1]]})

    big = sized.mapInArrow(blocks.tidy_batches(large), "h long, doc long")
    big = big.join(of.select(F.col("node").alias("doc"), "label"), "doc", "left").select("h", "doc", F.coalesce("label", "doc").alias("label"))
    opened = big.groupBy("h").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("doc").alias("first")).where("least < most").select("h", "first")
    member = blocks.checkpointed(big.join(opened, "h").select("doc", "label", "first").distinct())
    if member.isEmpty():
        return None
    clump = components(member.select(F.col("doc").alias("u"), F.col("first").alias("v"))).select(F.col("node").alias("doc"), F.col("label").alias("clump"))
    placed = blocks.checkpointed(member.select("doc", "label").distinct().join(clump, "doc", "left").select("doc", "label", F.coalesce("clump", "doc").alias("clump")))
    few = placed.count() <= 1 << 19
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(placed) if few else placed, "doc")
    texts = blocks.checkpointed(texts.groupBy("doc", "label", "clump").agg(F.min("text").alias("text")))
    parts = texts.groupBy("clump").agg(F.ceil(F.sum(F.octet_length("text")) / CLUMP_BYTES).alias("parts")).where("parts > 1")
    dealt = texts.join(F.broadcast(parts), "clump", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # a row of parts stands for over CLUMP_BYTES
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("clump", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "label", "text")
    return dealt.repartition(n, "clump", "lo", "hi").groupBy("clump", "lo", "hi").applyInArrow(blocks.tidy(compare), "u long, v long")


def _links(base: DataFrame, n: int, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(copy, u, v): confirmed links, and whether they are of copies within a block; and the groups' members with sizes, packed."""
    schema, route = blocks.SCHEMA, blocks.Route(n)
    mod = np.uint64(n)

    def forward(kinds, own):
        return [(own, COPY, x) for x in kinds.get(COPY, [])]

    def group(table):
        return blocks.by_kind(table), table.column("bucket")[0].as_py()

    out = route.table

    def local(table: pa.Table) -> pa.Table:
        own = table.column("bucket")[0].as_py()
        ids, _, buf, at, _ = blocks.ordered(table)
        keep = np.ones(len(ids), dtype=bool)
        keep[1:] = ids[1:] != ids[:-1]
        keep &= ids != blocks.NULL_ID
        h, doc, seen, copies = [], [], {}, []
        for lo, hi in words.runs(at, _RUN):
            cells, cut, whole = elements(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shingle)
            take = np.flatnonzero(keep[lo:hi] & (np.diff(cut) > 0))
            fresh = []
            for k, w in zip(take.tolist(), whole[take].tolist(), strict=True):
                first = seen.setdefault(w, int(ids[lo + k]))
                if first == ids[lo + k]:
                    fresh.append(k)
                else:
                    copies.append((int(ids[lo + k]), first))
            fresh = np.array(fresh, dtype=np.int64)
            size = np.diff(cut)[fresh]
            cells = cells[np.repeat(cut[fresh] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            b = band_hashes(darts(cells, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), BANDS * ROWS), BANDS, ROWS)
            h.append(b.reshape(-1))
            doc.append(np.repeat(ids[lo + fresh], BANDS))
        items = [(own, COPY, {"u": np.array([u for u, _ in copies], dtype=np.int64), "v": np.array([v for _, v in copies], dtype=np.int64)})] if copies else []
        if h:
            h, doc = np.concatenate(h), np.concatenate(doc)
            items += blocks.send(BAND, (h % mod).astype(np.int64), {"h": h, "doc": doc})
        return out(items, own)

    def sizes(table: pa.Table) -> pa.Table:
        kinds, own = group(table)
        items = forward(kinds, own)
        if x := blocks.joined(kinds.get(BAND, [])):
            order = np.argsort(x["h"], kind="stable")
            h, doc = x["h"][order], x["doc"][order]
            first, size = _groups(h)
            size = np.repeat(size, size)
            several = size > 1
            items += blocks.send(SIZE, blocks.bucket_of(doc[several], n), {"doc": doc[several], "h": h[several], "size": size[several]})
        return out(items, own)

    def scores(table: pa.Table) -> pa.Table:
        kinds, own = group(table)
        items = forward(kinds, own)
        if x := blocks.joined(kinds.get(SIZE, [])):
            _, place = np.unique(x["doc"], return_inverse=True)
            score = np.bincount(place, weights=x["size"]).astype(np.int64)[place]
            items += blocks.send(SCORED, (x["h"] % mod).astype(np.int64), {"h": x["h"], "doc": x["doc"], "score": score})
        return out(items, own)

    def pairs(table: pa.Table) -> pa.Table:
        kinds, own = group(table)
        items = forward(kinds, own)
        if x := blocks.joined(kinds.get(SCORED, [])):
            a, b = met(x["h"], x["doc"], x["score"])
            pair = one_way(np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0), x["doc"], x["score"])
            to = blocks.bucket_of(pair[:, 1], n)
            items += blocks.send(PAIR, to, {"a": pair[:, 0], "b": pair[:, 1]})  # to the member's documents; the leader's are asked to go there
            wanted = np.unique(np.stack([to, pair[:, 0]], axis=1), axis=0)
            items += blocks.send(WANTED, blocks.bucket_of(wanted[:, 1], n), {"a": wanted[:, 1], "to": wanted[:, 0]})
        return out(items, own)

    def distinct(kinds):
        x = blocks.joined(kinds.get(PAIR, []))
        return np.unique(np.stack([x["a"], x["b"]], axis=1), axis=0) if x else np.zeros((0, 2), np.int64)

    def leaders(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return out([], 0)
        kinds, own = group(right)
        items = forward(kinds, own) + [(own, PAIR, x) for x in kinds.get(PAIR, [])]
        if x := blocks.joined(kinds.get(WANTED, [])):
            ids, _, buf, at, _ = blocks.ordered(left)
            sent = np.unique(np.stack([x["to"], x["a"]], axis=1), axis=0)
            for bucket, x in blocks.split(sent[:, 0], {"a": sent[:, 1]}):  # whole texts: half the size of their cells
                part, cut = _select(ids, buf, at, x["a"])
                items.append((bucket, LEADER, {"a": x["a"], "len": np.diff(cut), "text": part}))
        return out(items, own)

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v, copy = [], [], []
        kinds = blocks.by_kind(right)
        for x in kinds.get(COPY, []):
            u.append(x["u"])
            v.append(x["v"])
            copy.append(np.ones(len(x["u"]), dtype=bool))
        pair = distinct(kinds)
        if len(pair):
            ids, _, buf, at, _ = blocks.ordered(left)
            wanted, place = np.unique(pair[:, 1], return_inverse=True)
            cells, cut = _cells_of(*_select(ids, buf, at, wanted), shingle)
            size = np.diff(cut)
            led = blocks.joined(kinds[LEADER])
            theirs, led_cut = _cells_of(led["text"], np.concatenate([[0], np.cumsum(led["len"])]).astype(np.int64), shingle)
            of = {a: theirs[lo:hi] for a, lo, hi in zip(led["a"].tolist(), led_cut[:-1].tolist(), led_cut[1:].tolist(), strict=True)}
            first, number = _groups(pair[:, 0])
            links = []
            for f, k in zip(first.tolist(), number.tolist(), strict=True):
                mine = of[int(pair[f, 0])]
                m = place[f : f + k]
                possible = np.minimum(size[m], len(mine)) >= threshold * np.maximum(size[m], len(mine)) - 1e-9
                m, rows = m[possible], np.arange(f, f + k)[possible]
                if not len(m):
                    continue
                s = size[m]
                theirs = cells[np.repeat(cut[m] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
                where = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = np.bincount(np.repeat(np.arange(len(m)), s), weights=mine[where] == theirs, minlength=len(m))
                links.append(rows[both >= threshold * (s + len(mine) - both) - 1e-9])
            if links:
                e = forest(*pair[np.concatenate(links)].T)
                u.append(np.array([a for a, _ in e], dtype=np.int64))
                v.append(np.array([b for _, b in e], dtype=np.int64))
                copy.append(np.zeros(len(e), dtype=bool))
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"copy": join(copy, pa.bool_()), "u": join(u, pa.int64()), "v": join(v, pa.int64())})

    step = lambda df, f: route.spread(df).groupBy("bucket").applyInArrow(blocks.tidy(f), schema)
    sized = blocks.checkpointed(step(base.groupBy("bucket").applyInArrow(blocks.tidy(local), schema), sizes))
    paired = step(step(sized, scores), pairs)
    led = base.groupBy("bucket").cogroup(route.spread(paired).groupBy("bucket")).applyInArrow(blocks.tidy_two(leaders), schema)
    return base.groupBy("bucket").cogroup(route.spread(led).groupBy("bucket")).applyInArrow(blocks.tidy_two(confirm), "copy boolean, u long, v long"), sized


def labels(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> tuple[DataFrame, int]:
    """(node, label) of the documents whose class has a smaller id, and the number of buckets."""
    blocks.prepare(docs.sparkSession)
    n = blocks.buckets(docs.select(id_col, text_col))
    links, sized = _links(blocks.dealt(docs, n, id_col, text_col), n, shingle, threshold)
    links = blocks.checkpointed(links)
    of = components(links.where("not copy").select("u", "v"))
    more = _clump_links(docs, id_col, text_col, sized, of, n, shingle, threshold)
    if more is not None:
        of = components(of.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))
    copies = links.where("copy").select(F.col("u").alias("node"), F.col("v").alias("first"))
    joined = copies.join(of.select(F.col("node").alias("first"), "label"), "first", "left").select("node", F.coalesce("label", "first").alias("label"))
    # a class is named by its smallest id, which may be a copy's
    every = of.unionByName(joined)
    least = every.groupBy("label").agg(F.least(F.min("node"), F.first("label")).alias("least"))
    named = every.unionByName(every.select(F.col("label").alias("node"), "label").distinct()).join(least, "label").select("node", F.col("least").alias("label"))
    return named.where("node <> label"), n


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_col, class_id, duplicate) for every row: the smallest id of its class, and whether that is another document."""
    named, _ = labels(docs, id_col, text_col, shingle, threshold)
    ids = docs.select(F.col(id_col).cast("long").alias(id_col))
    return ids.join(named.distinct(), ids[id_col] == named["node"], "left").select(id_col, F.coalesce("label", id_col).alias("class_id"), F.col("label").isNotNull().alias("duplicate"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs, all columns: of each class the row with the smallest id; of rows with one id the first in byte order; null ids all."""
    named, n = labels(docs, id_col, text_col, shingle, threshold)
    schema, names = docs.schema, docs.columns
    others = [c for c in names if c != text_col]
    empty = to_arrow_schema(schema).empty_table()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tie, buf, at, other = blocks.ordered(left)
        keep = (tie == 0) | (ids == blocks.NULL_ID)
        if right.num_rows:
            keep &= ~np.isin(ids, right.column("node").to_numpy())
        if not keep.any():
            return empty
        text = pa.array((buf[at[r] : at[r + 1]].tobytes().decode() for r in np.flatnonzero(keep).tolist()), pa.string())
        other = other.filter(pa.array(keep))
        return pa.table([text if c == text_col else other.column(others.index(c)) for c in names], names=names)

    base = blocks.dealt(docs, n, id_col, text_col, others)
    gone = named.select("node").distinct().select(F.pmod(F.xxhash64("node"), F.lit(n)).alias("bucket"), "node").repartition(n, "bucket")
    return base.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(blocks.tidy_two(finish), schema)
