"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text, with a space before it and spaces written U+2581, is cut into pieces of the vocabulary so that the sum
of piece scores is greatest; of equal sums the longest last piece wins, as in a plain left-to-right Viterbi
pass. A character in no piece is written as byte pieces. Scores are whole numbers here, so sums are exact.

Where no piece can cross a position (before U+2581 that follows another character, and around characters in no
piece), the boundary has one state. Elsewhere it has MAX_PIECE: how far a piece reaches past it. A giant text (over GIANT characters)
is split into chunks at any character. Each chunk yields a matrix of the best score from each entry state to
each exit state; matrices are combined associatively by a doubling scan in max-plus algebra, which gives the
scores with which each chunk is entered. With these each chunk notes its back pointers alone and maps exit
states to entry states; the maps, composed from the end, say where each chunk's own backtrace starts.
Inside a chunk, as in short texts, stretches between one-state boundaries (mostly words) are solved once each, many at
once in numpy, and kept; a chunk's matrix is then the scores up to its first such boundary, the sum of its stretches
and the scores from its last one. A chunk without such a boundary has its matrix from a pass over its characters.

Cases. Null and empty texts have no ids. A very long text is one task's, chunk after chunk, as its ids are one row. Ids are those of the model file; unknown, begin and end ids are not
produced. decode() gives the text back exactly unless it holds U+2581 itself, which decodes as a space.
Repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, words

MAX_PIECE, CHUNK, GIANT, SHORT, KEPT = 16, 4096, 16384, 48, 500_000
SPACE = 0x2581
LEAST = np.int64(-(1 << 60))
_RUN = (2 << 20) - (1 << 16)  # with the spaces put in, below a power of two


class Table:
    """An open-addressing table from 64-bit hashes to numbers, probed for many at once."""

    def __init__(self, bits: int):
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.value = np.zeros(1 << bits, dtype=np.int32)
        self.mask = (1 << bits) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of hashes; -1 where there is none."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        k = self.key[at]
        out = np.where(k == h, self.value[at], -1)
        left = np.flatnonzero((k != h) & (k != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            k = self.key[at]
            hit = k == h[left]
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], at[on]
        return out

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        """Distinct new hashes with their values."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = np.flatnonzero(self.key[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            one = free[one]
            self.key[at[one]] = h[left[one]]
            self.value[at[one]] = value[left[one]]
            on = np.ones(len(left), dtype=bool)
            on[one] = False
            left, at = left[on], (at[on] + 1) & self.mask


class Model:
    """The pieces of a SentencePiece model file, and the stretches solved so far."""

    _one: dict[str, Model] = {}

    def __init__(self, path: str, giant: int = GIANT, chunk: int = CHUNK):
        self.giant, self.chunk = giant, chunk
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = ["" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, dtype=np.int64)
        raw = []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[b] = i
                raw.append(bytes([b]))
            else:
                raw.append(self.text[i].replace(chr(SPACE), " ").encode())
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.score = np.zeros(n, dtype=np.int64)
        self.score[normal] = [round(sp.get_score(i)) for i in normal]
        if max(len(self.text[i]) for i in normal) > MAX_PIECE:
            raise ValueError("a piece is longer than MAX_PIECE")
        chars = np.frombuffer("".join(self.text[i] for i in normal).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(self.text[i]) for i in normal])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.pieces = Table(18)
        self.pieces.add(words.span_hash(words.prefix_hash(chars), starts, ends.astype(np.int64)), np.array(normal, dtype=np.int32))
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[chars[starts[ends - starts == 1]]] = True
        inner = chars[np.setdiff1d(np.arange(len(chars)), starts)]
        before = chars[np.setdiff1d(np.arange(len(chars)), starts) - 1]
        if ((inner == SPACE) & (before != SPACE)).any() or not self.known[chars].all():
            raise ValueError("pieces cross spaces or lack single characters")
        self.clear()

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def clear(self) -> None:
        self.slots = Table(21)
        self.n, self.ids, self.at, self.sums = 0, np.zeros(1 << 20, dtype=np.int32), np.zeros(KEPT * 2, dtype=np.int64), np.zeros(KEPT * 2, dtype=np.int64)

    def keep(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Solved stretches, by hash."""
        k, base = self.n, self.at[self.n]
        if k + len(h) + 1 > len(self.at):
            self.at, self.sums = (np.concatenate([x, np.zeros(len(h) + len(x), np.int64)]) for x in (self.at, self.sums))
        if base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
        self.ids[base : base + len(ids)] = ids
        self.at[k + 1 : k + len(h) + 1] = base + np.cumsum(counts)
        self.sums[k : k + len(h)] = sums
        self.slots.add(h, np.arange(k, k + len(h), dtype=np.int32))
        self.n += len(h)

    def solve(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, sums) of equally long stretches, the rows of chars: Viterbi for all of them at once."""
        n, m = chars.shape
        sums = words.prefix_hash(np.ascontiguousarray(chars).reshape(-1))
        row = np.arange(n, dtype=np.int64) * m
        best = np.full((m + 1, n), LEAST)
        best[0] = 0
        back = np.zeros((m + 1, n), dtype=np.int8)
        piece = np.zeros((m + 1, n), dtype=np.int32)
        for p in range(1, m + 1):
            for length in range(min(MAX_PIECE, p), 0, -1):
                i = self.pieces.find(words.span_hash(sums, row + p - length, row + p))
                s = np.where(i >= 0, best[p - length] + self.score[i], LEAST)
                better = s > best[p]
                best[p][better], back[p][better], piece[p][better] = s[better], length, i[better]
        at, out = np.full(n, m), []
        live = np.arange(n)
        while len(live):
            out.append((live, piece[at[live], live]))
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        counts = np.bincount(np.concatenate([x for x, _ in out]), minlength=n)
        ends = np.cumsum(counts)
        ids = np.empty(ends[-1], dtype=np.int32)
        for k, (x, i) in enumerate(out):
            ids[ends[x] - 1 - k] = i
        return ids, counts, best[m]

    def arcs(self, chars: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each position the pieces that start there: (length, id, score), the longest last."""
        n = len(chars)
        sums = words.prefix_hash(chars)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for length in range(1, MAX_PIECE + 1):
            a = np.arange(max(0, n - length + 1))
            i = self.pieces.find(words.span_hash(sums, a, a + length)) if len(a) else a
            for p in np.flatnonzero(i >= 0).tolist():
                out[p].append((length, int(i[p]), int(self.score[i[p]])))
        return out

    def stretches(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of stretches in chars, texts beginning at `first`, and whether chars are known."""
        known, space = self.known[chars], chars == SPACE
        begin = ~known
        begin[1:] |= ~known[:-1] | (space[1:] & ~space[:-1])
        begin[first] = True
        return np.flatnonzero(begin), known

    def slots_of(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Where the stretches' ids are kept; those not met before are solved. -1: the store was emptied, ask again."""
        h = words.span_hash(words.prefix_hash(chars), start, end)
        h[h == 0] = 1
        which = self.slots.find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            distinct, rep = np.unique(h[new], return_index=True)
            if self.n and self.n + len(distinct) > KEPT:
                self.clear()
                return self.slots_of(chars, start, end, known)
            rep = new[rep]
            self.learn(chars, start[rep], end[rep], distinct, known)
            which[new] = self.slots.find(h[new])
        return which

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each text's number of ids and its sum of scores (bytes count nothing)."""
        buf, at = words.buffers(column)
        size = np.diff(at)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).copy()
        at = at if len(chars) == len(buf) else np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[at]
        chars[chars == 32] = SPACE
        full = np.flatnonzero(size > 0)
        chars = np.insert(chars, at[full], np.uint32(SPACE))  # the space before a text
        at = at + np.concatenate([[0], np.cumsum(size > 0)])
        start, known = self.stretches(chars, at[full])
        end = np.append(start[1:], len(chars))
        giants = np.flatnonzero(np.diff(at) > self.giant)
        whole = np.ones(len(start), dtype=bool)  # stretches that no chunk boundary cuts
        for g in giants.tolist():
            marks = at[g] + np.array(self.marks(int(at[g + 1] - at[g])), dtype=np.int64)
            over = np.searchsorted(start, marks, side="right") - 1
            whole[over[start[over] < marks]] = False
        which = np.full(len(start), -1)
        which[whole] = self.slots_of(chars, start[whole], end[whole], known)
        n, place, sums = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        n[whole], place[whole], sums[whole] = self.at[which[whole] + 1] - self.at[which[whole]], self.at[which[whole]], self.sums[which[whole]]
        stop = int(self.at[self.n])  # ids of cut stretches are put behind what is kept, until more is kept
        for g in giants.tolist():
            lo, hi = np.searchsorted(start, at[g : g + 2])
            chunks = self.chunks_of(chars[at[g] : at[g + 1]], np.append(start[lo:hi], at[g + 1]) - at[g], sums[lo:hi].copy())
            for k, ids, s in traced(chunks):
                if stop + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
                if not n[lo + k]:
                    place[lo + k] = stop
                self.ids[stop : stop + len(ids)] = ids
                stop, n[lo + k], sums[lo + k] = stop + len(ids), n[lo + k] + len(ids), sums[lo + k] + s
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(place - total[:-1], n) + np.arange(total[-1])]
        of = np.searchsorted(start, at)
        sums = np.concatenate([[0], np.cumsum(sums)])
        if self.at[self.n] > 8 * KEPT:  # long stretches hardly come again
            self.clear()
        return ids, np.diff(total[of]), np.diff(sums[of])

    def chunks_of(self, chars: np.ndarray, sure: np.ndarray, sums: np.ndarray) -> list[Chunk]:
        """The chunks of a giant text. sure: one-state boundaries, the starts of stretches and the end; sums: the stretches' own, 0 for those that are cut."""
        n = len(chars)
        bounds = [0, *self.marks(n), n]
        total = np.concatenate([[0], np.cumsum(sums)])
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = int(np.searchsorted(sure, lo)), int(np.searchsorted(sure, hi, side="right")) - 1
            if a <= b:
                inner = int(total[b] - total[a])
                out.append(Chunk(lo, hi, n, int(sure[a]), int(sure[b]), inner, self.arcs_of(chars, lo, int(sure[a])), self.arcs_of(chars, int(sure[b]), hi), a - 1, b))
            else:
                out.append(Chunk(lo, hi, n, None, None, 0, self.arcs_of(chars, lo, hi), {}, max(b, 0)))
        return out

    def marks(self, n: int) -> list[int]:
        """Where a text of n characters is cut into chunks; a piece crosses one boundary at most."""
        return [p for p in range(self.chunk, n, self.chunk) if n - p >= MAX_PIECE]

    def arcs_of(self, chars: np.ndarray, lo: int, hi: int) -> dict[int, list[tuple[int, int, int]]]:
        """Arcs that start at lo to hi; they may end beyond."""
        if lo >= hi:
            return {}
        return {lo + p: x for p, x in enumerate(self.arcs(chars[lo : hi + MAX_PIECE])[: hi - lo])}

    def learn(self, chars, start, end, h, known) -> None:
        size = end - start
        odd = ~known[start]
        for k in np.flatnonzero(odd).tolist():
            ids = self.byte[np.frombuffer(chr(chars[start[k]]).encode(), dtype=np.uint8)]
            self.keep(h[k : k + 1], ids.astype(np.int32), np.array([len(ids)]), np.zeros(1, np.int64))
        short = ~odd & (size <= SHORT)
        for m in np.unique(size[short]).tolist():
            k = np.flatnonzero(short & (size == m))
            ids, counts, sums = self.solve(chars[start[k][:, None] + np.arange(m)])
            self.keep(h[k], ids, counts, sums)
        for k in np.flatnonzero(~odd & ~short).tolist():  # a long stretch without boundary: chunks too
            part = chars[start[k] : end[k]]
            found = list(traced(self.chunks_of(part, np.zeros(0, np.int64), np.zeros(0, np.int64))))
            self.keep(h[k : k + 1], np.concatenate([x for _, x, _ in found]), np.array([sum(len(x) for _, x, _ in found)]), np.array([sum(s for _, _, s in found)]))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and their offsets: piece bytes gathered at once, without each text's first space."""
        n = self.raw_at[ids + 1] - self.raw_at[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.raw[np.repeat(self.raw_at[ids] - total[:-1], n) + np.arange(total[-1])]
        at = total[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        full = counts > 0
        keep = np.ones(len(out), dtype=bool)
        keep[at[:-1][full]] = False
        return out[keep], at - np.concatenate([[0], np.cumsum(full)])


class Chunk:
    """A chunk lo:hi of a text of n characters: from entry states (characters past lo) to exit states (characters past hi).

    head: arcs up to its first one-state boundary `first`, tail: those from its last, `last`; inner: the sum of the
    whole stretches between. Without such a boundary, head holds the arcs of the whole chunk. cut: numbers of the
    stretches that its head and its tail are parts of.
    """

    def __init__(self, lo, hi, n, first, last, inner, head, tail, *cut):
        self.lo, self.hi, self.n, self.first, self.last, self.inner, self.head, self.tail, self.cut = lo, hi, n, first, last, inner, head, tail, cut

    def matrix(self) -> np.ndarray:
        """Best scores from each entry state (rows) to each exit state (columns)."""
        lo, hi = self.lo, self.hi
        if self.first is None:
            best = np.full((hi - lo + MAX_PIECE, MAX_PIECE), LEAST)
            for i in range(min(MAX_PIECE, hi - lo + 1)):
                best[i, i] = 0
            for p in range(lo, hi):
                b = best[p - lo]
                for length, _, s in self.head[p]:
                    np.maximum(best[p - lo + length], np.where(b > LEAST, b + s, LEAST), out=best[p - lo + length])
            out = best[hi - lo : hi - lo + MAX_PIECE].T.copy()
        else:
            reach = {self.first: 0}  # best score from a position to the first boundary
            for p in range(self.first - 1, lo - 1, -1):
                some = [s + reach[p + length] for length, _, s in self.head[p] if p + length in reach]
                if some:
                    reach[p] = max(some)
            enter = np.array([reach.get(lo + i, LEAST) for i in range(MAX_PIECE)], dtype=np.int64)
            best, _, _ = self.forward({self.last: 0}, self.tail, self.last)
            leave = np.array([best.get(hi + j, LEAST) for j in range(MAX_PIECE)], dtype=np.int64)
            out = enter[:, None] + self.inner + leave[None, :]
            out[(enter == LEAST)[:, None] | (leave == LEAST)[None, :]] = LEAST
        out[:, self.n - hi + 1 :] = LEAST
        return out

    def forward(self, best: dict[int, int], arcs: dict, lo: int):
        """Best scores, back pointers (length, id, score) and entry states of positions, from those of best."""
        back: dict[int, tuple[int, int, int]] = {}
        entry = {p: p - self.lo for p in best}
        for p in range(lo, lo + len(arcs)):
            if p in best:
                for length, i, s in arcs[p]:
                    if best.get(p + length, LEAST) < best[p] + s:
                        best[p + length], back[p + length], entry[p + length] = best[p] + s, (length, i, s), entry[p]
        return best, back, entry

    def note(self, enter: np.ndarray) -> dict[int, int]:
        """From entry scores: for each exit state the entry state of its best path; back pointers are kept."""
        best = {self.lo + i: int(enter[i]) for i in range(MAX_PIECE) if enter[i] > LEAST}
        best, self.back, entry = self.forward(best, self.head, self.lo)
        self.back_tail = self.back
        if self.first is not None:
            came = entry.get(self.first)
            best, self.back_tail, entry = self.forward({self.last: 0}, self.tail, self.last)
            if came is None:
                return {}
            entry = dict.fromkeys(entry, came)
        return {j: entry[self.hi + j] for j in range(MAX_PIECE) if self.hi + j in entry}

    def trace(self, entry: int, leave: int):
        """(stretch, ids, sum) of the chunk's cut stretches."""
        parts = [(self.back, self.lo + entry, self.hi + leave, self.cut[0])]
        if self.first is not None:
            parts = [(self.back, self.lo + entry, self.first, self.cut[0]), (self.back_tail, self.last, self.hi + leave, self.cut[1])]
        for back, p, q, k in parts:
            ids, total = [], 0
            while q > p:
                length, i, s = back[q]
                ids.append(i)
                total += s
                q -= length
            if ids:
                yield k, np.array(ids[::-1], dtype=np.int32), total


def entered(matrices: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """The scores with which each chunk is entered, by the scan of the chunks' matrices before it."""
    out = np.repeat(enter[None], len(matrices), axis=0)
    if len(matrices) > 1:
        out[1:] = times(enter[None, None, :], scan(matrices[:-1]))[:, 0]
    return out


def composed(maps: list[dict[int, int]], leave: int = 0) -> list[tuple[int, int]]:
    """(entry, exit) state of each chunk on the best path, from the last one's exit state back."""
    out = []
    for entry_of in reversed(maps):
        out.append((entry_of[leave], leave))
        leave = entry_of[leave]
    return out[::-1]


START = np.concatenate([[0], np.full(MAX_PIECE - 1, LEAST)])


def traced(chunks: list[Chunk]):
    """(stretch, ids, sum) of all cut stretches of a text, chunk by chunk."""
    matrices = np.stack([c.matrix() for c in chunks]) if len(chunks) > 1 else np.zeros((1, MAX_PIECE, MAX_PIECE), np.int64)
    maps = [c.note(e) for c, e in zip(chunks, entered(matrices, START), strict=True)]
    for c, (entry, leave) in zip(chunks, composed(maps), strict=True):
        yield from c.trace(entry, leave)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products in max-plus algebra, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = times(out[:-step], out[step:])
        step *= 2
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of pairs of matrices."""
    out = np.full(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]) + (a.shape[-2], b.shape[-1]), 2 * LEAST)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return np.where(out < LEAST // 2, LEAST, out)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, score, round_trip): ids of every text, their sum of scores, and whether decoding them gives the text."""
    blocks.prepare(docs.sparkSession)
    picked = docs.select(id_col, text_col)

    def run(batches):
        m = Model.of(model)
        for batch in batches:
            _, offsets = words.buffers(batch.column(1))
            for lo, hi in words.runs(offsets, _RUN):
                part = batch.slice(lo, hi - lo)
                ids, n, score = m.encode(part.column(1))
                buf, at = words.buffers(part.column(1))
                back, back_at = m.decode(ids, n)
                same = np.diff(at) == np.diff(back_at)
                if len(back) == len(buf):
                    wrong = np.concatenate([[0], np.cumsum(back != buf)])
                    same &= np.diff(wrong[at]) == 0
                else:
                    raw, got = buf.tobytes(), back.tobytes()
                    same &= [raw[a:b] == got[c:d] for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), back_at[:-1].tolist(), back_at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(score), pa.array(same)], names=[id_col, "ids", "score", "round_trip"])

    schema = f"{docs.select(id_col).schema.simpleString()[7:-1]}, ids array<int>, score long, round_trip boolean"
    return picked.mapInArrow(blocks.tidy_batches(run), schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the texts of ids; bytes that are no character are replaced."""
    blocks.prepare(encoded.sparkSession)

    def run(batches):
        m = Model.of(model)
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            out, bounds = m.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias(ids_col)).mapInArrow(run, f"{encoded.select(id_col).schema.simpleString()[7:-1]}, text string")


def report(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens, the crc32 of the ids as little-endian uint32, score and round_trip."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], names=[id_col, "n_tokens", "ids_crc32", "score", "round_trip"])

    return encoded.mapInArrow(run, f"{encoded.select(id_col).schema.simpleString()[7:-1]}, n_tokens long, ids_crc32 long, score long, round_trip boolean")
