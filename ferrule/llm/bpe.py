"""Byte-level BPE of whole texts: merges by contiguous rank arrays, ids and the text back.

A text is cut at added tokens, the stretches between them into words by the tokenizer's pattern. A word is an array of
part boundaries with the part that begins at each, and of the rank of each two neighbours' merge. The array is scanned for the
least rank (the first of equal ones), the boundary between those two parts is deleted, and the ranks beside the new part are
looked up again, until no two neighbours merge. Words of one length have arrays of one shape, so numpy does a step of thousands of
them at once. That is quadratic in a word's length; words over SHORT bytes go through a heap of merges over linked parts,
which gives the same parts. Each distinct word is solved once for each worker and kept.

Decoding puts the bytes of ids together and reads them as UTF-8; what is none becomes U+FFFD, as the library has it.

How it is spread: one pass over the documents, no shuffle; a text is one task's, in batches of about a megabyte.

Cases. A null or empty text has no ids, and decodes to an empty text. Very long texts and words are whole. Equal ids and repeated
rows each give a row. The id may be of any type, null too. Empty tables give no row. Other columns are not read, so their names don't
matter. A text that holds an added token's literal gets that token's id. Ids that the file doesn't have can't be decoded (IndexError).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, words
from .token_output import Encoder

SHORT, NEVER = 64, np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class Merges:
    """The merge table of a tokenizer file: rank and result of each pair of parts, in an open-addressing table for numpy."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.byte = np.array([vocabulary[c] for c in byte_characters()], dtype=np.int32)
        self.pair = {}
        for rank, (a, b) in enumerate(merges):
            self.pair.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        bits = max(4, (4 * len(self.pair)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, NEVER, dtype=np.int32)
        self.result = np.zeros(1 << bits, dtype=np.int32)
        for (a, b), (rank, result) in self.pair.items():
            at = int(self._slot(np.array([a << 32 | b]))[0])
            while self.key[at] >= 0:
                at = at + 1 & int(self.mask)
            self.key[at], self.rank[at], self.result[at] = a << 32 | b, rank, result

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (words.mix(key.astype(np.uint64)) & self.mask).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; a slot whose rank is NEVER where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        left_over = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(left_over):
            at[left_over] = at[left_over] + 1 & int(self.mask)
            k = self.key[at[left_over]]
            left_over = left_over[(k != key[left_over]) & (k >= 0)]
        return at

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self.find(left, right)]

    def solve(self, group: np.ndarray) -> list[np.ndarray]:
        """Parts of words of one length, a row of bytes each, by contiguous rank arrays."""
        out: list = [None] * len(group)
        row = np.arange(len(group))
        part = self.byte[group]
        rank = self.ranks(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(len(group), -1)
        while rank.shape[1]:
            first = rank.argmin(axis=1)
            going = rank[np.arange(len(row)), first] != NEVER
            if not going.all():
                for r, p in zip(row[~going].tolist(), part[~going], strict=True):
                    out[r] = p
                row, part, rank, first = row[going], part[going], rank[going], first[going]
                if not len(row):
                    return out
            n, width = rank.shape
            each = np.arange(n)
            new = self.result[self.find(part[each, first], part[each, first + 1])]
            part = part[_without(n, width + 1, first + 1)].reshape(n, width)  # the boundary between the two goes
            part[each, first] = new
            rank = rank[_without(n, width, first)].reshape(n, width - 1)
            before = np.flatnonzero(first > 0)
            rank[before, first[before] - 1] = self.ranks(part[before, first[before] - 1], new[before])
            after = np.flatnonzero(first < width - 1)
            rank[after, first[after]] = self.ranks(new[after], part[after, first[after] + 1])
        for r, p in zip(row.tolist(), part, strict=True):
            out[r] = p
        return out

    def solve_long(self, word: bytes) -> np.ndarray:
        """Parts of one word by a heap: (rank, place) of each merge, out of date where a part there has gone or changed."""
        part = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pair[p][0], i, *p) for i, p in enumerate(itertools.pairwise(part)) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = self.pair[a, b][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                p = (part[k], part[after[k]]) if k >= 0 and after[k] < n else None
                if p in self.pair:
                    heapq.heappush(heap, (self.pair[p][0], k, *p))
        return np.array([p for p in part if p >= 0], dtype=np.int32)


def _without(n: int, width: int, column: np.ndarray) -> np.ndarray:
    keep = np.ones((n, width), dtype=bool)
    keep[np.arange(n), column] = False
    return keep


class Coder(Encoder):
    """Ids of whole texts by Merges, and texts of ids; a byte-level BPE file is all it reads."""

    _one: dict[str, Coder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or file["normalizer"] or file["post_processor"] or before.get("add_prefix_space"))
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take white space along or stand only as words are not read")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._start(model["vocab"], merges, added)

    def _start(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> None:
        from .token_output import Splitter

        self.added, self.id_of_added = sorted(added, key=len, reverse=True), added
        self.merges, self.split = Merges(vocabulary, merges), Splitter()
        byte = {c: b for b, c in enumerate(byte_characters())}
        spelt = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in added.items()}
        self.known = np.zeros(max(spelt) + 1, dtype=bool)
        self.known[list(spelt)] = True
        every = [spelt.get(i, b"") for i in range(len(self.known))]
        self.bytes = np.frombuffer(b"".join(every), dtype=np.uint8)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(b) for b in every])]).astype(np.int64)
        self.clear()

    def _library(self, text: str, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of words that aren't kept: those of one length at once, long ones by themselves."""
        raw = [text[a:b].encode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        size, out = np.array([len(r) for r in raw]), [None] * len(raw)
        for length in np.unique(size).tolist():
            which = np.flatnonzero(size == length).tolist()
            if length > SHORT:
                found = [self.merges.solve_long(raw[k]) for k in which]
            else:
                found = self.merges.solve(np.frombuffer(b"".join(raw[k] for k in which), dtype=np.uint8).reshape(len(which), length))
            for k, ids in zip(which, found, strict=True):
                out[k] = ids.astype(np.uint32)
        return out

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text with added tokens: the stretches between them, and their own."""
        out, at = [], 0
        while True:
            found = min(((i, -len(t), t) for t in self.added if (i := text.find(t, at)) >= 0), default=None)
            stretch = text[at : found[0] if found else len(text)]
            if stretch:
                out.append(self.encode(pa.array([stretch]))[0])
            if not found:
                return np.concatenate([np.zeros(0, np.uint32), *out])
            out.append(np.array([self.id_of_added[found[2]]], np.uint32))
            at = found[0] - found[1]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts of ids that come one text after another, n[k] for the k-th."""
        if len(ids) and not self.known[ids].all():
            raise IndexError("ids that the vocabulary doesn't have")
        size = self.bytes_at[ids + np.uint32(1)] - self.bytes_at[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.repeat(self.bytes_at[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        cuts = stop[np.concatenate([[0], np.cumsum(n)])].tolist()
        return [raw[a:b].decode(errors="replace") for a, b in itertools.pairwise(cuts)]


def _coded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """make(coder, ids of documents, ids, n) for batches of documents of about a megabyte."""
    blocks.prepare(docs.sparkSession)

    def run(batches):
        coder = Coder.of(tokenizer)
        for batch in batches:
            _, at = words.buffers(batch.column(1))
            for lo, hi in words.runs(at):
                part = batch.slice(lo, hi - lo)
                yield make(coder, part.column(0), *coder.encode(part.column(1)))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(blocks.tidy_batches(run), f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each document."""

    def make(coder, doc, ids, n):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc, lists], names=["doc_id", "ids"])

    return _coded(docs, tokenizer, id_col, text_col, make, "ids array<int>")


def decode(coded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are a null text."""
    blocks.prepare(coded.sparkSession)

    def run(batches):
        coder = Coder.of(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
            if lists.null_count:
                ids = lists.flatten().to_numpy(zero_copy_only=False)
            else:
                ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            texts = pa.array(coder.decode(ids.astype(np.uint32), n), pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    picked = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(blocks.tidy_batches(run), f"doc_id {kind}, text string")


def report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids as little-endian uint32 and that of the text decoded from them."""

    def make(coder, doc, ids, n):
        raw, cuts = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
        first = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in itertools.pairwise(cuts)]
        second = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(ids, n)]
        return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coded(docs, tokenizer, id_col, text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
