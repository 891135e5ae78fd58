"""Token ids as binary shard files: frequency-ranked, byte-aligned variable-length codes, control bytes apart.

A shard holds the documents of one range of ids in ascending order. Its header lists the ids that occur
by falling frequency; a token is stored as its rank there, in 1 to 4 bytes. Two bits a token, four tokens
a control byte, say how many. A shard is a row of such sections of about a million tokens, so neither side holds a whole shard. Reading looks the control bytes up in a table of lengths and gathers all
codes at once in numpy. A shard is written under a name of its own attempt, and only the manifest, written
after all shards, makes it count; so lost or repeated tasks leave no wrong data.

Layout, little-endian: magic, then sections: uint32 header length, JSON header {parts: [[name, dtype, count], ...]}, the parts.

Ids are those of the library's own encode(text, add_special_tokens=False) of whole texts. So an added token's
literal in a text, such as <|endoftext|>, becomes that token's id; a text that holds one goes to the library whole.

Cases. A null or empty text has only the end id. Equal document ids are ordered by their text; a null id
comes first. Ids must be whole numbers (TypeError). A very long text is encoded in one task and makes sections of its own. Empty
tables write an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, words

MAGIC = b"FRTK0001"
#: Pieces that are kept, and the characters of the longest of them; longer ones go to the library each time.
CACHE_PIECES, KEPT_CHARS = 500_000, 64
SECTION, SHARD_BYTES = 1 << 20, 16 << 20
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


class Splitter:
    """The tokenizer's split of texts into pieces, for whole batches at once.

    It is the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ as rules on runs of
    letters, numbers, others and spaces: a run begins a piece; one space before it joins it; of longer white
    space all but the last character is a piece of its own; a lone apostrophe takes these endings along.
    """

    ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the pattern

    def __init__(self):
        import regex

        self.kind = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        at = lambda i: i if i < 0xD800 else i + 0x800
        for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(p, every):
                lo, hi = m.span()
                self.kind[at(lo) : at(hi - 1) + 1] = k

    def starts(self, chars: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces begin in chars (code points); texts: where texts begin, in order, without empty ones."""
        n = len(chars)
        kind = self.kind[chars]
        head = np.empty(n, dtype=bool)
        head[0] = True
        np.not_equal(kind[1:], kind[:-1], out=head[1:])
        head[texts] = True
        run = np.flatnonzero(head)
        size = np.diff(np.append(run, n))
        first = np.zeros(n + 1, dtype=bool)
        first[texts] = True
        first[n] = True
        begin = head.copy()
        space = kind[run] == 3
        after = run + size
        followed = space & ~first[after]
        last = after[followed] - 1  # the last white space before something else, in one text
        begin[last] = True
        joins = last[chars[last] == 32]
        begin[joins + 1] = False
        lone = run[(size == 1) & (chars[run] == 39) & ~first[run + 1]]
        lone = lone[begin[lone]]
        if len(lone):
            first_ = first
            for p in lone.tolist():
                two = "".join(map(chr, chars[p + 1 : p + 3].tolist())) if not first_[p + 2 if p + 2 <= n else n] else chr(chars[p + 1])
                e = next((x for x in self.ENDINGS if two.startswith(x)), None)
                if e:
                    begin[p + 1] = False
                    stop = p + 1 + len(e)
                    if stop < n and not first_[stop] and not begin[stop]:
                        begin[stop] = True
        return np.flatnonzero(begin)


class Encoder:
    """Ids of whole texts. The tokenizer never joins across pieces, so the library encodes each distinct piece once.

    Pieces are known by a 64-bit hash, in an open-addressing table that numpy probes for a batch at once; their first,
    middle and last character must agree too. Where they don't, the piece goes to the library like one that isn't kept.
    """

    _one: dict[str, Encoder] = {}
    BITS = 21

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = Splitter()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def clear(self) -> None:
        self.key = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.slot = np.zeros(1 << self.BITS, dtype=np.int32)
        self.more = np.zeros(CACHE_PIECES * 2, dtype=np.uint64)
        self.n = 0
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.at = np.zeros(CACHE_PIECES * 2, dtype=np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 where unknown."""
        out = np.full(len(h), -1, dtype=np.int32)
        mask = np.uint64((1 << self.BITS) - 1)
        at = (h & mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            k = self.key[at]
            hit = k == h[left]
            out[left[hit]] = self.slot[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def add(self, h: np.ndarray) -> None:
        """New distinct hashes get the next slots, in order."""
        at = (h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.key[at] == 0
            cand, where = left[free], at[free]
            _, one = np.unique(where, return_index=True)
            self.key[where[one]] = h[cand[one]]
            self.slot[where[one]] = self.n + cand[one]
            done = np.zeros(len(h), dtype=bool)
            done[cand[one]] = True
            on = ~done[left]
            left, at = left[on], (at[on] + 1) & ((1 << self.BITS) - 1)
        self.n += len(h)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of ids."""
        buf, offsets = words.buffers(column)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        text = buf.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = offsets if len(chars) == len(buf) else np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        odd = self._with_added(text, at)
        if len(odd):  # the library alone knows how these are cut
            spared = np.ones(len(column), dtype=bool)
            spared[odd] = False
            ids, n = self.encode(pa.array([text[a:b] if s else "" for a, b, s in zip(at[:-1].tolist(), at[1:].tolist(), spared.tolist(), strict=True)], pa.string()))
            cuts = np.concatenate([[0], np.cumsum(n)])
            whole = [self._whole(text[at[r] : at[r + 1]]) for r in odd]
            n[odd] = [len(w) for w in whole]
            parts, last = [], 0
            for r, w in zip(odd, whole, strict=True):
                parts += [ids[last : cuts[r]], w]
                last = cuts[r]
            return np.concatenate([*parts, ids[last:]]), n
        begin = self.split.starts(chars, at[:-1][np.diff(at) > 0])
        end = np.append(begin[1:], len(chars))
        h = words.span_hash(words.prefix_hash(chars), begin, end)
        more = chars[begin].astype(np.uint64) | chars[end - 1].astype(np.uint64) << np.uint64(21) | chars[begin + end >> 1].astype(np.uint64) << np.uint64(42)
        h[h == 0] = 1
        which = self.find(h)
        short = end - begin <= KEPT_CHARS
        unknown = np.flatnonzero((which < 0) & short)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            if self.n + len(new) > CACHE_PIECES and self.n:
                self.clear()
                return self.encode(column)
            first = unknown[first]
            self._keep(self._library(text, begin[first], end[first]), new, more[first])
            which[unknown] = self.find(h[unknown])
        alone = np.flatnonzero(~short | (self.more[which] != more))
        n = self.at[which + 1] - self.at[which]
        at_ = self.at[which]
        if len(alone):
            codes = self._library(text, begin[alone], end[alone])
            n[alone] = [len(c) for c in codes]
            stop = int(self.at[self.n])  # behind what is kept, until the next piece is
            flat_ = np.concatenate(codes)
            self._room(stop + len(flat_))
            self.ids[stop : stop + len(flat_)] = flat_
            at_[alone] = stop + np.cumsum(n[alone]) - n[alone]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(at_ - total[:-1], n) + np.arange(total[-1])]
        return flat, np.diff(total[np.searchsorted(begin, at)])

    def _with_added(self, text: str, at: np.ndarray) -> np.ndarray:
        """Places of the texts in which an added token's literal may stand."""
        places = []
        for token in self.added:
            i = text.find(token)
            while i >= 0:
                places.append(i)
                i = text.find(token, i + 1)
        found = np.unique(np.searchsorted(at, np.array(places, dtype=np.int64), side="right") - 1)
        return found[[any(t in text[at[r] : at[r + 1]] for t in self.added) for r in found.tolist()]] if len(found) else found

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _library(self, text: str, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        pieces = [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _room(self, n: int) -> None:
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), n), np.uint32)])

    def _keep(self, codes: list[np.ndarray], h: np.ndarray, more: np.ndarray) -> None:
        if self.n + len(h) + 1 > len(self.at):
            self.at, self.more = (np.concatenate([x, np.zeros(self.n + len(h) + 1, x.dtype)]) for x in (self.at, self.more))
        stops = self.at[self.n] + np.cumsum([len(c) for c in codes])
        self._room(int(stops[-1]))
        self.ids[self.at[self.n] : stops[-1]] = np.concatenate(codes)
        self.at[self.n + 1 : self.n + len(h) + 1] = stops
        self.more[self.n : self.n + len(h)] = more
        self.add(h)


def pack(ids: np.ndarray) -> dict[str, np.ndarray]:
    """rank: the distinct ids by falling frequency, ties by id; control and data bytes of all ids."""
    count = np.bincount(ids)
    distinct = np.flatnonzero(count)
    order = np.argsort(-count[distinct], kind="stable")
    rank = np.zeros(len(count), dtype=np.uint32)
    rank[distinct[order]] = np.arange(len(order), dtype=np.uint32)
    codes = rank[ids]
    length = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    two = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    two[: len(codes)] = length - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    data = codes.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return {"rank": distinct[order].astype("<u4"), "control": control.astype(np.uint8), "data": data}


def unpack(rank: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids again: the table of lengths by control byte says where each code's bytes lie."""
    length = _LENGTHS[control].reshape(-1)[:n]
    codes = np.zeros((n, 4), dtype=np.uint8)
    codes[np.arange(4) < length[:, None]] = data
    return rank[codes.view("<u4").reshape(-1)]


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    header = json.dumps({"parts": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}).encode()
    return b"".join([len(header).to_bytes(4, "little"), header, *(v.tobytes() for v in parts.values())])


def sections(f) -> Iterator[dict[str, np.ndarray]]:
    """The sections of an open shard."""
    if f.read(8) != MAGIC:
        raise ValueError("not a token shard")
    while size := f.read(4):
        out = {}
        for name, kind, n in json.loads(f.read(int.from_bytes(size, "little")))["parts"]:
            out[name] = np.frombuffer(f.read(n * np.dtype(kind).itemsize), dtype=kind, count=n)
        yield out


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> str:
    """Shards and manifest.json of docs in folder, a URI that driver and executors share; returns the manifest's URI."""
    spark = docs.sparkSession
    blocks.prepare(spark)
    blocks.whole_ids(docs, id_col)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    ranged = picked.repartitionByRange(blocks.buckets(picked, SHARD_BYTES), "id").sortWithinPartitions("id", "t")

    def run(batches):
        encoder, shard = Encoder.of(tokenizer), TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        where, path = blocks.file_system(folder)
        f, docs_, tokens, held, waiting = None, 0, 0, [], 0

        def flush():
            n, ids, doc = (np.concatenate([h[k] for h in held]) for k in range(3))
            known = np.concatenate([h[3] for h in held])
            f.write(to_bytes({"known": known, "id": doc, "n": n, **pack(ids)}))
            held.clear()

        for batch in batches:
            _, offsets = words.buffers(batch.column(1))
            for lo, hi in words.runs(offsets):
                part = batch.slice(lo, hi - lo)
                got, count = encoder.encode(part.column(1))
                doc = part.column(0)
                held.append(((count + 1).astype("<u4"), np.insert(got, np.cumsum(count), np.uint32(end_id)), doc.fill_null(0).to_numpy().astype("<i8"), doc.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)))
                docs_, tokens, waiting = docs_ + len(count), tokens + len(held[-1][1]), waiting + len(held[-1][1])
                if f is None:
                    f = where.open_output_stream(f"{path}/{name}")
                    f.write(MAGIC)
                if waiting >= SECTION:
                    flush()
                    waiting = 0
        if f is not None:
            if held:
                flush()
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([docs_], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "name", "docs", "tokens"])

    where, path = blocks.file_system(folder)
    where.create_dir(path, recursive=True)
    shards = sorted(tuple(r) for r in ranged.mapInArrow(blocks.tidy_batches(run), "shard long, name string, docs long, tokens long").collect())
    listed, start = [], 0
    for _, name, n_docs, tokens in shards:
        listed.append({"name": name, "docs": n_docs, "tokens": tokens, "start": start})
        start += tokens
    with where.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"shards": listed, "end_id": end_id}).encode())
    named = {x["name"] for x in listed}
    for x in where.get_file_info(pafs.FileSelector(path)):  # what failed or repeated attempts wrote
        if x.base_name.startswith("shard-") and x.base_name not in named:
            where.delete_file(x.path)
    return f"{folder}/manifest.json"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the shards that the manifest lists."""
    where, path = blocks.file_system(folder)
    with where.open_input_stream(f"{path}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]

    def run(batches):
        where, path = blocks.file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_stream(f"{path}/{name}") as f:
                    for x in sections(f):
                        n = x["n"].astype(np.int64)
                        ids = unpack(x["rank"], x["control"], x["data"], int(n.sum()))
                        ends = np.cumsum(n)
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                        doc = pa.array(x["id"], mask=x["known"] == 0)
                        yield pa.RecordBatch.from_arrays([doc, pa.array(ends - n + start), pa.array(n), lists], names=["doc_id", "start", "n_tokens", "ids"])
                        start += int(ends[-1])

    table = [(s["name"], s["start"]) for s in shards]
    files = spark.createDataFrame(table, "name string, start long")
    return files.repartition(max(1, len(table))).mapInArrow(blocks.tidy_batches(run), "doc_id long, start long, n_tokens long, ids array<int>")


def remove(folder: str) -> None:
    """Delete what write() made in folder."""
    where, path = blocks.file_system(folder)
    where.delete_dir(path)


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_back.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
