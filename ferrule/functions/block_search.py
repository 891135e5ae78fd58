"""Search in one block of a stored keyword index, with numpy: BM25 and the keyword ladder, for many questions at once.

A block holds up to some hundred documents in order of id. Texts are in searchable form (a-z, 0-9 and white space), so a byte is a
character. terms: the block's distinct words; held, place, tf: how many documents each term has, which, and how often it is there; title_held,
title_place: those of the title. What follows from these is made where a search needs it, and not stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Digits of a word as numbers from 1 to 36, 0 for white space.
DIGIT = np.zeros(256, dtype=np.int64)
DIGIT[48:58], DIGIT[97:123] = np.arange(1, 11), np.arange(11, 37)
#: Needles are met by their first characters: so many fit a whole number exactly (37**8 < 2**63).
NEEDLE = 8


#: UTF-8 bytes in searchable form; bytes inside a character go, so each character is one byte. The two characters beyond ASCII whose lower case holds an ASCII letter.
SEARCHABLE = np.full(256, 32, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789\t\n\x0b\x0c\r":
    SEARCHABLE[_c] = _c
SEARCHABLE[65:91] = np.arange(97, 123)
LOWER_ASCII = (("\u212a", "k"), ("\u0130", "i "))


def searchable(strings: pa.Array) -> pa.Array:
    """What text.searchable gives, for many strings in one pass over their bytes; nulls stay."""
    strings = strings.cast(pa.large_string())
    for special, plain in LOWER_ASCII:
        if pc.any(pc.match_substring(strings, special)).as_py():
            strings = pc.replace_substring(strings, special, plain)
    buf, at = _bytes(strings)
    first = (buf & 0xC0) != 0x80
    starts = np.concatenate([[0], np.cumsum(first)])[at].astype(np.int64)
    missing = pc.is_null(strings).to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes()) if missing.any() else None
    whole = pa.LargeStringArray.from_buffers(len(strings), pa.py_buffer(starts.tobytes()), pa.py_buffer(SEARCHABLE[buf[first]].tobytes()), valid)
    return whole.cast(pa.string())


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = strings.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, at, data = raw.buffers()
    at = np.frombuffer(at, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return (np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(raw) else np.zeros(0, np.uint8)), at - at[0]


def _words(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of searchable strings, one string after another, and each one's string."""
    buf, at = _bytes(strings)
    inside = DIGIT[buf] > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = at[1:-1][at[1:-1] < len(buf)]
    begin[cut] = inside[cut]
    start = np.flatnonzero(begin)
    kept = np.cumsum(inside)
    first = kept[start] - 1
    offsets = np.append(first, kept[-1] if len(kept) else 0).astype(np.int32)
    array = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[inside].tobytes()))
    return array, np.searchsorted(at, start, side="right") - 1


def grams(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram, term) in order: all runs of three characters of each term, as numbers."""
    buf, at = _bytes(terms)
    d = DIGIT[buf]
    code = d[:-2] * 1369 + d[1:-1] * 37 + d[2:] if len(d) > 2 else np.zeros(0, np.int64)
    term = np.repeat(np.arange(len(terms)), np.diff(at))[: len(code)]
    inner = np.arange(len(code)) + 3 <= at[term + 1]
    pair = np.sort(code[inner] * len(terms) + term[inner]) if len(terms) else code
    pair = pair[np.diff(pair, prepend=-1) > 0]
    return (pair // max(1, len(terms))).astype(np.int32), (pair % max(1, len(terms))).astype(np.int32)


def _postings(term: np.ndarray, place: np.ndarray, n_terms: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, tf = np.unique(term.astype(np.int64) * max(1, n) + place, return_counts=True)
    t = pair // max(1, n)
    return np.searchsorted(t, np.arange(n_terms + 1)), pair % max(1, n), tf


def make(ids: pa.Array, text: pa.Array, title: pa.Array) -> dict:
    """A block of documents, which must be in order of id."""
    words, where = _words(text)
    more, more_where = _words(title)
    every = pa.concat_arrays([words, more]).dictionary_encode()
    code, terms = every.indices.to_numpy(zero_copy_only=False), every.dictionary
    n, n_terms, n_words = len(ids), len(terms), len(words)
    at, place, tf = _postings(code[:n_words], where, n_terms, n)
    title_at, title_place, _ = _postings(code[n_words:], more_where, n_terms, n)
    dl = np.bincount(where, minlength=n)
    return {"ids": ids, "text": text, "title": title, "dl": dl, "terms": terms, "held": np.diff(at), "place": place, "tf": tf, "title_held": np.diff(title_at), "title_place": title_place}


class Block:
    """A block as it is read, and what questions need of it, made when they do."""

    def __init__(self, parts: dict, allowed: np.ndarray | None = None):
        for k, v in parts.items():
            setattr(self, k, v)
        self.n = len(self.ids)
        self.open = np.ones(self.n, dtype=bool) if allowed is None else np.isin(np.arange(self.n), allowed)  # what may be given out

    @cached_property
    def at(self) -> np.ndarray:
        """Where each term's documents begin, and the end."""
        return np.concatenate([[0], np.cumsum(self.held)])

    @cached_property
    def title_at(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.title_held)])

    @cached_property
    def extremes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term the greatest tf and the least length of its documents; 0 and 1 of one that only titles have."""
        most, least, has = np.zeros(len(self.terms), np.int64), np.ones(len(self.terms), np.int64), self.held > 0
        if has.any():  # the runs of terms without documents are empty, so the rest follow one another
            most[has], least[has] = np.maximum.reduceat(self.tf, self.at[:-1][has]), np.minimum.reduceat(self.dl[self.place], self.at[:-1][has])
        return most, least

    @cached_property
    def anywhere(self) -> tuple[np.ndarray, np.ndarray]:
        """at and place of text or title."""
        n, terms = max(1, self.n), np.arange(len(self.terms))
        pair = np.sort(np.concatenate([np.repeat(terms, self.held) * n + self.place, np.repeat(terms, self.title_held) * n + self.title_place]), kind="stable")  # two runs in order
        pair = pair[np.diff(pair, prepend=-1) > 0]
        return np.searchsorted(pair // n, np.arange(len(terms) + 1)), pair % n

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        return grams(self.terms)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The number of each word here, -1 where the block doesn't have it."""
        return pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)

    def gain(self, k1: float, b: float, mean_length: float) -> np.ndarray:
        return self.tf * (k1 + 1) / (self.tf + k1 * (1 - b + b * self.dl[self.place] / mean_length))

    def bound(self, k1: float, b: float, mean_length: float) -> np.ndarray:
        """For each term what it can give a document of this block at most."""
        most, least = self.extremes
        return most * (k1 + 1) / (most + k1 * (1 - b + b * least / mean_length))

    def spans(self, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which postings the codes have, and each one's place in codes."""
        n = at[codes + 1] - at[codes]
        rep = np.repeat(np.arange(len(codes)), n)
        return np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + at[codes][rep], rep

    def targets(self, which: np.ndarray) -> list[str]:
        """Text and title of documents, as the ladder looks at them."""
        both = zip(self.text.take(pa.array(which)).to_pylist(), self.title.take(pa.array(which)).to_pylist(), strict=True)
        return [" ".join(x for x in pair if x is not None) for pair in both]

    def tight(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters and digits of text and title, without white space, one document after another."""
        if not hasattr(self, "_tight"):
            whole = pa.array(self.targets(np.arange(self.n)), pa.string())
            buf, at = _bytes(whole)
            inside = DIGIT[buf] > 0
            self._tight = buf[inside], np.concatenate([[0], np.cumsum(inside)])[at]
        return self._tight

    def holding(self, needles: list[str]) -> list[np.ndarray]:
        """The documents whose tight form holds each needle (of NEEDLE characters or more): their first characters are looked for in one pass, then all are compared."""
        buf, at = self.tight()
        out = [np.zeros(0, np.int64)] * len(needles)
        if len(buf) < NEEDLE or not needles:
            return out
        code, power = DIGIT[buf], 37
        for k in (1, 2, 4):  # of 2, 4 and 8 characters
            code, power = code[:-k] * power + code[k:], power * power
        head = np.array([int(np.polyval(DIGIT[np.frombuffer(w[:NEEDLE].encode(), np.uint8)].astype(object), 37)) for w in needles], dtype=np.int64)
        asked = np.unique(head)
        spot = Sieve(asked.view(np.uint64)).passed(code.view(np.uint64))
        spot = spot[asked[np.minimum(np.searchsorted(asked, code[spot]), len(asked) - 1)] == code[spot]]
        by = code[spot]
        order = np.argsort(by, kind="stable")
        spot, by = spot[order], by[order]
        raw = buf.tobytes()
        for k, w in enumerate(needles):
            lo, hi = np.searchsorted(by, [head[k], head[k] + 1])
            w_ = w.encode()
            hits = [p for p in spot[lo:hi].tolist() if raw.startswith(w_, p)]
            doc = np.searchsorted(at, hits, side="right") - 1
            out[k] = np.unique(doc[at[doc + 1] - np.array(hits) >= len(w_)]) if hits else out[k]
        return out

    def containing(self, word: str) -> np.ndarray:
        """Terms that hold a word of three characters or more somewhere: those of its rarest three characters, compared."""
        code = DIGIT[np.frombuffer(word.encode(), np.uint8)]
        code = np.unique(code[:-2] * 1369 + code[1:-1] * 37 + code[2:])
        gram, gram_term = self.grams
        lo, hi = np.searchsorted(gram, code), np.searchsorted(gram, code, side="right")
        k = int(np.argmin(hi - lo))
        near = gram_term[lo[k] : hi[k]]
        return near[[word in t for t in self.terms.take(pa.array(near)).to_pylist()]] if len(near) else near


def first(order: tuple[np.ndarray, ...], k: int | None) -> np.ndarray:
    """The k first places by order (most important key last, as in lexsort)."""
    return np.lexsort(order)[:k]


class Bm25:
    """The k best documents of each question; a block that can't reach a question's k-th best score so far is passed over."""

    def __init__(self, questions: dict, k: int, k1: float, b: float, mean_length: float):
        self.q, self.k, self.how = questions, k, (k1, b, mean_length)
        self.least = np.zeros(len(questions["id"]))
        self.best: list[np.ndarray] = [np.zeros(0)] * len(self.least)
        self.read = self.passed = 0

    def of(self, block: Block) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places, scores)."""
        known = block.codes(self.q["words"])
        gain, most = block.gain(*self.how), np.append(block.bound(*self.how), 0.0)
        out = []
        for i in range(len(self.least)):
            lo, hi = self.q["first"][i], self.q["first"][i + 1]
            code, weight = known[self.q["word"][lo:hi]], self.q["weight"][lo:hi]
            if self.least[i] > 0 and (np.maximum(weight, 0) * most[code]).sum() < self.least[i] - 1e-5:
                self.passed += 1
                continue
            self.read += 1
            here = code >= 0
            which, rep = block.spans(block.at, code[here])
            score = np.bincount(block.place[which], weights=gain[which] * weight[here][rep], minlength=block.n)
            found = np.flatnonzero((score > 0) & block.open)
            if len(found) > self.k:  # scores are rounded later: what may round to the k-th stays
                edge = np.partition(score[found], -self.k)[-self.k]
                found = found[score[found] >= edge - 2e-6]
            if len(found):
                self.best[i] = np.sort(np.concatenate([self.best[i], score[found]]))[-self.k :]
                if len(self.best[i]) == self.k:
                    self.least[i] = self.best[i][0]
                    found = found[score[found] >= self.least[i] - 2e-6]
                out.append((i, found, score[found]))
        return out


#: Words and documents of a table of which documents hold which words within theirs.
NEAR = 8 << 20


class Ladder:
    """The keyword ladder; `parts`: with phrases within words and parts of words. k: the best of each question, or None for all. All questions are counted in one pass."""

    def __init__(self, questions: dict, k: int | None, parts: bool):
        self.q, self.k, self.needles = questions, k, Needles(questions["words"]) if parts else None
        self.n = np.diff(questions["first"])
        self.asking = np.repeat(np.arange(len(self.n)), self.n)
        self.forms = sorted({f for f in questions["form"] if f is not None})
        formed = np.array([f is not None for f in questions["form"]], dtype=np.int64)
        self.most, self.title_most = (np.maximum(1, n)[:, None] for n in (self.n, self.n + formed))

    def _counted(self, block: Block, at: np.ndarray, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(question, document): how many of the question's words, as numbers in at, the document has."""
        which, rep = block.spans(at, code[code >= 0])
        return np.bincount(self.asking[code >= 0][rep] * block.n + place[which], minlength=len(self.n) * block.n).reshape(-1, block.n)

    def _within(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """at and place of the documents that have each of the questions' words as a word or a part of one."""
        any_at, any_place = block.anywhere
        hits = list(self.needles.of(block.terms, once=False))
        held, place, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, NEAR // max(1, block.n))
        for lo in range(0, len(self.q["words"]), step):
            near = np.zeros((min(step, len(self.q["words"]) - lo), block.n), dtype=bool)
            for term, word in hits:
                some = (word >= lo) & (word < lo + step)
                which, rep = block.spans(any_at, term[some])
                near[word[some][rep] - lo, any_place[which]] = True
            held.append(near.sum(axis=1))
            place.append(np.nonzero(near)[1])
        return np.concatenate([[0], np.cumsum(np.concatenate(held))]), np.concatenate(place)

    def of(self, block: Block) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(question, places, keyword scores, title scores)."""
        q, n, out = self.q, self.n[:, None], []
        code = block.codes(q["words"])[q["word"]]
        whole, title = self._counted(block, *block.anywhere, code), self._counted(block, block.title_at, block.title_place, code)
        score = np.where(whole > 0, np.minimum(1.0, 0.75 + whole / self.most * 0.2), 0.0)
        said = np.array([bool(p) for p in q["phrase"]], dtype=bool)[:, None] & (n > 0)
        if self.needles is not None:
            part = np.where(whole == 0, self._counted(block, *self._within(block), q["word"]), 0)
            score = np.where(part > 0, np.minimum(1.0, 0.52 + part / self.most * 0.16), score)
            for i, every in _rows(said & (part == n)):
                score[i, every[[q["phrase"][i] in t for t in block.targets(every)]]] = 0.72
        holding = dict(zip(self.forms, block.holding(self.forms), strict=True))
        for i, form in enumerate(q["form"]):
            tight = holding[form] if form is not None else ()
            if len(tight):
                score[i, tight] = 0.84
                titles = block.title.take(pa.array(tight)).to_pylist()
                title[i, tight] += np.array(["".join((t or "").split()).find(form) >= 0 for t in titles], dtype=np.int64)
        for i, every in _rows(said & (whole == n)):
            padded = [f" {t} ".translate(_SPACES) for t in block.targets(every)]
            score[i, every[[f" {q['phrase'][i]} " in t for t in padded]]] = 1.0
        title_score = np.where(title > 0, np.minimum(1.0, 0.35 + title / self.title_most * 0.45), 0.0)
        for i, found in _rows(((score > 0) | (title_score > 0)) & block.open):
            if self.k is not None:
                found = found[first((found, -title_score[i, found], -score[i, found]), self.k)]
            out.append((i, found, score[i, found], title_score[i, found]))
        return out


def _rows(test: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of a table in which anything is true, and where."""
    row, place = np.nonzero(test)
    at = np.searchsorted(row, np.arange(len(test) + 1))
    for i in np.flatnonzero(np.diff(at)).tolist():
        yield i, place[at[i] : at[i + 1]]


class Titles:
    """The k titles of each question that share most with it (None: all that share anything): whole words, and its compact form as one more. All questions are counted in one pass."""

    def __init__(self, questions: dict, k: int | None):
        self.q, self.k = questions, k
        n = np.diff(questions["first"])
        self.asking = np.repeat(np.arange(len(n)), n)
        self.most = np.maximum(1, n + np.array([f is not None for f in questions["form"]], dtype=np.int64))

    def of(self, block: Block) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places, scores)."""
        q, out, n = self.q, [], block.n
        code = block.codes(q["words"])[q["word"]]
        which, rep = block.spans(block.title_at, code[code >= 0])
        hits = np.bincount(self.asking[code >= 0][rep] * n + block.title_place[which], minlength=len(self.most) * n).reshape(-1, n)
        forms = sorted({f for f in q["form"] if f is not None})
        holding = dict(zip(forms, block.holding(forms), strict=True))
        for i, form in enumerate(q["form"]):
            if form is not None and len(holding[form]):
                hits[i, holding[form]] += 1
        asked, place = np.nonzero((hits > 0) & block.open)
        score = np.minimum(1.0, 0.35 + hits[asked, place] / self.most[asked] * 0.45)
        cut = np.searchsorted(asked, np.arange(len(self.most) + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            found, s = place[cut[i] : cut[i + 1]], score[cut[i] : cut[i + 1]]
            best = first((found, -s), self.k) if self.k is not None else np.arange(len(found))
            out.append((i, found[best], s[best]))
        return out


class Holding:
    """The documents that hold all words of each question in their text."""

    def __init__(self, questions: dict):
        self.q = questions

    def of(self, block: Block) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places, how many words)."""
        q, known, out = self.q, block.codes(self.q["words"]), []
        for i in range(len(q["id"])):
            code = known[q["word"][q["first"][i] : q["first"][i + 1]]]
            if not len(code) or (code < 0).any():
                continue
            held = np.bincount(block.place[block.spans(block.at, code)[0]], minlength=block.n)
            found = np.flatnonzero((held == len(code)) & block.open)
            if len(found):
                out.append((i, found, held[found]))
        return out


_SPACES = {ord(c): " " for c in "\t\n\x0b\f\r"}


#: Bytes of texts whose letters or words are counted at once, each as whole numbers of eight bytes.
LETTER_BYTES = WORD_BYTES = 1 << 20


def sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)


def runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """From and to of runs of texts of up to `size` bytes, or of one text."""
    end, lo = np.cumsum(sizes(texts)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


#: Hits that are compared byte by byte at once.
HITS = 1 << 16
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


class Sieve:
    """A table that turns away most numbers that are none of those it was made of."""

    def __init__(self, codes: np.ndarray):
        self.bits = np.uint64(64 - min(24, max(12, len(codes).bit_length() + 4)))
        self.open = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
        self.open[self._slot(codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.bits

    def passed(self, codes: np.ndarray) -> np.ndarray:
        """Where those stand that are not turned away."""
        return np.flatnonzero(self.open[self._slot(codes)])


class Needles:
    """Strings that are looked for inside others: windows of each needle's length by a rolling hash, those that agree byte by byte. Empty needles are nowhere."""

    def __init__(self, needles: pa.Array):
        self.buf, self.at = _bytes(needles)
        size = np.diff(self.at)
        self.by_size = []
        for n in np.unique(size[size > 0]).tolist():
            which, step, power = np.flatnonzero(size == n), max(1, LETTER_BYTES // n), _powers(BASE, n)
            code = np.concatenate([(self._letters(which[k : k + step], n) * power).sum(axis=1, dtype=np.uint64) for k in range(0, len(which), step)])
            order = np.argsort(code, kind="stable")
            self.by_size.append((n, code[order], which[order], Sieve(code)))

    def of(self, texts: pa.Array, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, needle) of each run of texts. once: False where a needle that a text has several times may come as often."""
        for lo, hi in runs(texts, LETTER_BYTES):
            buf, at = _bytes(texts.slice(lo, hi - lo))
            longest = int(np.diff(at).max(initial=0))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_powers(BASE, len(buf)) * buf, dtype=np.uint64)])
            back = _powers(pow(BASE, -1, 1 << 64), len(buf))
            for n, code, which, sieve in self.by_size:
                if n > longest:
                    break
                here = (sums[n:] - sums[:-n]) * back[: len(buf) - n + 1]
                spot = sieve.passed(here)
                text = np.searchsorted(at, spot, side="right") - 1
                inside = spot + n <= at[text + 1]
                spot, text = spot[inside], text[inside]
                first, last = np.searchsorted(code, here[spot]), np.searchsorted(code, here[spot], side="right")
                for part in range(0, len(spot), HITS):
                    some = slice(part, part + HITS)
                    many = last[some] - first[some]
                    rep = np.repeat(np.arange(len(many)), many)
                    needle = which[first[some][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)]
                    yield from self._same(buf, spot[some][rep], text[some][rep] + lo, needle, n, once)

    def _letters(self, needle: np.ndarray, n: int) -> np.ndarray:
        return self.buf[self.at[needle][:, None] + np.arange(n)]

    def _same(self, buf: np.ndarray, spot: np.ndarray, text: np.ndarray, needle: np.ndarray, n: int, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of one length that agree; only those at the edge of two parts may come twice."""
        step = max(1, LETTER_BYTES // n)
        for part in range(0, len(spot), step):
            some = slice(part, part + step)
            same = (buf[spot[some][:, None] + np.arange(n)] == self._letters(needle[some], n)).all(axis=1)
            if once:
                pair = np.unique(text[some][same] * len(self.at) + needle[some][same])
                yield pair // len(self.at), pair % len(self.at)
            else:
                yield text[some][same], needle[some][same]


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)])[:n], dtype=np.uint64)


def bags(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """Of each run of texts: from, to, the number of words of each, and each one's list of (term, tf)."""
    for lo, hi in runs(texts, WORD_BYTES):
        words, where = _words(searchable(texts.slice(lo, hi - lo)))
        every = words.dictionary_encode()
        n = max(1, len(every.dictionary))
        pair, tf = np.unique(where.astype(np.int64) * n + every.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at = np.searchsorted(pair, np.arange(hi - lo + 1) * n)
        terms = pa.StructArray.from_arrays([every.dictionary.take(pa.array(pair % n)), pa.array(tf, pa.int64())], names=["term", "tf"])
        yield lo, hi, pa.array(np.bincount(where, minlength=hi - lo), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), terms)


def letter_profile(texts: pa.Array) -> pa.ListArray:
    """How often each letter from a to z occurs in a text in lower case, as a unit vector: a stand-in for an encoder that SQL can tell as well. A null text is empty."""
    counts = np.zeros((len(texts), 26))
    for lo, hi in runs(texts, LETTER_BYTES):
        buf, at = _bytes(searchable(texts.slice(lo, hi - lo)))
        letter = buf - np.uint8(97)  # other characters are beyond 25
        text = np.repeat(np.arange(hi - lo), np.diff(at))[letter < 26]
        counts[lo:hi] = np.bincount(text * 26 + letter[letter < 26], minlength=26 * (hi - lo)).reshape(-1, 26)
    norm = np.sqrt((counts * counts).sum(axis=1))[:, None]
    np.divide(counts, norm, out=counts, where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * 26, pa.int32()), pa.array(counts.ravel()))


def nearest(ids: pa.Array, vectors: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, place, inner product) of each question's k greatest in a block, and of what may tie with them once rounded."""
    inner = asked @ vectors.T
    if len(vectors) > k:
        edge = np.partition(inner, -k, axis=1)[:, -k]
        q, p = np.nonzero(inner >= edge[:, None] - 4e-6)
    else:
        q, p = np.nonzero(np.ones(inner.shape, dtype=bool))
    return q, p, inner[q, p]
