"""Scoring of texts by a weighted backoff automaton over smoothed word n-grams up to trigrams.

The model mixes each order with the one below, by Dirichlet priors: p(w|uv) = (c(uvw) + m3 p(w|v))/(c(uv) + m3),
p(w|v) = (c(vw) + m2 p(w))/(c(v) + m2), p(w) = (c(w) - e)/N, and e V/N for a word not seen. m2 and m3 are such that
the mass left to the lower order, summed over all training contexts, is the share of n-grams seen once (`strength`).
As an automaton: a state for the empty context, each word and each bigram that training documents hold; an arc for
each word that follows the context there, with log p; a failure arc with log(m/(c + m)) to the state without the
first word, taken where there is no arc. One left-to-right traversal carries the state and adds up weights. Texts
are lanes that advance together, one token a step; a long text is several lanes, and as a state depends on no more
than the two tokens before, a lane begins two tokens early, without counting them.

How it is spread. Documents go to blocks. A block sends its distinct words to buckets by hash; the bucket adds up
their training counts over all blocks and answers with count and number, given by falling frequency in the bucket,
so that numbers of frequent words are small. With the numbers the block sends its distinct bigrams and trigrams
of words seen in training to buckets by hash of the n-gram, and gets their counts. So no vocabulary is ever gathered
in one place, every n-gram goes its own way however frequent its words are, and an n-gram of any frequency is one
record a block. A block's automaton holds the states and arcs that its own texts can reach.

Cases. A null text is empty: one token, the end. A null id counts as the empty string for the split. Without
training documents every token has probability 1. Repeated rows each count and each give a row. Very long texts
are lanes of LANE tokens; a text is held whole by one task. Ids must be whole numbers (TypeError). Other columns
are not read. Words are known by the 48 bits of a hash beside its bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, words

ASK_WORDS, WORDS, ASK_GRAMS, GRAMS, TOTALS, SUMS = range(1, 7)
END, BEGIN = np.uint64(0x51ED270B0B1F0E35), np.uint64(0xA24BAED4963EE407)
#: Of documents as stored; a block's tokens are held with about 200 bytes each.
BLOCK_BYTES, CHUNK, LANE = 6 << 20, 1 << 20, 256
#: The strengths at which contexts' shares are added up, powers of two.
GRID = np.arange(-6, 25)


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and each text's number of tokens."""
    out, counts = [], []
    for lo, hi in words.runs(at):
        part = words.lower(buf[at[lo] : at[hi]])
        starts, ends, first = words.spans(part, at[lo : hi + 1] - at[lo], words.NONSPACE)
        h = words.span_hash(words.prefix_hash(part), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        out.append(np.insert(h, first[1:], END))
        counts.append(np.diff(first) + 1)
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def held_out(ids: np.ndarray, modulus: int, remainder: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == blocks.NULL_ID else b"%d" % i) % modulus == remainder for i in ids.tolist()], dtype=bool)


def small(x: np.ndarray) -> np.ndarray:
    """x in the smallest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def deltas(x: np.ndarray) -> np.ndarray:
    """Rising numbers as steps, the first from 0."""
    return small(np.diff(x, prepend=0))


def from_deltas(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several deltas(), one after another."""
    total = np.concatenate([[0], np.cumsum(steps.astype(np.int64))])
    start = np.cumsum(sizes) - sizes
    return total[1:] - np.repeat(total[start], sizes)


def spread_of(*ids: np.ndarray, n: int) -> np.ndarray:
    """Buckets of n-grams."""
    to = words.chain(*[i.astype(np.uint64) for i in ids]) % np.uint64(n)
    return to.astype(np.uint16 if n <= 1 << 16 else np.int64)


class Block:
    """A block's texts as tokens, words by hash."""

    def __init__(self, parts: list[dict], n: int):
        self.ids, buf, at = blocks.gather(parts)
        h, self.counts = tokens(buf, at)
        self.n = n
        self.first = (np.cumsum(self.counts) - self.counts).astype(np.int64)
        self.words, place = np.unique(np.append(h, BEGIN), return_inverse=True)
        self.token, self.begin = place[:-1], place[-1]
        self.to = (self.words % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)
        self.order = np.argsort(self.to, kind="stable")  # the order in which words are asked for

    def ask_words(self, own: int, train: np.ndarray) -> list:
        count = np.bincount(self.token, weights=np.repeat(train, self.counts), minlength=len(self.words)).astype(np.uint32)
        count[self.begin] = train.sum()
        key = (self.words // np.uint64(self.n)) & np.uint64((1 << 48) - 1)
        out = []
        for k, x in blocks.split(self.to, {"key": key, "count": count}):
            low, high = (x["key"] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x["key"] >> np.uint64(32)).astype(np.uint16)
            out.append((k, ASK_WORDS, {"from": np.array([own]), "n": np.array([len(low)]), "low": low, "high": high, "count": small(x["count"])}))
        return out

    def number(self, answers: list[dict]) -> None:
        """Words by falling number from now on: those unseen in training last."""
        a = in_order(answers, ("count", "number"))
        count, number = np.empty(len(self.words), np.int64), np.empty(len(self.words), np.int64)
        count[self.order], number[self.order] = a["count"], a["number"]
        number[count == 0] = np.iinfo(np.int64).max
        by = np.argsort(number, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.count, self.id, self.known = count[by], number[by], int((count > 0).sum())
        self.token, self.begin, self.end = place[self.token], int(place[self.begin]), int(place[np.searchsorted(self.words, END)])
        self.grams()

    def grams(self) -> None:
        """Distinct bigrams and trigrams as numbers of words; those with an unseen word come last or aren't numbered."""
        before = np.concatenate([[0], self.token[:-1]])
        before[self.first] = self.begin
        bits = np.uint64(32)
        two, self.bi = np.unique(before.astype(np.uint64) << bits | self.token.astype(np.uint64), return_inverse=True)
        self.a, self.b = (two >> bits).astype(np.int64), (two & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.two = (self.a < self.known) & (self.b < self.known)  # both words seen
        head = np.zeros(len(self.token), dtype=bool)
        head[self.first] = True
        inner = np.flatnonzero(~head)
        three, place = np.unique(self.bi[inner - 1].astype(np.uint64) << bits | self.token[inner].astype(np.uint64), return_inverse=True)
        self.tri = np.full(len(self.token), -1)
        self.tri[inner] = place
        self.vw = np.empty(len(three), np.int64)  # the bigram that ends a trigram
        self.vw[place] = self.bi[inner]
        self.ab, self.c = (three >> bits).astype(np.int64), (three & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.three = self.two[self.ab] & (self.c < self.known)

    def asked(self):
        """For both orders: the n-grams asked for, their buckets and order."""
        two, three = np.flatnonzero(self.two), np.flatnonzero(self.three)
        a, b, ab, c = self.id[self.a[two]], self.id[self.b[two]], self.ab[three], self.id[self.c[three]]
        u, v = self.id[self.a[ab]], self.id[self.b[ab]]
        out = []
        for which, ids in ((two, (a, b)), (three, (u, v, c))):
            to = spread_of(*ids, n=self.n)
            order = np.argsort(to, kind="stable")
            out.append((which[order], to[order], [x[order] for x in ids]))
        return out

    def ask_grams(self, own: int, train: np.ndarray) -> list:
        weight = np.repeat(train, self.counts)
        counts = [np.bincount(self.bi, weights=weight, minlength=len(self.a)).astype(np.uint32), np.bincount(self.tri[self.tri >= 0], weights=weight[self.tri >= 0], minlength=len(self.c)).astype(np.uint32)]
        (w2, t2, (a, b)), (w3, t3, (u, v, c)) = self.asked()
        cut2, cut3 = (np.searchsorted(t, np.arange(self.n + 1)) for t in (t2, t3))
        c2, c3 = counts[0][w2], counts[1][w3]
        out = []
        for k in range(self.n):
            x, y = slice(cut2[k], cut2[k + 1]), slice(cut3[k], cut3[k + 1])
            n2, n3 = x.stop - x.start, y.stop - y.start
            if n2 or n3:
                out.append((k, ASK_GRAMS, {
                    "from": np.array([own]), "end": self.id[[self.end]], "n2": np.array([n2]), "n3": np.array([n3]),
                    "a": deltas(a[x]), "b": small(b[x]), "c2": small(c2[x]), "u": deltas(u[y]), "v": small(v[y]), "w": small(c[y]), "c3": small(c3[y]),
                }))
        return out

    def counted(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the block's bigrams and trigrams."""
        x = in_order(answers, ("c2", "c3"))
        two, three = np.zeros(len(self.a), np.int64), np.zeros(len(self.c), np.int64)
        (w2, _, _), (w3, _, _) = self.asked() if len(x["c2"]) or len(x["c3"]) else ((np.zeros(0, np.int64),) * 3,) * 2
        two[w2], three[w3] = x["c2"], x["c3"]
        return two, three


def in_order(answers: list[dict], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The arrays of all buckets' answers, end to end by bucket."""
    pieces: dict[str, list] = {k: [] for k in names}
    place: list[np.ndarray] = []
    for a in answers:
        place.append(a["bucket"])
        for k in names:
            pieces[k] += np.split(a[k], np.cumsum(a[f"n_{k}"])[:-1])
    if not place:
        return {k: np.zeros(0, np.int64) for k in names}
    order = np.argsort(np.concatenate(place), kind="stable").tolist()
    return {k: np.concatenate([v[i] for i in order]).astype(np.int64) for k, v in pieces.items()}


def answer(own: int, to: np.ndarray, kind: int, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> list:
    """Answers to the blocks `to`: of each column (values, sizes) the part that is theirs."""
    cuts = {k: np.concatenate([[0], np.cumsum(size)]) for k, (_, size) in columns.items()}
    out = []
    for i, block in enumerate(to.tolist()):
        x = {k: v[cuts[k][i] : cuts[k][i + 1]] for k, (v, _) in columns.items()}
        out.append((block, kind, {"bucket": np.array([own])} | {k: small(v) for k, v in x.items()} | {f"n_{k}": np.array([len(v)]) for k, v in x.items()}))
    return out


def totals(names: list[str], values: list[float]) -> tuple:
    return (0, TOTALS, {"name": np.frombuffer("\n".join([*names, ""]).encode(), dtype=np.uint8), "value": np.array(values, dtype=np.float64)})


def left_over(count: np.ndarray) -> list[float]:
    """Over contexts of these counts, the mass that each strength of GRID leaves to the lower order, in tokens."""
    c = np.bincount(np.minimum(count, 1 << 16)) if len(count) else np.zeros(1, np.int64)
    big = count[count >= 1 << 16]
    k = np.flatnonzero(c[: 1 << 16])
    return [float((c[k] * (k * m / (k + m))).sum() + (big * m / (big + m)).sum()) for m in 2.0**GRID]


def add_words(own: int, n: int, parts: list[dict]) -> list:
    """A bucket's answers to words asked for, and its share of the totals."""
    x = blocks.joined(parts)
    key = x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32)
    distinct, place = np.unique(key, return_inverse=True)
    count = np.bincount(place, weights=x["count"], minlength=len(distinct)).astype(np.int64)
    order = np.argsort(-count, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) * n + own
    special = lambda w: (distinct == (w // np.uint64(n)) & np.uint64((1 << 48) - 1)) & (int(w % np.uint64(n)) == own)
    real, context = count[~special(BEGIN)], count[~special(END)]
    names = ["tokens", "words", "w1", "w2", *[f"l2_{k}" for k in range(len(GRID))]]
    values = [real.sum(), (real > 0).sum(), (real == 1).sum(), (real == 2).sum(), *left_over(context[context > 0])]
    sizes = x["n"]
    return [*answer(own, x["from"], WORDS, {"count": (count[place], sizes), "number": (number[place], sizes)}), totals(names, values)]


def add_grams(own: int, parts: list[dict]) -> list:
    """A bucket's counts of n-grams asked for, and its share of the totals."""
    x = blocks.joined(parts)
    if max(int(x[k].max()) if len(x[k]) else 0 for k in "bvw") >> 32:
        raise OverflowError("over 2**32 words")
    bits = np.uint64(32)
    two = from_deltas(x["a"], x["n2"]).astype(np.uint64) << bits | x["b"].astype(np.uint64)
    distinct, place = np.unique(two, return_inverse=True)
    c2 = np.bincount(place, weights=x["c2"], minlength=len(distinct)).astype(np.int64)
    uv, at = np.unique(from_deltas(x["u"], x["n3"]).astype(np.uint64) << bits | x["v"].astype(np.uint64), return_inverse=True)
    three, place3 = np.unique(at.astype(np.uint64) << bits | x["w"].astype(np.uint64), return_inverse=True)
    c3 = np.bincount(place3, weights=x["c3"], minlength=len(three)).astype(np.int64)
    context = c2[((distinct & np.uint64(0xFFFFFFFF)).astype(np.int64) != int(x["end"][0])) & (c2 > 0)]
    names = ["one2", "one3", *[f"l3_{k}" for k in range(len(GRID))]]
    values = [(c2 == 1).sum(), (c3 == 1).sum(), *left_over(context)]
    return [*answer(own, x["from"], GRAMS, {"c2": (c2[place], x["n2"]), "c3": (c3[place3], x["n3"])}), totals(names, values)]


def strength(left: np.ndarray, once: float) -> float:
    """The strength at which the mass left to the lower order is the number of n-grams seen once (between grid points by straight line)."""
    return float(2.0 ** np.interp(once, left, GRID)) if left[-1] > 0 else 1.0


class Automaton:
    """States, arcs and failure arcs for a block's texts; weights are log10 probabilities."""

    def __init__(self, block: Block, two: np.ndarray, three: np.ndarray, total: dict[str, float]):
        n, v = total["tokens"], total["words"]
        e = min(0.95, max(0.05, total["w1"] / max(1, total["w1"] + 2 * total["w2"])))
        m2, m3 = (strength(np.array([total[f"l{k}_{i}"] for i in range(len(GRID))]), total[f"one{k}"]) for k in (2, 3))
        count, a, b, ab = block.count, block.a, block.b, block.ab
        p1 = np.where(count > 0, (count - e) / max(1, n), e * v / n if n else 1.0)
        p2 = (two + m2 * p1[b]) / (count[a] + m2)
        p3 = (three + m3 * p2[block.vw]) / (two[ab] + m3)
        words_, pairs = (count > 0) & (np.arange(len(count)) != block.end), (two > 0) & (b != block.end)
        # states: 0 the empty one, then words, then bigrams
        self.of_word = np.where(words_, np.cumsum(words_), 0)
        n1 = int(words_.sum())
        self.of_pair = np.where(pairs, n1 + np.cumsum(pairs), 0)
        self.order = np.concatenate([[0], np.full(n1, 1, np.int8), np.full(int(pairs.sum()), 2, np.int8)]).astype(np.int8)
        self.failure = np.concatenate([[0.0], np.log10(m2 / (count[words_] + m2)), np.log10(m3 / (two[pairs] + m3))])
        self.falls_to = np.concatenate([np.zeros(1 + n1, np.int64), self.of_word[b[pairs]]])
        # arcs by order of the state they leave: weight (nan: no arc) and the state they lead to
        after = np.where(self.of_pair > 0, self.of_pair, self.of_word[b])
        with np.errstate(divide="ignore"):
            self.arc = [np.log10(p1), np.where(two > 0, np.log10(p2), np.nan), np.where(three > 0, np.log10(p3), np.nan)]
        self.leads = [self.of_word, after, after[block.vw]]
        self.failures = 0

    def traverse(self, block: Block) -> np.ndarray:
        """The weight of each token: the failure arcs taken before it, and its arc."""
        out = np.zeros(len(block.token))
        if not len(out):
            return out
        number = -(-block.counts // LANE)
        k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        first = np.repeat(block.first, number)
        start = first + k * LANE
        stop = np.minimum(start + LANE, first + np.repeat(block.counts, number))
        pos = start - 2 * (k > 0)  # the two tokens before set the state
        state = np.where(k > 0, 0, self.of_word[block.begin])
        by = np.argsort(pos - stop, kind="stable")  # longest lanes first
        start, stop, pos, state = start[by], stop[by], pos[by], state[by]
        numbers = (block.token, block.bi, block.tri)
        while len(pos):
            weight = np.zeros(len(pos))
            todo = np.arange(len(pos))
            after = np.empty(len(pos), np.int64)
            while len(todo):
                s = state[todo]
                order = self.order[s]
                w, to = np.empty(len(todo)), np.empty(len(todo), np.int64)
                for o in (0, 1, 2):
                    m = np.flatnonzero(order == o)
                    if len(m):
                        i = numbers[o][pos[todo[m]]]
                        w[m], to[m] = self.arc[o][i], self.leads[o][i]
                fails = np.isnan(w)
                done = todo[~fails]
                weight[done] += w[~fails]
                after[done] = to[~fails]
                todo = todo[fails]
                weight[todo] += self.failure[state[todo]]
                state[todo] = self.falls_to[state[todo]]
                self.failures += len(todo)
            counted = pos >= start
            out[pos[counted]] = weight[counted]
            state = after
            pos = pos + 1
            live = int(np.searchsorted(pos - stop, 0))
            start, stop, pos, state = start[:live], stop[:live], pos[:live], state[:live]
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score); documents with crc32(id) mod modulus = remainder are held out."""
    spark = docs.sparkSession
    blocks.prepare(spark)
    n = blocks.buckets(docs.select(id_col, text_col), BLOCK_BYTES)
    packed, route = blocks.packed(docs, n, id_col, text_col, CHUNK), blocks.Route(n)

    def own_of(table):
        return table.column("bucket")[0].as_py()

    def train(block):
        return ~held_out(block.ids, modulus, remainder)

    def ask(table: pa.Table) -> pa.Table:
        block = Block(blocks.by_kind(table)[blocks.DOCS], n)
        return route.table(block.ask_words(own_of(table), train(block)), own_of(table))

    def count_words(table: pa.Table) -> pa.Table:
        return route.table(add_words(own_of(table), n, blocks.by_kind(table)[ASK_WORDS]), own_of(table))

    def ask_grams(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(blocks.by_kind(left).get(blocks.DOCS, []), n)
        if not len(block.ids):
            return route.table([], 0)
        block.number(blocks.by_kind(right)[WORDS])
        return route.table(block.ask_grams(own_of(left), train(block)), own_of(left))

    def count_grams(table: pa.Table) -> pa.Table:
        return route.table(add_grams(own_of(table), blocks.by_kind(table)[ASK_GRAMS]), own_of(table))

    def told(batches):
        for batch in batches:
            for x in blocks.by_kind(pa.Table.from_batches([batch])).get(TOTALS, []):
                yield pa.RecordBatch.from_arrays([pa.array(x["name"].tobytes().decode().split("\n")[:-1]), pa.array(x["value"])], names=["name", "value"])

    def summed(table: pa.Table) -> pa.Table:  # some 70 numbers
        names = "".join(f"{x}\n" for x in table.column("name").to_pylist())
        return pa.Table.from_batches([blocks.rows([(0, SUMS, {"name": np.frombuffer(names.encode(), np.uint8), "value": table.column("value").to_numpy()})])])

    # one plan, so that each exchange is written once and read by all that follow
    words_ = route.spread(route.spread(packed.groupBy("bucket").applyInArrow(blocks.tidy(ask), blocks.SCHEMA)).groupBy("bucket").applyInArrow(blocks.tidy(count_words), blocks.SCHEMA))
    asked = packed.groupBy("bucket").cogroup(words_.groupBy("bucket")).applyInArrow(blocks.tidy_two(ask_grams), blocks.SCHEMA)
    grams = route.spread(route.spread(asked).groupBy("bucket").applyInArrow(blocks.tidy(count_grams), blocks.SCHEMA))
    sums = words_.mapInArrow(told, "name string, value double").unionByName(grams.mapInArrow(told, "name string, value double"))
    sums = sums.groupBy("name").agg(F.sum("value").alias("value")).groupBy(F.lit(0).alias("_one")).applyInArrow(summed, blocks.SCHEMA)
    each = sums.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))  # for every block
    answers = words_.unionByName(grams).unionByName(each.select(words_.columns)).repartition(n, "bucket")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block, got = Block(blocks.by_kind(left).get(blocks.DOCS, []), n), blocks.by_kind(right)
        if not len(block.ids):
            return schema_.empty_table()
        total = dict.fromkeys(("tokens", "words", "w1", "w2", "one2", "one3"), 0.0) | {f"l{k}_{i}": 0.0 for k in (2, 3) for i in range(len(GRID))}
        total |= dict(zip(got[SUMS][0]["name"].tobytes().decode().split("\n"), got[SUMS][0]["value"].tolist(), strict=False))
        block.number(got[WORDS])
        a = Automaton(block, *block.counted(got.get(GRAMS, [])), total)
        steps = a.traverse(block)
        c = block.count[block.token]
        base = np.log10((c + 1) / (total["tokens"] + total["words"] + 1))
        add = lambda x: np.add.reduceat(x, block.first)
        return pa.table([
            pa.array(block.ids, mask=block.ids == blocks.NULL_ID), pa.array(held_out(block.ids, modulus, remainder)), pa.array(block.counts, pa.int64()), pa.array(add((c > 0).astype(np.int64))),
            pa.array(np.full(len(block.ids), int(total["tokens"]), dtype=np.int64)), pa.array(add(base)), pa.array(add(steps)),
        ], schema=schema_)

    schema_ = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(blocks.tidy_two(finish), f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
