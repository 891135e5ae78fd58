"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from binned features of itself and of the lines before and after;
neighbouring labels have a transition score. Forward-backward gives each line's probability of being good, and
a document's quality is their mean weighted by line length. Only documents have labels, lines have none: so a label
says that the share of a document's length that is good is at least SHARE[1], or at most SHARE[0]. Training
alternates (posterior regularisation): the field's own distribution over line labels is tilted, document by
document, just so far that this holds (`tilts`, by bisection); then the weights move towards the tilted distribution, with forward-
backward gradients of the conditional likelihood. Good and bad lines of one document can thus be told apart. The sample of labelled
documents is bounded: SAMPLE_DOCS in order of a hash of the id, each of at most SAMPLE_LINES lines. Held-out documents, ids with crc32(id) mod 4 = 2, are never learned
from. Labels, language, source and id are not features.

Cases. A null or empty text is one line of length 0, of weight 1. A very long text is one task's as a whole; one of over SAMPLE_LINES lines isn't learned from. Labels other than 0 and 1, null labels and
labels without document are passed over; without labels of both kinds all scores are 0.5. Repeated rows each give
a row; extra columns are kept by keep_good() and not read by score(). Equal scores need no order.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, words

SAMPLE_DOCS, SAMPLE_LINES, STEPS, TILT_STEPS, BINS, GOOD = 4000, 500, 150, 15, 8, 0.7
#: The good share of the length of a document labelled 0, at most, and of one labelled 1, at least.
SHARE = (0.3, 0.98)
_RUN = (1 << 20) - 4096
#: Edges of the bins of each feature of a line, in the order of measure() (parameters of this model).
EDGES = {
    "length": (1, 20, 60, 150, 400, 1000, 3000), "upper": (0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8), "digit": (0.001, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5), "space": (0.05, 0.1, 0.13, 0.16, 0.2, 0.25, 0.35),
    "stop": (0.001, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15), "symbol": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35), "high": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.5), "word": (2, 3, 4, 5, 7, 9, 14), "again": (0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8), "copies": (2, 3, 4, 6, 9, 15, 30),
}
NEIGHBOUR = ("length", "upper", "symbol", "copies", "digit")
N_FEATURES = (len(EDGES) + 2 * len(NEIGHBOUR)) * (BINS + 1) + 1
_KIND = np.full(256, 5, dtype=np.uint8)  # 0 other letters, 1 upper, 2 digit, 3 space, 4 stop, 5 symbol, 6 non-ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 13, 32]], _KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]], _KIND[128:] = 0, 1, 2, 3, 4, 6


def lines(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line starts and ends, and each text's first line (len + 1); a text always has a line."""
    breaks = np.flatnonzero(buf == 10)
    before = np.searchsorted(breaks, at)
    first = before + np.arange(len(at))
    start = np.empty(len(breaks) + len(at) - 1, dtype=np.int64)
    end = np.empty_like(start)
    text = np.searchsorted(at, breaks, side="right") - 1
    start[first[:-1]] = at[:-1]
    start[np.arange(len(breaks)) + text + 1] = breaks + 1
    end[np.arange(len(breaks)) + text] = breaks
    end[first[1:] - 1] = at[1:]
    return start, end, first


def measure(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of every line (a row each), line lengths, each text's first line."""
    start, end, first = lines(buf, at)
    size = end - start
    whole = np.maximum(size, 1)
    kind = _KIND[buf]
    share = {}
    for k, name in enumerate(("upper", "digit", "space", "stop", "symbol", "high"), 1):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        share[name] = (total[end] - total[start]) / whole
    sums = words.prefix_hash(buf)
    w_start, w_end, _ = words.spans(buf, at, words.NONSPACE)
    h = words.span_hash(sums, w_start, w_end) if len(w_start) else np.zeros(0, np.uint64)
    lo, hi = np.searchsorted(w_start, start), np.searchsorted(w_start, end)
    same = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 2:
        same[1:-1] = h[1:] == h[:-1]
        same[2:-1] |= h[2:] == h[:-2]
    same = np.concatenate([[0], np.cumsum(same[: len(h)])])
    n_words = np.maximum(hi - lo, 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = words.chain(words.span_hash(sums, start, end), text.astype(np.uint64))
    _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
    values = {"length": size, **share, "word": size / n_words, "again": (same[hi] - same[lo]) / n_words, "copies": np.where(size > 0, count[place], 1)}
    bins = {k: np.searchsorted(np.array(EDGES[k], dtype=float), v, side="right") for k, v in values.items()}
    columns = [bins[k] for k in EDGES]
    for shift in (1, -1):
        edge = np.zeros(len(size), dtype=bool)
        edge[first[:-1] if shift == 1 else first[1:] - 1] = True
        columns += [np.where(edge, BINS, np.roll(bins[k], shift)) for k in NEIGHBOUR]
    index = np.stack([*(c + k * (BINS + 1) for k, c in enumerate(columns)), np.full(len(size), N_FEATURES - 1)], axis=1)
    return index.astype(np.int32), size, first


def forward_backward(node: np.ndarray, step: np.ndarray, first: np.ndarray, expect: bool = False):
    """Probability of "good" for each line; with expect also the log partition sum and the expected transitions.

    node: score of "good" against "bad" for each line; step: 2 x 2 transition scores. All texts advance together.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, size = first[:-1][order], n[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else np.zeros(0, np.int64)
    a = np.zeros((len(node), 2))
    a[begin, 1] = node[begin]
    for t in range(1, len(live)):
        m = begin[: live[t]]
        p = a[m + t - 1]
        a[m + t, 0] = np.logaddexp(p[:, 0] + step[0, 0], p[:, 1] + step[1, 0])
        a[m + t, 1] = np.logaddexp(p[:, 0] + step[0, 1], p[:, 1] + step[1, 1]) + node[m + t]
    b = np.zeros_like(a)
    for t in range(len(live) - 1, 0, -1):
        m = begin[: live[t]]
        q0, q1 = b[m + t, 0], b[m + t, 1] + node[m + t]
        b[m + t - 1, 0] = np.logaddexp(step[0, 0] + q0, step[0, 1] + q1)
        b[m + t - 1, 1] = np.logaddexp(step[1, 0] + q0, step[1, 1] + q1)
    last = first[1:] - 1
    z = np.logaddexp(a[last, 0], a[last, 1])
    each = np.repeat(z, n)
    good = np.exp(a[:, 1] + b[:, 1] - each)
    if not expect:
        return good
    later = np.ones(len(node), dtype=bool)
    later[first[:-1]] = False
    k = np.flatnonzero(later)
    pairs = np.array([[np.exp(a[k - 1, i] + step[i, j] + b[k, j] + j * node[k] - each[k]).sum() for j in (0, 1)] for i in (0, 1)])
    return good, z, pairs


def shares(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The good share of each text's length."""
    weight = np.maximum(size, 1)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def tilts(node: np.ndarray, step: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """What must be added to each line's score (its share of the length times a number of its document's) so that SHARE holds."""
    n = np.diff(first)
    weight = np.maximum(size, 1) / np.repeat(np.add.reduceat(np.maximum(size, 1), first[:-1]), n) * np.repeat(n, n)
    target = np.where(label == 1, SHARE[1], SHARE[0])
    sign = np.where(label == 1, 1.0, -1.0)
    meets = lambda x: sign * (shares(forward_backward(node + np.repeat(sign * x, n) * weight, step, first), size, first) - target) >= 0
    low, high = np.zeros(len(n)), np.full(len(n), 30.0)
    free = meets(low)
    for _ in range(12):
        middle = (low + high) / 2
        enough = meets(middle)
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return np.repeat(np.where(free, 0.0, sign * high), n) * weight


def train(index: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features, transitions) of greatest penalised likelihood under the documents' labels, by Adam."""
    w, step = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len(set(label.tolist())) < 2:
        return w, step
    weight = 1 / max(1, len(size))
    counts = lambda good: np.bincount(index.reshape(-1), weights=np.repeat(good, index.shape[1]), minlength=N_FEATURES)
    m = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    v = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    for t in range(1, steps + 1):
        node = w[index].sum(axis=1)
        if t % TILT_STEPS == 1:
            wanted, _, moves = forward_backward(node + tilts(node, step, size, first, label), step, first, True)
            seen = counts(wanted)
        good, _, pairs = forward_backward(node, step, first, True)
        g = [(counts(good) - seen) * weight + 1e-4 * w, (pairs - moves) * weight + 1e-3 * step]
        for k, x in enumerate((w, step)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            x -= 0.15 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w, step


def line_labels(text: str | None, w: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The probability of being good of each line of a text."""
    index, _, first = measure(*words.buffers(pa.array([text], pa.string())))
    return forward_backward(w[index].sum(axis=1), step, first)


def qualities(column: pa.Array, w: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A score from 0 to 1 for each text."""
    buf, at = words.buffers(column)
    out = []
    for lo, hi in words.runs(at, _RUN):
        index, size, first = measure(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        good = forward_backward(w[index].sum(axis=1), step, first)
        out.append(shares(good, size, first))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def held_out(id_: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % modulus == remainder


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, from at most sample_docs labelled documents that are not held out."""
    blocks.prepare(docs.sparkSession)
    label = F.col(label_col).cast("double")
    usable = labels.select(F.col(id_col).alias("_id"), label.alias("_label")).where(F.col("_label").isin(0.0, 1.0) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_docs)  # at most sample_docs rows, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    sized = texts.select("_id", F.col("_label").cast("int").alias("_label"), "_text")

    def run(batches):
        for batch in batches:
            few = [(t.as_py() or "").count("\n") < SAMPLE_LINES for t in batch.column(2)]
            batch = batch.filter(pa.array(few, pa.bool_()))
            buf, at = words.buffers(batch.column(2))
            index, size, first = measure(buf, at)
            parts = [pickle.dumps((index[a:b].astype(np.uint16), size[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(parts, pa.binary())], names=["id", "label", "index"])

    rows = sorted(tuple(r) for r in sized.select("_id", "_label", "_text").mapInArrow(run, "id string, label int, index binary").collect())
    if not rows:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    parts = [pickle.loads(r[2]) for r in rows]
    size = np.concatenate([p[1] for p in parts])
    return train(np.concatenate([p[0] for p in parts]).astype(np.int32), size, np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])]), np.array([r[1] for r in rows]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) of every document."""
    w, step = fit(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            q = qualities(batch.column(2), w, step)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q), pa.array((q >= GOOD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    picked = docs.select(id_col, held_out(F.col(id_col)).alias("_held_out"), text_col)
    return picked.mapInArrow(blocks.tidy_batches(run), f"{docs.select(id_col).schema.simpleString()[7:-1]}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs, all columns, without the documents that score under GOOD."""
    w, step = fit(docs, labels, id_col, text_col, label_col)
    k = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(qualities(batch.column(k), w, step) >= GOOD))

    return docs.mapInArrow(blocks.tidy_batches(run), docs.schema)
