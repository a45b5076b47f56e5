"""Quality classifier: a linear-chain conditional random field over lines.

Every line with words is labelled good or bad.  A line's features are shares of
byte classes, word lengths and repeats within the text, each cut into bins; the
model weighs the bins of the line and of the lines before and after it, and the
step from label to label.  The score of a document is the mean of its lines'
forward-backward marginals for good, weighted by their bytes.

The model is fitted on at most MOST_ROWS labelled rows (those of the smallest
hash of doc_id among the rows with crc32(doc_id) mod 5 <> 0), in that order up
to the document that reaches MOST_LINES lines, each line carrying its
document's label.  Scoring reads whole
texts of all rows; lang, source, labels and doc_id are no inputs of it.

Defined results: null and empty texts and texts without words score the share
of label 1 in the sample (0.5 without labels); null labels are left out and
repeated labels of a document count once, the lower one; a null doc_id has the
crc32 of an empty text; repeated rows are each scored; an empty table gives an
empty result; other columns are ignored or, in ``good_documents``, kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import or_empty, read_table, small_batches

MOST_ROWS, MOST_LINES = 4000, 200_000
BINS, STEPS, THRESHOLD = 8, 150, 0.3

_CLASS = np.zeros(256, np.uint8)  # 0: other bytes
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:", b"!?", b"'\"-()", b"|/\\<>{}[]_=~^", b"%$#&*@+`"), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 10
N_CLASSES = 11
N_FEATURES = N_CLASSES + 11


def line_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with words, the bytes of each, and each text's first such line (n + 1 numbers)."""
    data, offsets = W.text_bytes(column)
    begin, end, first_word = W.word_spans(data, offsets, W.SPACES)
    if not len(begin):
        return np.empty((0, N_FEATURES), np.float32), np.empty(0), np.zeros(len(offsets), np.int64)
    # A line begins at a text's start and after each line feed; those without words are passed over.
    breaks = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    line_of_word = np.searchsorted(breaks, begin, "right") - 1
    lines, word_line = np.unique(line_of_word, return_inverse=True)
    at, stop = breaks[lines], np.r_[breaks[1:], len(data)][lines]
    n = len(lines)
    text_of_word = np.searchsorted(first_word, np.arange(len(begin)), "right") - 1
    text_of_line = np.zeros(n, np.int64)
    text_of_line[word_line] = text_of_word
    first_line = np.searchsorted(text_of_line, np.arange(len(offsets)))

    slot = np.repeat(np.arange(len(breaks), dtype=np.int32), np.diff(np.r_[breaks, len(data)])) * np.int32(N_CLASSES) + _CLASS[data]
    counts = np.bincount(slot, minlength=len(breaks) * N_CLASSES).reshape(-1, N_CLASSES)[lines].astype(np.float64)
    size = np.maximum(1, stop - at).astype(np.float64)
    n_words = np.bincount(word_line, minlength=n).astype(np.float64)
    mean = lambda x: np.bincount(word_line, x, minlength=n) / n_words
    length = (end - begin).astype(np.float64)
    salt = W.mix(text_of_word.astype(np.uint64) + np.uint64(1))
    hashes = W.span_hashes(W._OF_BYTE[W.LOWER[data]], begin, end)
    last = _CLASS[data[end - 1]]

    def again(x: np.ndarray) -> np.ndarray:
        _, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
        return times[inverse] > 1

    repeated = again(hashes ^ salt)
    runs = np.zeros(len(hashes), bool)
    if len(hashes) > 3:
        runs[:-3] = again(W.window_hashes(hashes, 4) ^ salt[:-3])
    new = np.r_[True, word_line[1:] != word_line[:-1]]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(begin)]
    whole = again(W.span_hashes(hashes, heads, tails) ^ salt[heads])
    stays = np.r_[False, hashes[1:] == hashes[:-1]] & ~new
    short = np.bincount(word_line[np.unique(hashes ^ W.mix(word_line.astype(np.uint64)), return_index=True)[1]], minlength=n) / n_words
    extra = [
        np.log(size), np.log(n_words), mean(length), mean(length * length) - mean(length) ** 2, mean(repeated), mean(runs), whole, mean((last == 9) | (last == 8)), mean(last == 6), mean(stays), short,
    ]
    return np.concatenate([counts / size[:, None], np.stack(extra, 1)], 1).astype(np.float32), size, first_line


class Chain:
    """The CRF: bin edges, weights of the bins (line before, line, line after), steps and the prior."""

    def __init__(self, edges: np.ndarray, prior: float) -> None:
        self.edges, self.prior = edges, prior
        self.weights = np.zeros(3 * (edges.shape[0] * BINS + 1))
        self.steps = np.zeros((2, 2))

    def active(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indices of the active weights of each line; at a text's borders the last of each third says so."""
        n, k = features.shape
        own = np.empty((n, k), np.int32)
        for j in range(k):
            own[:, j] = j * BINS + np.searchsorted(self.edges[j], features[:, j], "right")
        third, none = k * BINS + 1, k * BINS
        before, after = np.full((n, k), none, np.int32), np.full((n, k), none, np.int32)
        before[1:], after[:-1] = own[:-1], own[1:]
        starts = first[:-1][first[:-1] < first[1:]]
        before[starts] = none
        after[first[1:][first[:-1] < first[1:]] - 1] = none
        return np.concatenate([before, own + third, after + 2 * third], 1)

    def emissions(self, active: np.ndarray) -> np.ndarray:
        out = np.zeros(len(active))
        for j in range(active.shape[1]):
            out += self.weights[active[:, j]]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None):
        """P(good) of each line, and with pairs (a weight for each text) the sum over neighbours of P(label, next label)."""
        sizes = np.diff(first)
        out, both = np.zeros(len(scores)), np.zeros((2, 2))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        k = 0
        while k < len(order):
            longest = int(sizes[order[k]])
            part = order[k : k + max(1, min(4096, (1 << 20) // longest))]
            part = part[sizes[part] * 2 >= longest] if longest > 8 else part
            k += len(part)
            n, at = sizes[part], first[:-1][part]
            live = [int(np.searchsorted(-n, -t, "left")) for t in range(longest)]  # texts of more than t lines
            e = np.zeros((longest, len(part), 2))
            for t, m in enumerate(live):
                e[t, :m, 1] = scores[at[:m] + t]
            a, b, s = np.zeros_like(e), np.zeros_like(e), self.steps
            a[0] = e[0]
            for t in range(1, longest):
                m = live[t]
                p = a[t - 1, :m]
                for y in (0, 1):
                    a[t, :m, y] = np.logaddexp(p[:, 0] + s[0, y], p[:, 1] + s[1, y]) + e[t, :m, y]
            for t in range(longest - 2, -1, -1):
                m = live[t + 1]
                q = b[t + 1, :m] + e[t + 1, :m]
                for x in (0, 1):
                    b[t, :m, x] = np.logaddexp(q[:, 0] + s[x, 0], q[:, 1] + s[x, 1])
            z = np.logaddexp(a[0, :, 0] + b[0, :, 0], a[0, :, 1] + b[0, :, 1])
            for t, m in enumerate(live):
                out[at[:m] + t] = np.exp(a[t, :m, 1] + b[t, :m, 1] - z[:m])
                if pairs is not None and t:
                    for x in (0, 1):
                        for y in (0, 1):
                            both[x, y] += pairs[part[:m]] @ np.exp(a[t - 1, :m, x] + s[x, y] + e[t, :m, y] + b[t, :m, y] - z[:m])
        return out if pairs is None else (out, both)

    def fit(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = 2e-4) -> None:
        """Maximise the conditional likelihood of the lines' labels by Adam; the lines of either label weigh the same in all."""
        active = self.active(features, first)
        sizes = np.diff(first)
        gold = np.repeat(labels, sizes).astype(np.float64)
        share = np.array([max(1.0, (gold == y).sum()) for y in (0, 1)])
        weight = (len(gold) / 2 / share)[labels]
        of_line = np.repeat(weight, sizes)
        total = max(1, len(gold))
        neighbours = np.maximum(0, sizes - 1) * weight
        seen = np.diag([neighbours[labels == 0].sum(), neighbours[labels == 1].sum()])
        moment = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros((2, 2)), np.zeros((2, 2))]
        for turn in range(1, steps + 1):
            p, both = self.marginals(self.emissions(active), first, pairs=weight)
            rest = (gold - p) * of_line
            slope = np.zeros_like(self.weights)
            for j in range(active.shape[1]):
                slope += np.bincount(active[:, j], rest, minlength=len(slope))
            for k, (x, g) in enumerate(((self.weights, slope), (self.steps, seen - both))):
                g = g / total - ridge * x
                moment[2 * k] = 0.9 * moment[2 * k] + 0.1 * g
                moment[2 * k + 1] = 0.999 * moment[2 * k + 1] + 0.001 * g * g
                x += 0.05 * (moment[2 * k] / (1 - 0.9**turn)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.999**turn)) + 1e-8)

    def score(self, column) -> np.ndarray:
        """Quality of each text of an Arrow column without nulls."""
        features, size, first = line_features(column)
        out = np.full(len(first) - 1, self.prior)
        if not len(features):
            return out
        good = self.marginals(self.emissions(self.active(features, first)), first)
        of = np.repeat(np.arange(len(out)), np.diff(first))
        have = np.diff(first) > 0
        out[have] = (np.bincount(of, good * size, minlength=len(out)) / np.maximum(1, np.bincount(of, size, minlength=len(out))))[have]
        return np.clip(out, 0.0, 1.0)


def held_out() -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame) -> Chain:
    """The model from the bounded sample of labelled rows that are not held out."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    sample = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS).withColumn("turn", F.xxhash64("doc_id"))

    def run(batches):
        for batch in W.batches_of(batches):
            features, _, first = line_features(batch.column("text"))
            cut = [features[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("label"), pa.array(cut, pa.binary())], ["turn", "label", "lines"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text")).join(F.broadcast(sample), "doc_id")  # MOST_ROWS rows of two numbers
    rows = chosen.mapInArrow(run, "turn long, label int, lines binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["turn"], r["lines"]))
    lines, first, marks, total = [], [0], [], 0
    for r in rows:
        x = np.frombuffer(r["lines"], np.float32).reshape(-1, N_FEATURES)
        if total >= MOST_LINES:  # whole documents in the order of their hashes, so none is passed over for its length
            break
        if len(x):
            lines.append(x)
            total += len(x)
            first.append(total)
            marks.append(int(r["label"] != 0))
    if not lines:
        return Chain(np.zeros((N_FEATURES, BINS - 1)), float(np.mean([r["label"] != 0 for r in rows])) if rows else 0.5)
    features = np.concatenate(lines)
    model = Chain(np.quantile(features, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32), float(np.mean(marks)))
    model.fit(features, np.array(first), np.array(marks))
    return model


def scored(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    import pyarrow as pa

    def run(batches):
        for batch in W.batches_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns, that score the threshold or more."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in W.batches_of(batches):
            yield batch.filter(pa.array(model.score(pc.fill_null(batch.column("text"), "")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return scored(docs, fitted(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"])))
