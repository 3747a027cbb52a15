"""Quality classifier: histogram gradient-boosted trees over document statistics.

The driver fits small trees of one depth on the statistics of a bounded,
labelled sample. They are flattened into arrays (feature, threshold, leaf by
tree and node), so a task scores a batch of texts with depth array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.llm.columns import Passing
from lithospark.llm.textkernel import U64, slices, space_words, text_buffer

#: Bytes of text whose statistics are taken at once; they take many times that in memory.
SLICE = 1 << 20
#: Labelled rows that are fitted, at most: those with the least hash of their id.
MAX_TRAIN = 20_000
DEPTH, TREES, RATE, BINS, LAMBDA = 4, 80, 0.2, 64, 1.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|",
    "mark": b"*#%$&@^~=+_",
    "bracket": b"()[]{}<>/\\\"'`-",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
}
FEATURES = [
    "log_bytes", "log_words", *(f"{c}_share" for c in _CLASSES), "other_share", "word_bytes", "distinct_share", "top_share", "again_share", "pair_share",
    "cased_share", "short_share", "long_share", "marked_share", "line_words", "line_distinct_share",
]

_KIND = np.full(256, len(_CLASSES), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _KIND[list(_bytes)] = _i


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty one has zeros."""
    n, kinds = len(offsets) - 1, len(_CLASSES) + 1
    words = space_words(fold=False)
    starts, ends, first = words.split(data, offsets)
    hashes = words.hashes(data, starts, ends)
    size, count = np.diff(offsets).astype(float), np.diff(first).astype(float)
    some, many = np.maximum(size, 1), np.maximum(count, 1)
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(of_byte * kinds + _KIND[data], minlength=n * kinds).reshape(n, kinds) / some[:, None]
    text = np.repeat(np.arange(n), np.diff(first))
    mean = lambda x: np.bincount(text, x, minlength=n) / many
    length = (ends - starts).astype(float)
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(t)))
    top = np.zeros(n)
    np.maximum.at(top, t[at], runs)
    pair_text = text[1:][text[1:] == text[:-1]]
    pairs = (hashes[:-1] * U64(3) ^ hashes[1:])[text[1:] == text[:-1]] if len(text) else hashes
    again = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    frame = pd.DataFrame({"t": pair_text, "p": pairs}).drop_duplicates()
    # Lines, by their last word's end and their words' hashes.
    breaks = np.searchsorted(starts, np.flatnonzero(data == 10))
    begin = np.unique(np.concatenate([first[:-1], breaks]))
    begin = begin[begin < len(starts)]
    line_of = text[begin]
    totals = np.concatenate([[U64(0)], np.cumsum(hashes, dtype=U64)])
    line_hash = totals[np.append(begin[1:], len(starts))] - totals[begin]
    lines = np.bincount(line_of, minlength=n).astype(float)
    distinct = pd.DataFrame({"t": line_of, "h": line_hash}).drop_duplicates()
    initial = data[starts] if len(starts) else np.zeros(0, np.uint8)
    final = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    out = np.column_stack([
        np.log1p(size), np.log1p(count), shares, mean(length), np.bincount(t[at], minlength=n) / many, top / many,
        np.bincount(text[1:][again] if len(text) else text, minlength=n) / many, np.bincount(frame.t, minlength=n) / many,
        mean((initial >= 65) & (initial <= 90)), mean(length == 1), mean(length > 24), mean((final >= 5) & (final <= 8)),
        count / np.maximum(lines, 1), np.bincount(distinct.t, minlength=n) / np.maximum(lines, 1),
    ])
    out[size == 0] = 0
    return out.astype(np.float32)


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, from 0 to 1."""
        raw = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
                for _ in range(DEPTH):
                    node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
                raw[a : a + 4096] += self.leaf[tree, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels 0 and 1; without both labels the share of ones (0.5 without any row)."""
    inner = 2**DEPTH - 1
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    raw = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        cut, node = np.full(inner, BINS), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                key = (node - first) * BINS + codes[:, f]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + LAMBDA) + (gt - gs) ** 2 / (ht - hs + LAMBDA) - gt**2 / (ht + LAMBDA)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                gain = gain[:, : len(cuts[f])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    value = gain[np.arange(width), k]
                    for w in np.flatnonzero(value > best):
                        best[w] = value[w]
                        feature[first + w], threshold[first + w], cut[first + w] = f, cuts[f][k[w]], k[w]
            node = 2 * node + 1 + (codes[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + LAMBDA)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def _score(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                columns = {c: batch.column(c) for c in batch.schema.names}
                columns["score"] = pa.array(model.value.score(statistics(*text_buffer(batch.column(text)))), pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body", SLICE):
            x = statistics(*text_buffer(batch.column("body")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], ["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Trees fitted on at most max_train labelled rows, those with the least hash of key.

    held_out is a condition over key; rows for which it holds are never fitted.
    Rows with a null key or label take no part. The sample is bounded, so it is
    broadcast to the documents; only statistics come to the driver.
    """
    chosen = (
        labels.select(F.col(key).alias(key), F.col(label).cast("int").alias("label"))
        .where(F.col(key).isNotNull() & F.col("label").isin(0, 1) & ~held_out)
        .orderBy(F.xxhash64(key), key, "label")
        .limit(max_train)
    )
    rows = docs.select(F.col(key), F.col(text).alias("body")).join(F.broadcast(chosen), key).select("label", "body")
    sample = rows.mapInArrow(_measure, "label int, x array<float>").toArrow()
    y = sample.column("label").to_numpy().astype(float)
    x = np.array(sample.column("x").to_pylist(), np.float32).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1.

    Null and empty texts have zero statistics and get a score like others. All
    rows and columns stay; a column of docs named score is replaced.
    """
    passing = Passing(docs, ["score"])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passing.df.schema.fields)
    return passing.restored(passing.df.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), passing[text]), f"{schema}score double"))
