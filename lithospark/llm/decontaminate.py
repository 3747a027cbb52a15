"""Benchmark decontamination by Wu-Manber search over words.

The windows of the benchmark are the patterns. For each pattern length a shift
table over hashed blocks of BLOCK words tells how far the search may move on
from an end position; where it says 0, the hash of the window selects among the
patterns with that suffix block, and the words themselves are compared. A task
moves many search positions (one per LANE words of text) through the table in
step, so most words are never looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.columns import Passing
from lithospark.llm.textkernel import U64, alnum_words, lower_ascii, mix64, slices, stream, text_buffer
from lithospark.session import cut

LANE = 64
BLOCK = 2
TABLE_BITS = 20
#: Bytes of benchmark text that one pass over the documents looks for.
PASS_BYTES = 1 << 20


class Patterns:
    """The windows of some benchmark items, ready for the search."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        words = alnum_words(fold=True)
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        starts, ends, first = words.split(data, offsets)
        hashes = words.hashes(data, starts, ends)
        compact, at = _compact(data, starts, ends, words.mask)
        self.ids = ids
        found: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        for item in range(len(ids)):
            a, b = int(first[item]), int(first[item + 1])
            m = min(window, b - a)
            for i in range(a, b - m + 1) if m else ():
                key = (int(_window(hashes, np.array([i]), m)[0]), _words(compact, at, i, m))
                found.setdefault(m, {}).setdefault(key, []).append(item)
        #: By length: shift table, sorted window hashes, and what each stands for.
        self.groups = []
        for m, windows in sorted(found.items()):
            block = min(BLOCK, m)
            shift = np.full(1 << TABLE_BITS, m - block + 1, np.uint8)
            keys = sorted(windows, key=lambda k: k[0])
            positions = [i for item in range(len(ids)) for i in range(int(first[item]), int(first[item + 1]) - m + 1) if min(window, int(first[item + 1] - first[item])) == m]
            if positions:
                at_ = np.array(positions)
                for j in range(block, m + 1):
                    np.minimum.at(shift, _slot(hashes, at_ + j - 1, block), m - j)
            self.groups.append((m, block, shift, np.array([k[0] for k in keys], U64), [k[1] for k in keys], [sorted(set(windows[k])) for k in keys]))


def _window(hashes: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    factors = stream(7, m) | U64(1)
    total = np.full(len(begin), U64(m), U64)
    for j in range(m):
        total += hashes[begin + j] * factors[j]
    return mix64(total)


def _slot(hashes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    value = hashes[last]
    if block > 1:
        value = value + hashes[last - 1] * U64(0x9E3779B97F4A7C15)
    return (value * U64(0xD1342543DE82EF95)) >> U64(64 - TABLE_BITS)


def _compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of all words in a row, and where each begins."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return lower_ascii()[data[mask[data] > 0]], at


def _words(compact: np.ndarray, at: np.ndarray, i: int, m: int) -> bytes:
    """What makes two windows equal: the lengths of their words and the bytes."""
    return np.diff(at[i : i + m + 1]).tobytes() + compact[at[i] : at[i + m]].tobytes()


def search(patterns: Patterns, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, list[int]]]]:
    """Each text's first word, the words hit, and the hits: (length, begins, entries) by length."""
    words = alnum_words(fold=True)
    starts, ends, first = words.split(data, offsets)
    hashes = words.hashes(data, starts, ends)
    hit = np.zeros(len(starts) + 1, np.int32)
    items: list[tuple[int, int]] = []
    compact = None
    counts = np.diff(first)
    for m, block, shift, keys, exact, owners in patterns.groups:
        # Lanes: runs of LANE end positions inside a text.
        lanes = np.maximum(0, -(-(counts - m + 1) // LANE))
        text = np.repeat(np.arange(len(counts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[text] + m - 1 + nth * LANE
        stop = np.minimum(at + LANE, first[text + 1])
        candidates = []
        while len(at):
            move = shift[_slot(hashes, at, block)]
            if (zero := at[move == 0]).size:
                candidates.append(zero)
            at = at + np.maximum(move, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not candidates:
            continue
        begin = np.concatenate(candidates) - m + 1
        value = _window(hashes, begin, m)
        low = np.searchsorted(keys, value, "left")
        high = np.searchsorted(keys, value, "right")
        some = high > low
        if not some.any():
            continue
        if compact is None:
            compact, place = _compact(data, starts, ends, words.mask)
        for i, a, b in zip(begin[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            there = _words(compact, place, i, m)
            for k in range(a, b):
                if exact[k] == there:
                    hit[i] += 1
                    hit[i + m] -= 1
                    items += [(i, item) for item in owners[k]]
    return first, np.cumsum(hit[:-1]) > 0, items


SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))


def _found(patterns: Patterns, column: pa.Array) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """For each text its number of words, its runs of hit words, and the ids of the items."""
    first, hit, items = search(patterns, *text_buffer(column))
    n = len(column)
    by_text: list[set[str]] = [set() for _ in range(n)]
    for t, (_, item) in zip((np.searchsorted(first, [i for i, _ in items], "right") - 1).tolist(), items, strict=True):
        if patterns.ids[item] is not None:
            by_text[t].add(patterns.ids[item])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        t = int(np.searchsorted(first, a, "right")) - 1
        while a < b:  # hits of neighbouring texts touch here
            c = min(b, int(first[t + 1]))
            if c > a:
                spans[t].append({"first_word": a - int(first[t]), "end_word": c - int(first[t])})
            a, t = c, t + 1
    return np.diff(first), spans, [sorted(x) for x in by_text]


def _hits(patterns, passes: int):
    """(text, pass, spans, items) of the texts that hold patterns of this pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                _, spans, items = _found(patterns.value, batch.column("body"))
                some = [t for t, x in enumerate(spans) if x]
                columns = [batch.column("k").take(pa.array(some, pa.int64())), pa.array([passes] * len(some), pa.int32()), pa.array([spans[t] for t in some], SPANS), pa.array([items[t] for t in some], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "pass", "spans", "items"])

    return run


def _added(patterns, text: str, others: list[str]):
    """Rows with what was found in them: by patterns, or by earlier passes (told)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = alnum_words(fold=True)
        for whole in batches:
            for batch in slices(whole, text):
                if patterns is not None:
                    count, spans, items = _found(patterns.value, batch.column(text))
                else:
                    count = np.diff(words.split(*text_buffer(batch.column(text)))[2])
                    told = [x or [] for x in batch.column("told").to_pylist()]
                    spans = [merged([s for x in t for s in x["spans"]]) for t in told]
                    items = [sorted({i for x in t for i in x["items"]}) for t in told]
                hits = [sum(s["end_word"] - s["first_word"] for s in x) for x in spans]
                columns = [*(batch.column(c) for c in others), pa.array(count, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "n_hit", "hit_spans", "items"])

    return run


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first_word"]):
        if out and s["first_word"] <= out[-1]["end_word"]:
            out[-1]["end_word"] = max(out[-1]["end_word"], s["end_word"])
        else:
            out.append(dict(s))
    return out


SPAN_LIST = "array<struct<first_word: long, end_word: long>>"
ADDED = f"n_words long, n_hit long, hit_spans {SPAN_LIST}, items array<string>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """docs with n_words, n_hit, hit_spans and items (ids, sorted as strings).

    Null texts have no words. Items with a null id mark words but are not
    named; items without words match nothing; repeated items count once.
    Benchmark text goes to the tasks in blocks of PASS_BYTES (or one item). One
    block is searched for in passing. Of a larger benchmark each block has a pass
    of its own over the documents, which ends, with its patterns, before the next
    begins, and keeps what it found of each different text; so a large benchmark
    costs passes, not memory. An empty benchmark or an empty table give zeros or
    no rows. Columns of docs that are named like the added ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    passing = Passing(docs, ["n_words", "n_hit", "hit_spans", "items"])
    body = passing[text]
    others = passing.inner
    schema = passing.schema() + ADDED
    rows = passing.df.select(*others) if body in others else passing.df.select(*others, body)
    texts = passing.df.select(F.xxhash64(body, F.octet_length(body)).alias("k"), F.col(body).alias("body"))
    blocks = _blocks(benchmark.selectExpr(f"cast(`{item}` as string) as id", f"coalesce(`{item_text}`, '') as body"))
    ids, bodies = next(blocks)
    following = next(blocks, None)
    if following is None:
        return passing.restored(rows.mapInArrow(_added(context.broadcast(Patterns(ids, bodies, window)), body, others), schema))
    found, passes = None, 0
    while True:
        shared = context.broadcast(Patterns(ids, bodies, window))
        hits = cut(texts.mapInArrow(_hits(shared, passes), f"k long, pass int, spans {SPAN_LIST}, items array<string>").groupBy("k", "pass").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
        if following is None:
            break
        (ids, bodies), following, passes = following, next(blocks, None), passes + 1
    told = found.groupBy("k").agg(F.collect_list(F.struct("spans", "items")).alias("told"))  # one for each pass at most
    keyed = rows.withColumn("k", F.xxhash64(body, F.octet_length(body))).join(told, "k", "left").drop("k")
    return passing.restored(keyed.mapInArrow(_added(None, body, others), schema))


def _blocks(rows: DataFrame) -> Iterator[tuple[list[str | None], list[str]]]:
    """Ids and texts of the benchmark, PASS_BYTES at a time; at least one block, which may be empty."""
    ids: list[str | None] = []
    texts: list[str] = []
    size = 0
    for row in rows.toLocalIterator():
        if ids and size + len(row.body) > PASS_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.body)
        size += len(row.body)
    yield ids, texts
