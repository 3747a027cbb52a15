"""Removal of repeated passages, with fixed-block anchors.

Anchors are the non-overlapping blocks of window/2 words of every document; the
probes are all rolling blocks of that length. A repeated window holds a whole
anchor of its other occurrence, so only windows near a block that is an anchor
somewhere and occurs more than once can be repeats. Batches of text ask the
parts of hash space which of their blocks are such hits; a block that a batch
holds more than once is asked for once.

Blocks are sent in passes over hash space, so a pass sends about a third of all;
their owners travel as places in the batch.

Hits are extended to windows: near them every window is hashed, and batches ask
where it starts first (the least id, then the least position); each sends the
first start it has. Windows that start earlier elsewhere are repeats;
overlapping ones together are the maximal repeats, and their words go. Only
documents with hits travel for that, and documents without repeats stay where
they are; long texts are worked on in pieces.

A window is told by its part and a 64-bit hash that is independent of the part;
parts grow with the data, so chance matches stay as rare at any size. Documents
are told by a 64-bit hash of their key and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.columns import Passing
from lithospark.llm.parts import cut_parts, joined, low, owned_rows, part_count, part_of, places, steps
from lithospark.llm.textkernel import U64, Piece, grams, pieces, space_words
from lithospark.session import cut

WORD_BYTES = 6
#: Passes over the blocks, each about its share of hash space; parts that a pass has at least.
PASSES, PASS_PARTS = 3, 16
#: Bytes of text for each file of a checkpoint. On a local file system each file costs some processes.
FILE_BYTES = 1 << 24
LAST = 2**63 - 1
#: Hashes of documents that may be broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 1_000_000


def _inside(piece: Piece, size: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Begins of rolling blocks that lie within a text, and the texts (of the piece); whole texts of less than least words have none."""
    count = np.diff(piece.first)
    here = np.maximum(count - size + 1, 0)
    if piece.last and not piece.base:
        here[count < least] = 0
    text = np.repeat(np.arange(len(here)), here)
    return piece.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(here) - here, here), text


def fold(part: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """32 bits of a block's part and lower bits, to know it again near by. The lowest bit of those marks anchors."""
    return (lower & np.uint32(0xFFFFFFFE)) ^ (part.astype(np.uint32) * np.uint32(0x9E3779B1))


def by_run(owner: np.ndarray, *values: np.ndarray) -> tuple[bytes, bytes, list[bytes]]:
    """Owners of runs, lengths of runs, and the values in that order."""
    order = np.argsort(owner, kind="stable")
    o = owner[order]
    change = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    return o[change].tobytes(), np.diff(np.append(change, len(o))).astype(np.uint32).tobytes(), [v[order].tobytes() for v in values]


ASKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("base", pa.int64()), *((c, pa.binary()) for c in ("names", "low", "high", "tokens", "multi"))])
OFFER = "part int, batch long, base long, names binary, low binary, high binary, tokens binary, multi binary"


def _offer(window: int, parts: int, begin: int, end: int):
    """Block hashes for the parts from begin to end; the lowest bit marks anchors. Blocks repeated in a batch are hits at once.

    Owners are places in the batch. One row names its documents, with the hits
    known at once; it goes to any part and comes back as it is.
    """
    size = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = space_words(fold=False), TaskContext.get().partitionId() << 32
        for whole in batches:
            ids = whole.column("k").to_numpy()
            for piece in pieces(words, whole.column("body"), size - 1):
                at, text = _inside(piece, size, window)
                if not len(at):
                    continue
                blocks = grams(words.hashes(piece.data, piece.starts, piece.ends), size, 11)[at]
                part = part_of(blocks, parts)
                now = np.flatnonzero((part >= begin) & (part < end))
                if not len(now):
                    continue
                number += 1
                at, text, blocks = at[now], text[now], blocks[now]
                named, owner = np.unique(text, return_inverse=True)
                anchor = (piece.base + at - piece.first[text]) % size == 0
                tokens = (blocks & U64(0xFFFFFFFFFFFFFFFE)) | anchor.astype(U64)
                bare = tokens & U64(0xFFFFFFFFFFFFFFFE)
                order = np.argsort(bare, kind="stable")
                sorted_ = bare[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                runs = np.diff(np.append(first, len(sorted_)))
                repeated = np.empty(len(tokens), bool)
                repeated[order] = np.repeat(runs > 1, runs)
                many = (sorted_[first] | np.maximum.reduceat(anchor[order].astype(U64), first))[runs > 1]
                hit = tokens[repeated]
                rows = [(begin + number * 7919 % (end - begin), number, piece.base, ids[piece.begin : piece.end][named].tobytes(), *steps(owner[repeated]), b"", fold(part_of(hit, parts), low(hit)).tobytes())]
                order, edge = cut_parts(many, parts)
                multi = {p: low(many[order[edge[p] : edge[p + 1]]]).tobytes() for p in np.flatnonzero(np.diff(edge)).tolist()}
                singles, owner = tokens[~repeated], owner[~repeated]
                order, edge = cut_parts(singles, parts)
                singles, owner = low(singles[order]), owner[order]
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    mine = slice(edge[p], edge[p + 1])
                    rows.append((p, number, piece.base, b"", *steps(owner[mine]), singles[mine].tobytes(), multi.pop(p, b"")))
                rows += [(p, number, piece.base, b"", b"", b"", b"", body) for p, body in multi.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ASKED, strict=True)], schema=ASKED)

    return run


ANSWER = "batch long, base long, names binary, low binary, high binary, keys binary"


def _hits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each row that asks, its blocks that are anchors somewhere and occur more than once."""
    part = np.int64(rows.part.iloc[0])
    tells = rows.names.str.len() > 0
    told, rows = rows[tells], rows[~tells]
    out = list(zip(told.batch, told.base, told.names, told.low, told.high, told.multi, strict=True))
    token, multi = joined(rows.tokens, np.uint32), joined(rows.multi, np.uint32)
    row = np.repeat(np.arange(len(rows)), rows.tokens.str.len().to_numpy() // 4)
    every = np.concatenate([token, multi])
    _, inverse = np.unique(every & np.uint32(0xFFFFFFFE), return_inverse=True)
    times = np.bincount(inverse, np.concatenate([np.ones(len(token)), np.full(len(multi), 2)]))
    anchors = np.bincount(inverse, every & np.uint32(1))
    live = ((times > 1) & (anchors > 0))[inverse[: len(token)]]
    row, owner, key = row[live], places(rows)[live], fold(part, token[live])
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    batch, base = rows.batch.to_numpy(), rows.base.to_numpy()
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(row)], strict=False):
        out.append((batch[row[a]], base[row[a]], b"", *steps(owner[a:b]), key[a:b].tobytes()))
    return pd.DataFrame(out, columns=["batch", "base", "names", "low", "high", "keys"])


def _keys(rows: pd.DataFrame) -> pd.DataFrame:
    """The hits of each document of a batch, from the answers to the batch."""
    names = joined(rows.names, np.int64)
    return _by_document(names[places(rows)], joined(rows["keys"], np.uint32), rows.base.iloc[0], "keys")


def split_told(rows: pd.DataFrame, asked: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows that only tell what their batch knows, and rows that ask."""
    told = (rows[asked].str.len() == 0) & (rows.runs.str.len() > 0)
    return rows[told], rows[~told]


def answered(rows: pd.DataFrame, row: np.ndarray, owner: np.ndarray, value: np.ndarray) -> list[tuple]:
    """For each of the rows that some values belong to: batch, base, and the values by owner."""
    order = np.argsort(row, kind="stable")
    row, owner, value = row[order], owner[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    batch, base, out = rows.batch.to_numpy(), rows.base.to_numpy(), []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(row)], strict=False):
        owners, runs, (values,) = by_run(owner[a:b], value[a:b])
        out.append((batch[row[a]], base[row[a]], owners, runs, values))
    return out


def _positions(rows: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of each document of a batch, from the answers to the batch."""
    owner = np.repeat(joined(rows.owners, np.int64), joined(rows.runs, np.uint32))
    return _by_document(owner, joined(rows.positions, np.uint32), rows.base.iloc[0], "positions")


def _by_document(owner: np.ndarray, value: np.ndarray, base: int, column: str) -> pd.DataFrame:
    """One row for each document of a batch that has values: (k, base, values)."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    change = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    keep = np.concatenate([[True], change])[: len(o)]
    o, v = o[keep], v[keep]
    edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])[: len(o)])
    return pd.DataFrame({"k": o[edge], "base": base, column: [x.tobytes() for x in np.split(v, edge[1:])][: len(edge)]})


def _each(rows: DataFrame, column: str) -> DataFrame:
    """(k, base, column): what each piece of a document has. Equal rows say the same in each batch, so any one stands."""
    return rows.groupBy("k", "base").agg(F.max(column).alias(column))


def _whole(rows: DataFrame, column: str) -> DataFrame:
    """(k, column as an array)."""
    return rows.groupBy("k").agg(F.collect_list(column).alias(column))


WINDOWS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("base", pa.int64()), *((c, pa.binary()) for c in ("owners", "ids", "runs", "hashes", "positions"))])


def _windows(window: int, parts: int, window_parts: int):
    """Hashes and positions of the windows near hits: of each the first in the batch; later ones are repeats at once."""
    size = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = space_words(fold=False), TaskContext.get().partitionId() << 32
        for whole in batches:
            ks, orders = whole.column("k").to_numpy(), whole.column("id").to_numpy()
            keys = whole.column("keys")
            for piece in pieces(words, whole.column("body"), window - 1):
                hashes = words.hashes(piece.data, piece.starts, piece.ends)
                at, text = _inside(piece, size)
                begin, of = _inside(piece, window)
                if not len(begin):
                    continue
                blocks = grams(hashes, size, 11)[at]
                folded = fold(part_of(blocks, parts), low(blocks))
                near = np.zeros(len(hashes) + 1, np.int64)
                edge = np.searchsorted(text, np.arange(piece.end - piece.begin + 1))
                for t, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    near[at[a:b] + 1] = np.isin(folded[a:b], joined(keys[piece.begin + t].as_py(), np.uint32))
                near = np.cumsum(near)
                close = near[begin + window - size + 1] > near[begin]
                begin, of = begin[close], of[close]
                if not len(begin):
                    continue
                number += 1
                where, told = grams(hashes, window, 12)[begin], grams(hashes, window, 13)[begin]
                position = (begin - piece.first[of] + piece.base).astype(np.uint32)
                k, id_ = ks[piece.begin : piece.end][of], orders[piece.begin : piece.end][of]
                order = np.lexsort((position, k, id_))
                where, told, position, k, id_ = where[order], told[order], position[order], k[order], id_[order]
                _, earliest, inverse = np.unique(told, return_index=True, return_inverse=True)
                lead = earliest[inverse]
                rows = []
                # The same start in a repeated row is no later one.
                same = np.flatnonzero((k[lead] != k) | (position[lead] != position))
                if len(same):
                    owners, runs, (positions,) = by_run(k[same], position[same])
                    rows.append((number * 7919 % window_parts, number, piece.base, owners, b"", runs, b"", positions))
                first = np.sort(earliest)
                for p, owners, runs, take in owned_rows(first, where[first], window_parts):
                    # Owners are places here, so each is a run of its own; those of one document are joined.
                    mine = first[take]
                    change = np.flatnonzero(np.concatenate([[True], k[mine][1:] != k[mine][:-1]]))
                    runs = np.diff(np.append(change, len(mine))).astype(np.uint32)
                    rows.append((p, number, piece.base, k[mine][change].tobytes(), id_[mine][change].tobytes(), runs.tobytes(), told[mine].tobytes(), position[mine].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), WINDOWS, strict=True)], schema=WINDOWS)

    return run


def _later(rows: pd.DataFrame) -> pd.DataFrame:
    """For each row that asks, the positions of windows that start earlier elsewhere."""
    told, rows = split_told(rows, "hashes")
    out = list(zip(told.batch, told.base, told.owners, told.runs, told.positions, strict=True))
    runs = joined(rows.runs, np.uint32)
    owner, id_ = np.repeat(joined(rows.owners, np.int64), runs), np.repeat(joined(rows.ids, np.int64), runs)
    value, position = joined(rows.hashes, U64), joined(rows.positions, np.uint32)
    row = np.repeat(np.arange(len(rows)), rows.hashes.str.len().to_numpy() // 8)
    order = np.lexsort((position, owner, id_, value))
    o, v, p = owner[order], value[order], position[order]
    begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    lead = np.repeat(begin, np.diff(np.append(begin, len(v))))
    later = (o != o[lead]) | (p != p[lead])
    out += answered(rows, row[order][later], o[later], p[later])
    return pd.DataFrame(out, columns=["batch", "base", "owners", "runs", "positions"])


SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))


def _strip(window: int, text: str, others: list[str]):
    """Words, removed words, repeats and kept text of each row; positions (if there are any) tell its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = space_words(fold=False)
        for whole in batches:
            n = whole.num_rows
            n_words, n_removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
            spans: list[list[dict]] = [[] for _ in range(n)]
            kept: list[pa.Array] = []
            parts: list[str] = []
            told = whole.column("positions") if "positions" in whole.schema.names else None
            for piece in pieces(words, whole.column(text)):
                gone = np.zeros(len(piece.starts) + 1, np.int32)
                for t in range(piece.begin, piece.end):
                    mine = told[t].as_py() if told is not None else None
                    if mine:
                        at = joined(mine, np.uint32).astype(np.int64) - piece.base
                        a, b = int(piece.first[t - piece.begin]), int(piece.first[t - piece.begin + 1])
                        at = np.unique(at[(at > -window) & (at < b - a)])
                        np.add.at(gone, a + np.maximum(at, 0), 1)
                        np.add.at(gone, np.minimum(a + at + window, b), -1)
                gone = np.cumsum(gone[:-1]) > 0
                count = np.concatenate([[0], np.cumsum(gone)])
                here = slice(piece.begin, piece.end)
                n_words[here] += np.diff(piece.first)
                n_removed[here] += count[piece.first[1:]] - count[piece.first[:-1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    t = int(np.searchsorted(piece.first, a, "right")) - 1
                    while a < b:  # removed words of neighbouring texts touch here
                        c, start = min(b, int(piece.first[t + 1])), piece.base - int(piece.first[t])
                        if c > a:
                            own = spans[piece.begin + t]
                            if own and own[-1]["end_word"] == a + start:
                                own[-1]["end_word"] = c + start
                            else:
                                own.append({"first_word": a + start, "end_word": c + start})
                        a, t = c, t + 1
                found = _kept(piece.data, piece.starts, piece.ends, piece.first, ~gone)
                if piece.base or not piece.last:
                    parts += [x for x in found.to_pylist() if x]
                    found = pa.array([" ".join(parts)], pa.large_string()) if piece.last else None
                if piece.last:
                    kept.append(found)
                    parts = []
            columns = [*(whole.column(c) for c in others), pa.array(n_words), pa.array(n_removed), pa.array(spans, SPANS), pa.concat_arrays(kept).cast(pa.string()) if kept else pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "n_removed", "repeats", "kept_text"])

    return run


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space. A word's separator goes along unless it is the last one kept."""
    at = np.flatnonzero(keep)
    text = np.searchsorted(first, at, "right") - 1
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(at) else np.zeros(0, bool)
    stop = ends[at] + ~last
    step = np.zeros(len(data) + 2, np.int8)
    step[starts[at]] += 1
    step[stop] -= 1
    mask = np.cumsum(step[: len(data)], dtype=np.int8) > 0
    clean = data.copy()
    clean[ends[at[~last]]] = 32
    lengths = np.bincount(text, stop - starts[at], minlength=len(first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(clean[mask].tobytes())])


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """docs with kept_text in place of the text, and n_words, n_removed and repeats (word spans).

    Words are runs without ASCII white space. Every word covered by a window of
    consecutive words that starts earlier as well (in a row of lesser key, or
    earlier in the same text) is removed, judged on the input; kept words are
    joined by one space. The key must be a whole number or castable to one. Null
    texts have no words. Rows with a null key come last in the order. Equal
    rows count as one document; rows that share a key but not the text are
    ordered by a hash of it. Texts of any length are worked on in pieces; a row
    as such must fit in memory. Columns of docs that are named like the added
    ones are replaced.
    """
    passing = Passing(docs, ["n_words", "n_removed", "repeats", "kept_text"], text)
    body, order = passing[text], F.coalesce(F.col(passing[key]).cast("long"), F.lit(LAST))
    docs = passing.df.withColumn("_k", F.xxhash64(order, body))
    texts = docs.select(F.col("_k").alias("k"), order.alias("id"), F.col(body).alias("body"))
    size = texts.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts = part_count(size // WORD_BYTES)
    passes, files = max(1, min(PASSES, parts // PASS_PARTS)), max(1, size // FILE_BYTES)
    edges, found = [parts * p // passes for p in range(passes + 1)], []
    for begin, end in zip(edges, edges[1:], strict=False):  # what a pass shuffles goes before the next one begins
        asked = texts.select("k", "body").mapInArrow(_offer(window, parts, begin, end), OFFER)
        keys = _each(asked.groupBy("part").applyInPandas(_hits, ANSWER).groupBy("batch").applyInPandas(_keys, "k long, base long, keys binary"), "keys")
        found.append(cut(keys.coalesce(files)) if passes > 1 else keys)
    hits = cut(_whole(reduce(DataFrame.unionByName, found), "keys").coalesce(files))
    n_hits = hits.agg(F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    window_parts = part_count(2 * n_hits // 4)
    near = _only(texts, hits).join(hits, "k").mapInArrow(_windows(window, parts, window_parts), "part int, batch long, base long, owners binary, ids binary, runs binary, hashes binary, positions binary")
    found = near.groupBy("part").applyInPandas(_later, "batch long, base long, owners binary, runs binary, positions binary")
    later = cut(_whole(_each(found.groupBy("batch").applyInPandas(_positions, "k long, base long, positions binary"), "positions"), "positions").coalesce(files))
    added = passing.schema() + "n_words long, n_removed long, repeats array<struct<first_word: long, end_word: long>>, kept_text string"
    strip, rows = _strip(window, body, passing.inner), docs.select("_k", *passing.inner, body)
    changed = later.select(F.col("k").alias("_k"), "positions")
    if later.count() > BROADCAST_ROWS:
        return passing.restored(rows.join(changed, "_k", "left").drop("_k").mapInArrow(strip, added))
    names = F.broadcast(changed.select("_k"))
    touched = rows.join(names, "_k", "left_semi").join(changed, "_k").drop("_k").mapInArrow(strip, added)
    return passing.restored(rows.join(names, "_k", "left_anti").drop("_k").mapInArrow(strip, added).unionByName(touched))


def _only(texts: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of texts whose k occurs in named, taken out before a shuffle where the hashes are few enough to be broadcast."""
    return texts if named.count() > BROADCAST_ROWS else texts.join(F.broadcast(named.select("k")), "k", "left_semi")
