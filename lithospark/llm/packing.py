"""Packing into token-budget batches inside optimal length buckets.

Lengths are counted exactly in a global histogram; n different lengths need
about n^2 / 2 tokens, so it stays small. Dynamic programming over them finds the
bucket boundaries with the least padding. Inside a bucket every row takes the
bucket's length, which is that of its longest row, a batch holds as many rows as
the budget allows, and rows fill batches in a reproducible shuffled order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.columns import Passing
from lithospark.llm.rownumbers import numbered, quotient
from lithospark.llm.textkernel import slices, space_words, text_buffer

def boundaries(edges: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """The at most buckets edges that minimise the padding of all rows; the last one is the greatest.

    For an edge e, a last bucket that starts after the first i edges costs
    best[i] + sum[i] - e * count[i] and what does not depend on i: the least of
    lines whose slopes fall with i, asked at growing e. Whole numbers of any size.
    """
    h = len(edges)
    size = [int(e) for e in edges]
    count, total = [0], [0]
    for n, t in zip(counts.tolist(), sums.tolist(), strict=True):
        count.append(count[-1] + int(n))
        total.append(total[-1] + int(t))
    best = [0] + [size[j - 1] * count[j] - total[j] for j in range(1, h + 1)]
    choice = [[0] * (h + 1)]
    for _ in range(min(buckets, h) - 1):
        line = [best[i] + total[i] for i in range(h + 1)]
        now, pick, hull, first = [0] * (h + 1), [0] * (h + 1), [], 0
        for j in range(1, h + 1):
            z = j - 1
            while len(hull) - first > 1 and (line[z] - line[hull[-2]]) * (count[hull[-1]] - count[hull[-2]]) <= (line[hull[-1]] - line[hull[-2]]) * (count[z] - count[hull[-2]]):
                hull.pop()
            hull.append(z)
            e = size[z]
            while first + 1 < len(hull) and line[hull[first + 1]] - e * count[hull[first + 1]] < line[hull[first]] - e * count[hull[first]]:
                first += 1
            i = pick[j] = hull[first]
            now[j] = line[i] - e * count[i] + e * count[j] - total[j]
        choice.append(pick)
        best = now
    out, j = [], h
    for pick in reversed(choice):
        if j > 0:
            out.append(size[j - 1])
            j = pick[j]
    return sorted(out)


def _lengths(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = space_words(fold=False)
        for whole in batches:
            for batch in slices(whole, text):
                _, _, first = words.split(*text_buffer(batch.column(text)))
                columns = {c: batch.column(c) for c in batch.schema.names if c != text}
                columns["n_tokens"] = pa.array(np.diff(first), pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def word_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens, the number of words, in place of the text; 0 for null. A column of docs named n_tokens is replaced."""
    passing = Passing(docs, ["n_tokens"], text)
    rows = passing.df.select(*passing.inner, passing[text])
    return passing.restored(rows.mapInArrow(_lengths(passing[text]), f"{passing.schema()}n_tokens long"))


def pack(rows: DataFrame, length: str = "n_tokens", buckets: int = 8, budget: int = 16_384) -> DataFrame:
    """rows with bucket, bucket_length, batch (from 0 in each bucket) and slot.

    rows are keys and lengths; length is a whole number of tokens, null counts
    as 0. A batch holds budget div bucket_length rows, at least one: a row
    longer than the budget is a batch of its own. Every batch of a bucket but
    its last is full. Equal rows get places of their own. An empty table stays
    empty. Columns of rows that are named like the added ones are replaced.
    """
    passing = Passing(rows, ["bucket", "bucket_length", "batch", "slot"])
    rows = passing.df
    tokens = F.greatest(F.coalesce(F.col(passing[length]).cast("long"), F.lit(0)), F.lit(0))
    bars = rows.groupBy(tokens.alias("edge")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("edge")
    edges, counts = bars["edge"].to_numpy(), bars["n"].to_numpy()
    bounds = boundaries(edges, counts, edges * counts, buckets) if len(edges) else [0]
    of = F.lit(len(bounds) - 1)
    size = F.lit(bounds[-1])
    for k in range(len(bounds) - 2, -1, -1):
        of = F.when(tokens <= bounds[k], F.lit(k)).otherwise(of)
        size = F.when(tokens <= bounds[k], F.lit(bounds[k])).otherwise(size)
    placed, _ = numbered(rows.withColumn("bucket", of.cast("int")).withColumn("bucket_length", size.cast("long")), within=["bucket"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return passing.restored(placed.withColumn("batch", quotient(F.col("row_no"), room)).withColumn("slot", F.col("row_no") % room))
