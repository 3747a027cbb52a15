"""Sharding, packing and row numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithospark.llm.feistel_shards import feistel_shards, halves
from lithospark.llm.packing import boundaries, pack, word_lengths
from lithospark.llm.rownumbers import numbered


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 26, 97, 1000])
def test_permutation_is_one(spark, n):
    out = feistel_shards(spark.range(n), 3).toPandas()
    assert sorted(out.position) == list(range(n)) and sorted(out.row_no) == list(range(n))
    assert ((out.shard == out.position % 3) & (out.slot == out.position // 3)).all()
    sizes = out.groupby("shard").slot.agg(["count", "max"])
    assert sizes["count"].max() - (sizes["count"].min() if len(sizes) == 3 else 0) <= 1 and (sizes["max"] + 1 == sizes["count"]).all()
    a, b = halves(n)
    assert a * b >= n and a * b - n < a


def test_shards_of_hot_rows(spark):
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("shard_name"))
    df = hot.unionByName(spark.range(500).select("id", F.col("id").cast("string").alias("shard_name")))
    a = feistel_shards(df.repartition(7), 8)
    b = feistel_shards(df.repartition(2), 8)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    out = a.toPandas()
    assert len(out) == 3500 and out.position.nunique() == 3500
    assert out[out.id.isna()].groupby("shard").size().between(330, 420).all()
    assert feistel_shards(df.limit(0), 8).count() == 0
    clash = feistel_shards(spark.range(10).withColumn("slot", F.lit(99)).withColumn("_hash", F.lit(1)), 2)
    assert clash.where("slot = 99").count() == 0 and clash.where("_hash = 1").count() == 10


def test_numbers_in_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v")).unionByName(spark.createDataFrame([(None, 1)] * 5, "g long, v long"))
    rows, sizes = numbered(df, ["g"], run=7)
    assert sizes == {(0,): 334, (1,): 333, (2,): 333, (None,): 5}
    for _, part in rows.toPandas().groupby("g", dropna=False):
        assert sorted(part.row_no) == list(range(len(part)))


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4):
        lengths = rng.integers(0, 40, 60)
        edges, counts = np.unique(lengths, return_counts=True)
        got = boundaries(edges, counts, edges * counts, k)
        best = min(padding(lengths, [*c, edges[-1]]) for c in combinations(edges[:-1].tolist(), k - 1))
        assert len(got) <= k and got[-1] == edges[-1] and padding(lengths, got) == best
    assert boundaries(np.array([5]), np.array([3]), np.array([15]), 8) == [5]


def least_padding(lengths, buckets):
    """By the plain programme over all exact lengths."""
    edges, n = np.unique(lengths, return_counts=True)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(edges * n)])
    best = np.concatenate([[0.0], np.full(len(edges), np.inf)])
    for _ in range(buckets):
        best = np.array([0.0] + [min(best[: j + 1] + edges[j] * (count[j + 1] - count[: j + 1]) - (total[j + 1] - total[: j + 1])) for j in range(len(edges))])
    return best[-1]


def test_boundaries_over_many_lengths_are_optimal():
    rng = np.random.default_rng(2)
    for buckets, most in ((8, 20_000), (5, 300), (3, 7), (9, 4)):
        lengths = np.concatenate([rng.integers(0, most, 1500), np.full(800, most // 3)])
        edges, counts = np.unique(lengths, return_counts=True)
        got = boundaries(edges, counts, edges * counts, buckets)
        assert padding(lengths.tolist(), got) == least_padding(lengths, buckets) and len(got) <= buckets


def test_packing_by_exact_lengths(spark):
    rng = np.random.default_rng(7)
    lengths = [int(x) for x in rng.lognormal(6, 1, 1000)] + [5461] * 500
    out = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")).toPandas()
    assert (out.groupby("bucket").n_tokens.max() == out.groupby("bucket").bucket_length.max()).all()
    assert (out.bucket_length - out.n_tokens).sum() == least_padding(np.array(lengths), 8)
    assert (out[out.bucket_length == 5461].groupby("batch").size().iloc[:-1] == 3).all() and (out.bucket_length == 5461).sum() >= 500


def test_packing(spark):
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.lognormal(5, 1, 2000)] + [0] * 50 + [7] * 800 + [40_000] * 3
    rows = spark.createDataFrame([(k % 1500, n) for k, n in enumerate(lengths)] + [(None, None), (None, None)], "doc_id long, n_tokens long")
    a = pack(rows.repartition(6), buckets=6, budget=4096)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, pack(rows.repartition(1), buckets=6, budget=4096).collect()))
    out = a.toPandas()
    assert len(out) == len(lengths) + 2 and out.bucket.nunique() == 6
    assert (out.n_tokens.fillna(0) <= out.bucket_length).all()
    for (_, length), part in out.groupby(["bucket", "bucket_length"]):
        room = max(1, 4096 // max(length, 1))
        sizes = part.groupby("batch").slot.agg(["count", "max"]).sort_index()
        assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["count"].iloc[:-1] == room).all() and sizes["count"].iloc[-1] <= room and list(sizes.index) == list(range(len(sizes)))
    assert pack(rows.limit(0)).count() == 0
    odd = pack(spark.createDataFrame([(1, 5, 9, 9)], "doc_id long, n_tokens long, bucket long, _size long"))
    assert odd.select("bucket", "_size").first() == (0, 9)


def test_word_lengths(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, None), (3, ""), (4, "w " * 40_000), (1, "a b  c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in word_lengths(df).collect()) == [(1, 3), (1, 3), (2, 0), (3, 0), (4, 40_000)]
