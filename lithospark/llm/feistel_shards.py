"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of a 64-bit hash of their content, so the number
depends on the table alone and not on files or partitions (see rownumbers). The
number goes through a permutation of 0..n-1 (six rounds over Z_a x Z_b with
a*b >= n, cycle walking back into range); position p belongs to shard p mod s
at slot p div s. Shard and slot of any row number can therefore be computed
without the table. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.llm.columns import Passing
from lithospark.llm.rownumbers import RUN, numbered, quotient

ROUNDS = 6


def halves(n: int) -> tuple[int, int]:
    """The sides a, b of the permuted rectangle: the least with a*b >= n, a about the root."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _once(x: Column, n: int, seed: int) -> Column:
    a, b = halves(n)
    right = x % F.lit(b)
    left = quotient(x, b)
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(r), F.lit(seed)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(r), F.lit(seed)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permuted(x: Column, n: int, seed: int) -> Column:
    """Where row number x of n goes.

    Fewer than a numbers lie outside the range, so a walk leaves it after at
    most a*b - n + 1 steps; only the rows that land outside (one in root n)
    walk, and each walk stops changing once it is back.
    """
    a, b = halves(n)
    first = _once(x, n, seed)
    if a * b == n:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(a * b - n)), first, lambda at, _: F.when(at < F.lit(n), at).otherwise(_once(at, n, seed))
    )
    return F.when(first < F.lit(n), first).otherwise(walk)


def feistel_shards(df: DataFrame, shards: int, seed: int = 2024, run: int = RUN) -> DataFrame:
    """Every row of df with row_no, position, shard and slot.

    Counts of the shards differ by one at most; slots of a shard are gapless
    from 0. Rows are told apart by all their columns, so these must be of types
    that can be grouped and hashed (no maps). Nulls are values like others;
    equal rows get different numbers, which of them gets which makes no
    difference. An empty table stays empty. Columns of df that are named like
    the added ones are replaced; they still tell rows apart.
    """
    passing = Passing(df, ["row_no", "position", "shard", "slot"])
    rows, sizes = numbered(passing.df, run=run)
    n = sum(sizes.values())
    if not n:
        return passing.restored(passing.df.select("*", *(F.lit(0).cast(t).alias(c) for c, t in (("row_no", "long"), ("position", "long"), ("shard", "int"), ("slot", "long"))))).limit(0)
    dealt = rows.withColumn("position", permuted(F.col("row_no"), n, seed))
    return passing.restored(dealt.withColumn("shard", (F.col("position") % F.lit(shards)).cast("int")).withColumn("slot", quotient(F.col("position"), shards)))
