"""Row numbers in content order, within a few groups, without a large task.

Rows are ordered by a 64-bit hash of their content. Equal rows are counted
first, in runs of RUN copies, and spread again after numbering, so a row that
makes up a third of a table moves as a handful of counts. The hash's top bits
cut a group into ranges of about a thousand rows; their sizes, added up, give each
range its start.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithospark.session import cut

RUN = 1000
#: The starts of ranges are broadcast: at most 2^RANGE_BITS rows for each group, and no more ranges than give each RANGE_ROWS.
RANGE_BITS, RANGE_ROWS = 14, 1024


def numbered(df: DataFrame, within: list[str] | None = None, run: int = RUN) -> tuple[DataFrame, dict[tuple, int]]:
    """df with row_no, from 0 in each group of the columns within; and the groups' sizes.

    There must be few groups; their sizes are collected. All columns must be of
    types that can be grouped and hashed. Nulls are values like others.
    """
    columns, groups = df.columns, within or []
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    last = F.floor((F.col("_copies") - 1) / F.lit(run)).cast("int")
    runs = (
        counted.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_run"))
        .withColumn("_size", F.least(F.lit(run).cast("long"), F.col("_copies") - F.col("_run").cast("long") * F.lit(run).cast("long")))
        .withColumn("_hash", F.xxhash64(*columns, F.col("_run")).bitwiseXOR(F.lit(-(2**63))))  # signed order is the unsigned one of the hash
        .drop("_copies")
    )
    runs = cut(runs)  # counted once; what follows reads the counts again
    bits = min(RANGE_BITS, max(0, math.ceil(math.log2(max(1, runs.count()) / RANGE_ROWS))))
    runs = runs.withColumn("_range", (F.shiftright("_hash", 64 - bits) if bits else F.lit(0)).cast("int"))
    sizes = runs.groupBy(*groups, "_range").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    totals = {tuple(r[g] for g in groups): r["_total"] for r in sizes.groupBy(*groups).agg(F.sum("_total").alias("_total")).collect()}
    order = Window.partitionBy(*groups, "_range").orderBy("_hash", *columns, "_run").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    placed = runs.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0))).join(F.broadcast(starts), same)
    first = F.col("_start") + F.col("_before")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_size") - 1)).alias("row_no")), {k: v for k, v in totals.items() if v}


def quotient(x, by):
    """x div by; exact below 2^53, as the dividend is a multiple."""
    by = F.lit(by) if isinstance(by, int) else by
    return ((x - x % by) / by).cast("long")
