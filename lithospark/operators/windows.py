"""Offsets, gaps and layouts: computations over an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, ENTRY_ALIGN
from lithospark.functions.scalars import align, blocks_of, dirent_size, div
from lithospark.session import cut

UP = Window.unboundedPreceding


def running_before(df: DataFrame, value: str, order: list[str], out: str, within: list[str] | None = None) -> DataFrame:
    """df with the sum of value over earlier rows in the order; 0 for the first.

    The rows are range-partitioned by the whole order; a window adds up within
    each range, and the totals of earlier ranges (one row for each range and
    group) are added. No task takes more than a range. The order must be total
    for a defined result; null values count as 0.
    """
    groups = within or []
    ranged = cut(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)).withColumn("_p", F.spark_partition_id())
    number = F.coalesce(F.col(value), F.lit(0))
    own = Window.partitionBy("_p", *groups).orderBy(*order).rowsBetween(UP, -1)
    totals = ranged.groupBy("_p", *groups).agg(F.sum(number).alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_p").rowsBetween(UP, -1)
    totals = totals.select(F.col("_p").alias("_q"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_p") == F.col("_q")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    joined = ranged.withColumn("_own", F.coalesce(F.sum(number).over(own), F.lit(0))).join(totals, same)
    return joined.withColumn(out, F.col("_own") + F.col("_start")).select(*df.columns, out)


def neighbour(df: DataFrame, value: str, order: list[str], out: str, within: list[str] | None = None, forward: bool = True) -> DataFrame:
    """df with the value of the next row in the order (of the one before, without forward); null at the end.

    Rows are range-partitioned like in running_before; where a range ends, the
    value comes from the first (last) row of the next range that has the group,
    of which there is one row for each range and group.
    """
    groups = within or []
    ranged = cut(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)).withColumn("_p", F.spark_partition_id())
    step = F.lead if forward else F.lag
    own = Window.partitionBy("_p", *groups).orderBy(*order)
    edge = (F.min_by if forward else F.max_by)(F.struct(value), F.struct(*order))
    edges = ranged.groupBy("_p", *groups).agg(edge.alias("_edge"))
    beyond = step(F.col(f"_edge.{value}")).over(Window.partitionBy(*groups).orderBy("_p"))
    edges = edges.select(F.col("_p").alias("_q"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), beyond.alias("_beyond"))
    same = F.col("_p") == F.col("_q")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    near = ranged.withColumn("_near", step(F.struct(value)).over(own)).join(edges, same)
    return near.withColumn(out, F.when(F.col("_near").isNull(), F.col("_beyond")).otherwise(F.col(f"_near.{value}"))).select(*df.columns, out)


def stored_sizes(blocks: DataFrame, block: str = "block_no", offset: str = "offset", group: str = "file") -> DataFrame:
    """blocks with stored_size: the next offset less its own; null for the last row of a table."""
    return neighbour(blocks, offset, [block], "_next", [group]).withColumn("stored_size", F.col("_next") - F.col(offset)).drop("_next")


def name_offsets(names: DataFrame, name: str = "name", order: str = "ordinal") -> DataFrame:
    """names with offset: 1 and the lengths, with an end byte each, of all names before."""
    sized = names.withColumn("_len", F.octet_length(name) + 1)
    return running_before(sized, "_len", [order], "offset").withColumn("offset", F.col("offset") + 1).drop("_len")


def block_layout(files: DataFrame, size: str, order: list[str], block: int = BLOCK, base: int = 0) -> DataFrame:
    """files with block_count and start_block, laid out one after another from base."""
    counted = files.withColumn("block_count", blocks_of(F.coalesce(F.col(size), F.lit(0)), block))
    return running_before(counted, "block_count", order, "start_block").withColumn("start_block", F.col("start_block") + base)


def aligned_offsets(entries: DataFrame, size: str, order: list[str], within: list[str], to: int = ENTRY_ALIGN, base: int = 0, pinned: str | None = None) -> DataFrame:
    """entries with offset: sizes rounded up and added; pinned rows keep the offset in that column and take no room."""
    room = align(F.coalesce(F.col(size), F.lit(0)), to)
    sized = entries.withColumn("_room", room if pinned is None else F.when(F.col(pinned).isNull(), room).otherwise(0))
    out = running_before(sized, "_room", order, "offset", within).withColumn("offset", F.col("offset") + base).drop("_room")
    return out if pinned is None else out.withColumn("offset", F.coalesce(F.col(pinned), F.col("offset")))


def sfo_offsets(values: DataFrame, group: str = "file") -> DataFrame:
    """values in key order with key_offset (names with an end byte) and data_offset (values by their greatest length)."""
    by = Window.partitionBy(group).orderBy("key").rowsBetween(UP, -1)
    return values.withColumn("key_offset", F.coalesce(F.sum(F.octet_length("key") + 1).over(by), F.lit(0))).withColumn("data_offset", F.coalesce(F.sum("max_length").over(by), F.lit(0)))


def falling(rows: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """Rows whose value is less than that of the row before, with previous."""
    return neighbour(rows, value, order, "previous", within, forward=False).where(F.col(value) < F.col("previous"))


def inode_position(ordinal: Column, size: int, block: int = BLOCK) -> Column:
    """Where an inode lies: inodes fill whole blocks from block 1, and none crosses a block's end."""
    per = block // size
    return (div(ordinal, per) + 1) * F.lit(block) + (ordinal % F.lit(per)) * F.lit(size)


def packed_dirents(names: Column, block: int = BLOCK) -> Column:
    """Offsets of a directory's records in order; a record that would cross a block's end starts the next block."""
    sizes = F.transform(names, lambda n: dirent_size(F.octet_length(n)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("at"))

    def place(state: Column, size: Column) -> Column:
        end = state["end"]
        left = F.lit(block) - end % F.lit(block)
        at = F.when(size > left, end + left).otherwise(end)
        return F.struct((at + size).alias("end"), F.concat(state["at"], F.array(at)).alias("at"))

    return F.aggregate(sizes, start, place, lambda state: state["at"])


def ordinals(nodes: DataFrame, path: str = "path", is_directory: str = "is_directory", start: int = 0) -> DataFrame:
    """nodes with ordinal: directories before files, each in the order of their paths' segments."""
    keyed = nodes.withColumn("_one", F.lit(1)).withColumn("_file", ~F.col(is_directory)).withColumn("_key", F.array_join(F.split(F.col(path), "/"), "\x01"))
    return running_before(keyed, "_one", ["_file", "_key"], "ordinal").withColumn("ordinal", F.col("ordinal") + start).drop("_one", "_file", "_key")


def next_greater(rows: DataFrame, value: str, within: list[str], out: str = "next_value") -> DataFrame:
    """rows with the least value of the group that is greater than the row's own; value must be a whole number."""
    return rows.withColumn(out, F.min(value).over(Window.partitionBy(*within).orderBy(value).rangeBetween(1, Window.unboundedFollowing)))
