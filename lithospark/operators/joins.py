"""Joins over package relations. Small dimensions are broadcast; the rest is left to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.constants import ENTRY_NAMES
from lithospark.functions.hashes import hash31
from lithospark.functions.paths import normalize_key
from lithospark.functions.scalars import slot_inode


def named_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries with name: from the name table by offset, else the standard name of the id (27 rows, broadcast)."""
    spark = entries.sparkSession
    known = F.broadcast(spark.createDataFrame(list(ENTRY_NAMES.items()), "id long, known string"))
    table = names.select("file", F.col("offset").alias("name_offset"), F.nullif(F.col("name"), F.lit("")).alias("listed"))
    return entries.join(table, ["file", "name_offset"], "left").join(known, "id", "left").withColumn("name", F.coalesce("listed", "known")).drop("listed", "known")


def policy_diff(this: DataFrame, other: DataFrame, path: str = "path", policy: str = "policy") -> DataFrame:
    """One row for each normalised path of either side: status identical, mismatched, only-here or only-reference."""
    a = this.select(normalize_key(F.col(path)).alias("path"), F.col(policy).alias("here"))
    b = other.select(normalize_key(F.col(path)).alias("path"), F.col(policy).alias("reference"))
    status = F.when(F.col("here").isNull(), "only-reference").when(F.col("reference").isNull(), "only-here").when(F.col("here") == F.col("reference"), "identical").otherwise("mismatched")
    return a.join(b, "path", "full").withColumn("status", status)


def diff_counts(diff: DataFrame) -> DataFrame:
    kinds = ("identical", "mismatched", "only-here", "only-reference")
    return diff.agg(*(F.count_if(F.col("status") == k).alias(k.replace("-", "_")) for k in kinds))


def with_policy(files: DataFrame, profile: DataFrame, path: str = "path") -> DataFrame:
    """files with the policy that the profile has for their normalised path, or null."""
    rules = profile.select(normalize_key(F.col("path")).alias("_key"), "policy").dropDuplicates(["_key"])
    return files.withColumn("_key", normalize_key(F.col(path))).join(rules, "_key", "left").drop("_key")


def raw_blocks(allocation: DataFrame, policies: DataFrame, path: str = "path") -> DataFrame:
    """The block numbers of files whose policy is disable."""
    ruled = allocation.join(policies.where(F.col("policy") == "disable").select(path), path, "left_semi").where("block_count > 0")
    return ruled.select(F.explode(F.sequence(F.col("start_block"), F.col("start_block") + F.col("block_count") - 1)).alias("block_no")).distinct()


def in_raw_blocks(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    return blocks.join(raw, "block_no", "left_semi")


def range_policies(files: DataFrame, blocks: DataFrame, block: int, group: str = "file", order: str = "block_no") -> DataFrame:
    """files with policy, from a prefix count of compressed blocks and two look-ups.

    enable if any block of a file's range has another stored size than the
    block size, disable if none has, none if the range is empty, starts at
    block 0 (which no file owns) or ends beyond the table. blocks: (group,
    block_no, stored_size).
    """
    from lithospark.operators.windows import running_before

    marked = blocks.withColumn("_packed", (F.col("stored_size") != block).cast("long"))
    counted = running_before(marked, "_packed", [order], "_before", [group]).select(group, order, "_before", (F.col("_before") + F.col("_packed")).alias("_through"))
    first = counted.select(group, F.col(order).alias("_first"), F.col("_before").alias("_low"))
    last = counted.select(group, F.col(order).alias("_last"), F.col("_through").alias("_high"))
    ranged = files.withColumn("_first", F.col("start_block")).withColumn("_last", F.col("start_block") + F.col("block_count") - 1)
    found = ranged.join(first, [group, "_first"], "left").join(last, [group, "_last"], "left")
    policy = F.when((F.col("block_count") <= 0) | (F.col("start_block") <= 0) | F.col("_low").isNull() | F.col("_high").isNull(), "none").when(F.col("_high") > F.col("_low"), "enable").otherwise("disable")
    return found.withColumn("policy", policy).select(*files.columns, "policy")


def dirent_inodes(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    return dirents.join(inodes, ["file", "inode"])


def hash_probe(paths: DataFrame, table: DataFrame, path: str = "path", hashed: Column | None = None) -> DataFrame:
    """paths with the inode of the table's first slot of equal hash; the name must be checked afterwards."""
    first = table.groupBy("hash").agg(F.min_by("slot", "ordinal").alias("slot"))
    key = hash31(F.concat(F.lit("/"), F.col(path))) if hashed is None else hashed
    return paths.withColumn("hash", key).join(first, "hash", "left").withColumn("inode", slot_inode(F.col("slot")))


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner in right."""
    return left.join(right, on, "left_anti")


def missing_ignoring_case(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    known = right.select(F.lower(path).alias("_key")).distinct()
    return left.withColumn("_key", F.lower(path)).join(known, "_key", "left_anti").drop("_key")


def unreferenced_inodes(inodes: DataFrame, dirents: DataFrame) -> DataFrame:
    return inodes.join(dirents.select("file", "inode"), ["file", "inode"], "left_anti")


def by_position(left: DataFrame, right: DataFrame, group: str = "file", ordinal: str = "ordinal", how: str = "inner") -> DataFrame:
    """Row i of one relation beside row i of the other."""
    return left.join(right, [group, ordinal], how)


def differing_words(left: DataFrame, right: DataFrame, data: str = "raw", word: int = 8) -> DataFrame:
    """(file, ordinal, offset): the words in which two records of equal place differ."""
    pairs = left.withColumnRenamed(data, "_a").join(right.withColumnRenamed(data, "_b"), ["file", "ordinal"])
    n = F.ceil(F.greatest(F.octet_length("_a"), F.octet_length("_b")) / F.lit(word)).cast("int")
    words = pairs.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    part = lambda c: F.substring(F.col(c), F.col("_k") * word + 1, F.lit(word))
    return words.where(part("_a") != part("_b")).select("file", "ordinal", (F.col("_k") * word).alias("offset"))


def block_use(left: DataFrame, right: DataFrame) -> DataFrame:
    """Owners of each block in two images: (block_no, left_owner, right_owner)."""
    return left.withColumnRenamed("owner", "left_owner").join(right.withColumnRenamed("owner", "right_owner"), "block_no", "full")
