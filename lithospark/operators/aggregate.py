"""Counts, sums, duplicates and digests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, SPACE_RESERVE
from lithospark.functions.paths import dirname
from lithospark.functions.scalars import align


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, most frequent first, then by key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def outcome(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.agg(F.count_if(F.col(status) == "OK").alias("ok"), F.count_if(F.col(status) == "FAIL").alias("fail"))


def failures(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.where(F.col(status) == "FAIL")


def image_stats(blocks: DataFrame, block: int, group: list[str] | None = None) -> DataFrame:
    """Raw and compressed blocks and bytes, and the compressed share of blocks in per cent."""
    raw = F.col("stored_size") == block
    n = F.count("stored_size")
    return blocks.groupBy(*(group or [])).agg(
        n.alias("blocks"),
        F.count_if(raw).alias("raw_blocks"),
        F.count_if(~raw).alias("compressed_blocks"),
        F.coalesce(F.sum(F.when(raw, F.col("stored_size"))), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum(F.when(~raw, F.col("stored_size"))), F.lit(0)).alias("compressed_bytes"),
        (F.lit(100.0) * F.count_if(~raw) / F.greatest(F.lit(1), n)).alias("compressed_percent"),
    )


def policy_counts(files: DataFrame) -> DataFrame:
    return files.agg(*(F.count_if(F.col("policy") == p).alias(p) for p in ("enable", "disable", "none")))


def any_by(rows: DataFrame, key: str, condition: Column, out: str) -> DataFrame:
    return rows.groupBy(key).agg(F.bool_or(condition).alias(out))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with n."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collisions(paths: DataFrame, key: str, path: str) -> DataFrame:
    """Hash values that several different paths share, with the sorted paths. A group holds what collides on 32 bits."""
    return paths.select(key, path).distinct().groupBy(key).agg(F.sort_array(F.collect_list(path)).alias("paths")).where(F.size("paths") > 1).orderBy(key)


def directory_totals(files: DataFrame, path: str = "path") -> DataFrame:
    """Files, and the different directories that hold one directly; case counts, the top level is none."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.nullif(dirname(F.col(path)), F.lit(""))).alias("directories"))


def listing_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_directory").alias("directories"), F.count_if(~F.col("is_directory")).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def space_estimate(files: DataFrame, size: str, expected: int | None = None, block: int = BLOCK) -> DataFrame:
    """Bytes that a build needs, in whole-number arithmetic: inner image, compressed image, temporary space and output."""
    inner = F.coalesce(F.sum(align(F.coalesce(F.col(size), F.lit(0)), block)), F.lit(0))
    packed = inner if not expected else F.least(inner, F.lit(expected * 11 // 10))
    sums = files.agg(inner.alias("inner_bytes"), packed.alias("compressed_bytes"))
    temporary = (F.col("inner_bytes") + 2 * F.col("compressed_bytes")) * 115
    quarter = (F.col("inner_bytes") - F.col("inner_bytes") % 4) / 4
    return sums.withColumn("temporary_bytes", ((temporary - temporary % 100) / 100).cast("long") + SPACE_RESERVE).withColumn("output_bytes", F.col("compressed_bytes") + quarter.cast("long") + SPACE_RESERVE)


def chained_digest(entries: DataFrame, group: list[str], order: str, data: str, ids: list[int] | None = None) -> DataFrame:
    """SHA-256 over the payloads of each group joined in order: (group, digest of the bytes, hex_digest of their hex text).

    ids picks a few entries and gives their order, which bounds what is
    gathered; without it payloads are streamed in order.
    """
    if ids is None:
        return streamed_digest(entries, group, order, data)
    place = F.array_position(F.array(*(F.lit(i).cast("long") for i in ids)), F.col(order))
    parts = F.sort_array(F.collect_list(F.struct(place.alias("place"), data)))
    text = F.array_join(F.transform(parts, lambda p: F.hex(p[data])), "")
    return entries.where(F.col(order).isin(ids)).groupBy(*group).agg(F.sha2(F.unhex(text), 256).alias("digest"), F.sha2(text, 256).alias("hex_digest"))


def streamed_digest(pieces: DataFrame, group: list[str], order: str, data: str) -> DataFrame:
    """What chained_digest() gives, with the pieces sorted within partitions and passed through a digest one by one.

    A group of any size passes through one task without being held.
    """
    rows = pieces.select(*group, order, data).repartition(*group).sortWithinPartitions(*group, order)
    kinds = dict(pieces.dtypes)

    def run(batches):
        name, body, text = None, None, None
        for frame in batches:
            done = []
            for g, piece in zip(frame[group].itertuples(index=False, name=None), frame[data], strict=True):
                if body is None or g != name:
                    if body is not None:
                        done.append((*name, body.hexdigest(), text.hexdigest()))
                    name, body, text = g, hashlib.sha256(), hashlib.sha256()
                piece = bytes(piece or b"")
                body.update(piece)
                text.update(piece.hex().upper().encode())
            if done:
                yield pd.DataFrame(done, columns=[*group, "digest", "hex_digest"])
        if body is not None:
            yield pd.DataFrame([(*name, body.hexdigest(), text.hexdigest())], columns=[*group, "digest", "hex_digest"])

    return rows.mapInPandas(run, "".join(f"`{g}` {kinds[g]}, " for g in group) + "digest string, hex_digest string")


def region_digest(pieces: DataFrame, group: str = "key", order: str = "offset", data: str = "data") -> DataFrame:
    """SHA-256 of a region from its pieces, in the order of their offsets: (group, digest)."""
    return streamed_digest(pieces, [group], order, data).select(group, "digest")


def first_divergence(differences: DataFrame, group: str = "file", offset: str = "offset") -> DataFrame:
    return differences.groupBy(group).agg(F.min(offset).alias("first_offset"))
