"""Deflate and inflate of container blocks, and the split of content into blocks."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, DEFLATE_HEADER


def deflate_block(block: bytes) -> bytes | None:
    """A zlib stream with a 4 KiB window at level 6; null when it would not be shorter."""
    coder = zlib.compressobj(6, zlib.DEFLATED, -12)
    body = coder.compress(block) + coder.flush()
    if len(body) + 6 >= len(block):
        return None
    return DEFLATE_HEADER + body + struct.pack(">I", zlib.adler32(block))


def inflate_block(stored: bytes, size: int, check: bool = True) -> bytes | None:
    """The content of a stored block: itself when it has its full size, else a zlib or raw stream; null when it is damaged."""
    if len(stored) == size:
        return stored
    try:
        if stored and stored[0] & 15 == 8:
            if check:
                return zlib.decompress(stored)
            return zlib.decompressobj(-15).decompress(stored[2:], size)
        return zlib.decompressobj(-15).decompress(stored, size)
    except zlib.error:
        return None


def deflate():
    @F.pandas_udf("binary")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: deflate_block(bytes(b)), na_action="ignore")

    return run


def inflate(check: bool = True):
    @F.pandas_udf("binary")
    def run(stored: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or n is None else inflate_block(bytes(b), int(n), check) for b, n in zip(stored, size, strict=True)])

    return run


def split_blocks(rows: DataFrame, content: str, block: int = BLOCK) -> DataFrame:
    """A row for each block of the content: block_no and data. Empty content gives no row."""
    n = F.ceil(F.octet_length(content) / F.lit(block)).cast("int")
    numbered = rows.where(n > 0).withColumn("block_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return numbered.withColumn("data", F.substring(F.col(content), F.col("block_no") * block + 1, F.lit(block))).drop(content)


def store_blocks(blocks: DataFrame, raw: str | None = None) -> DataFrame:
    """blocks with stored bytes: compressed where that is shorter, else as they are.

    raw names a boolean column; blocks for which it holds are never compressed.
    """
    packed = deflate()(F.col("data"))
    if raw is not None:
        packed = F.when(~F.col(raw), packed)
    return blocks.withColumn("stored", F.coalesce(packed, F.col("data"))).withColumn("is_raw", F.octet_length("stored") == F.octet_length("data"))
