"""Hashes, checksums and probes of bytes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lithospark.constants import ADLER_BASE, PFSC_MAGIC


def hash31(path: Column) -> Column:
    """h = 31*h + upper(c) mod 2^32 over the characters; exact for ASCII, see hash31_any for the rest."""
    codes = F.transform(F.filter(F.split(F.upper(path), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def _utf16_hash(text: str) -> int:
    h = 0
    for c in text:
        up = c.upper()
        units = (up if len(up) == 1 else c).encode("utf-16-le")  # letters whose upper case is longer stay
        for k in range(0, len(units), 2):
            h = (31 * h + units[k] + 256 * units[k + 1]) & 0xFFFFFFFF
    return h


def hash31_any():
    """hash31 over UTF-16 units, as a pandas function; for paths with characters beyond ASCII."""

    @F.pandas_udf("long")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(_utf16_hash, na_action="ignore").astype("Int64")

    return run


def adler32():
    """Adler-32 of bytes, as a pandas function."""

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: zlib.adler32(bytes(x)), na_action="ignore").astype("Int64")

    return run


def adler32_text(text: Column) -> Column:
    """Adler-32 of ASCII text in closed form: a = 1 + sum d, b = n + sum (n - i) d, each mod 65521."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    n = F.size(codes).cast("long")
    a = F.pmod(F.aggregate(codes, F.lit(1).cast("long"), lambda s, d: s + d), F.lit(ADLER_BASE))
    weighted = F.aggregate(F.transform(codes, lambda d, i: (n - i) * d), F.lit(0).cast("long"), lambda s, d: s + d)
    b = F.pmod(n + weighted, F.lit(ADLER_BASE))
    return b * F.lit(65536) + a


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def sha1(data: Column) -> Column:
    return F.sha1(data)


def is_pfsc(data: Column) -> Column:
    return F.substring(data, 1, 4) == F.lit(PFSC_MAGIC)


def is_all_zero(data: Column) -> Column:
    """Not empty and without any byte but 0."""
    return F.hex(data).rlike("^0+$")
