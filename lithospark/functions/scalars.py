"""Numbers, text and dates as Spark expressions. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, HASH_SLOT_INODE_BITS


def div(a: Column, b: int) -> Column:
    """Whole-number division of non-negative longs."""
    a = a.cast("long")
    return ((a - a % F.lit(b)) / F.lit(b)).cast("long")


def align(n: Column, to: int) -> Column:
    """The next multiple of to."""
    return div(n + F.lit(to - 1), to) * F.lit(to)


def blocks_of(n: Column, block: int = BLOCK) -> Column:
    """Blocks that a file takes, at least one."""
    return F.greatest(F.lit(1).cast("long"), div(n + F.lit(block - 1), block))


def dirent_size(name_length: Column) -> Column:
    """Bytes of a directory record: 17 and the name, to a multiple of 8."""
    return align(name_length + 17, 8)


def slot_inode(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit((1 << HASH_SLOT_INODE_BITS) - 1))


def slot_flags(slot: Column) -> Column:
    return F.shiftrightunsigned(slot, HASH_SLOT_INODE_BITS)


def parse_number(text: Column) -> Column:
    """0x-prefixed hexadecimal or decimal; null for anything else."""
    body = F.trim(text)
    return F.when(body.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.rlike("^[0-9]{1,18}$"), body).cast("long")


def hex8(n: Column) -> Column:
    return F.format_string("%08X", n)


def version_text(n: Column) -> Column:
    return F.format_string("0x%08X", n)


def percent(part: Column, whole: Column) -> Column:
    """Per cent of the whole; a whole of nothing counts as one."""
    return F.lit(100.0) * part / F.greatest(F.lit(1), whole)


def progress(bytes_done: Column, bytes_total: Column, items_done: Column, items_total: Column) -> Column:
    """Per cent by bytes where their total is known, else by items, else null."""
    return F.when(bytes_total > 0, F.lit(100.0) * bytes_done / bytes_total).when(items_total > 0, F.lit(100.0) * items_done / items_total)


def sfo_value(kind: Column, number: Column, text: Column, hexadecimal: bool = False) -> Column:
    return F.when(kind == "int32", version_text(number) if hexadecimal else number.cast("string")).otherwise(text)


# Names of volume types.
VOLUME_TYPES = {
    "pkg_ps4_app": "App",
    "pkg_ps4_patch": "Patch",
    "pkg_ps4_remaster": "Remaster",
    "pkg_ps4_ac_data": "AddonData",
    "pkg_ps4_ac_nodata": "AddonNoData",
    "pkg_ps4_sf_theme": "SystemTheme",
    "pkg_ps4_theme": "Theme",
}


def volume_type(text: Column) -> Column:
    """The type for its text; unknown text means a theme."""
    out = F.lit("Theme")
    for key, value in VOLUME_TYPES.items():
        out = F.when(F.trim(text) == key, value).otherwise(out)
    return F.when(text.isNotNull(), out)


def volume_text(kind: Column) -> Column:
    out = F.lit("pkg_ps4_theme")
    for key, value in VOLUME_TYPES.items():
        out = F.when(kind == value, key).otherwise(out)
    return F.when(kind.isNotNull(), out)


def safe_filename(name: Column, most: int = 40) -> Column:
    """Characters that file systems refuse become _, and the name is cut to most characters."""
    return F.substring(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), 1, most)


def scrub(text: Column) -> Column:
    """Tabs and line ends become spaces."""
    return F.translate(text, "\t\r\n", "   ")


def compact_date(when: Column) -> Column:
    return F.date_format(when, "yyyyMMdd")


def long_date(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


def iso_date(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
