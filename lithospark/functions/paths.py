"""Path functions as Spark expressions. Each takes and returns columns; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(path: Column) -> Column:
    """The key of a policy: forward slashes, no trailing ones, no leading image0/, lower case."""
    slashed = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.lower(F.regexp_replace(slashed, "(?i)^image0/", ""))


def normalize_entry_path(path: Column) -> Column:
    """Trailing slashes go before backslashes turn, so a trailing backslash stays as a slash."""
    return F.replace(F.regexp_replace(F.trim(path), "/+$", ""), F.lit("\\"), F.lit("/"))


def prefixed(path: Column, prefix: str) -> Column:
    """path below prefix (such as Sc0/), unless it is there already."""
    return F.when(F.startswith(F.lower(path), F.lit(prefix.lower())), path).otherwise(F.concat(F.lit(prefix), path))


def unprefixed(path: Column, prefix: str) -> Column:
    return F.when(F.startswith(F.lower(path), F.lit(prefix.lower())), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def segments(path: Column) -> Column:
    """The parts between slashes, without empty ones."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def ancestors(path: Column) -> Column:
    """Every proper prefix of a path that ends before a slash, shortest first."""
    parts = segments(path)
    n = F.size(parts)
    # sequence(1, 0) would count down, so short paths are left out first.
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def depth_walk(path: Column) -> Column:
    """The depth after each segment, .. going up and . staying."""
    steps = F.transform(segments(F.replace(path, F.lit("\\"), F.lit("/"))), lambda s: F.when(s == "..", -1).when(s == ".", 0).otherwise(1))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda k: F.aggregate(F.slice(steps, F.lit(1), k), F.lit(0), lambda a, s: a + s))


def is_traversal(path: Column) -> Column:
    """Whether a path, taken below a root, leaves it: absolute, with a drive, or with too many .. in any prefix."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | (F.array_min(depth_walk(path)) < 0)
