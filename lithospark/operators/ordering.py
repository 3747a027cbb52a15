"""Orders, first rows and top lists. Every order is total, given unique last keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.operators.classify import trophy_rank
from lithospark.operators.windows import running_before


def by_path(listing: DataFrame, path: str = "path") -> DataFrame:
    """Ignoring case, then by the path itself."""
    return listing.orderBy(F.lower(path), path)


def by_id(entries: DataFrame, key: str = "id") -> DataFrame:
    return entries.orderBy(key, "ordinal")


def by_trophy_class(entries: DataFrame, name: str = "name") -> DataFrame:
    """By class, then name; what matches no class comes last."""
    return entries.withColumn("rank", trophy_rank(F.col(name))).orderBy("rank", F.lower(name), name)


def by_hash(table: DataFrame) -> DataFrame:
    return table.orderBy("hash", "inode")


def by_path_length(directories: DataFrame, path: str = "path") -> DataFrame:
    return directories.orderBy(F.length(path), "ordinal")


def first_n(rows: DataFrame, n: int, *order) -> DataFrame:
    """A report of the first n rows in an explicit order."""
    return rows.orderBy(*order).limit(n)


def first_match(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.min_by(value, order).alias(value))


def fail_fast(violations: DataFrame, group: str = "file", order: tuple[str, ...] = ("stage", "ordinal")) -> DataFrame:
    """The first violation of each group; taken by min before the shuffle."""
    others = [c for c in violations.columns if c not in (group, *order)]
    first = F.min(F.struct(*order, *others))
    return violations.groupBy(group).agg(first.alias("_v")).select(group, "_v.*")


def ranked(rows: DataFrame, within: list[str], *order, out: str = "rn") -> DataFrame:
    """rows with their number from 1 in each group; few groups may hold all rows, so ranges are numbered and added up."""
    keys = [f"_k{k}" for k in range(len(order))]
    keyed = rows.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)}).withColumn("_one", F.lit(1))
    return running_before(keyed, "_one", keys, out, within).withColumn(out, (F.col(out) + 1).cast("int")).select(*rows.columns, out)
