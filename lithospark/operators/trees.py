"""Walks over directory graphs.

Both walks go in steps: a step is a join of the frontier with the edges,
checkpointed, so depth costs jobs and not plan size. A branch never enters a
directory that it has passed (the root is not marked beforehand); the global
walk keeps for each directory the path that a depth-first walk meets first,
which is the one of the least trail.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.session import cut

DIRECTORY, FILE = 3, 2


def tree_walk(dirents: DataFrame, root: int = 0, max_depth: int | None = None) -> DataFrame:
    """(file, inode, type, path, depth, trail) for every way from the root; trail holds the record numbers.

    dirents: (file, parent, ordinal, inode, type, name). A directory may be
    met on several branches, never twice on one, so every walk ends. Where
    something lies deeper than max_depth, if that is given, an error is raised.
    """
    edges = dirents.select("file", "parent", "ordinal", "inode", "type", "name").where(F.col("type").isin(DIRECTORY, FILE))
    level = edges.where(F.col("parent") == root).select(
        "file", "inode", "type", F.col("name").alias("path"), F.lit(1).alias("depth"), F.array("ordinal").alias("trail"),
        F.when(F.col("type") == DIRECTORY, F.array("inode")).otherwise(F.array().cast("array<bigint>")).alias("passed"),
    )
    found = []
    step = edges.select("file", F.col("parent").alias("_dir"), F.col("inode").alias("_inode"), F.col("type").alias("_type"), "name", "ordinal")
    for depth in count(1):
        level = cut(level)
        found.append(level)
        frontier = level.where(F.col("type") == DIRECTORY)
        if frontier.isEmpty():
            break
        if depth == max_depth:
            below = frontier.withColumnRenamed("inode", "_dir").join(step, ["file", "_dir"])
            if not below.where((F.col("_type") != DIRECTORY) | ~F.array_contains("passed", F.col("_inode"))).isEmpty():
                raise ValueError(f"something lies deeper than {max_depth} levels")
            break
        level = (
            frontier.withColumnRenamed("inode", "_dir")
            .join(step, ["file", "_dir"])
            .where((F.col("_type") != DIRECTORY) | ~F.array_contains("passed", F.col("_inode")))
            .select(
                "file", F.col("_inode").alias("inode"), F.col("_type").alias("type"), F.concat_ws("/", "path", "name").alias("path"), F.lit(depth + 1).alias("depth"),
                F.concat("trail", F.array("ordinal")).alias("trail"),
                F.when(F.col("_type") == DIRECTORY, F.concat("passed", F.array("_inode"))).otherwise(F.col("passed")).alias("passed"),
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("passed")


def tree_walk_global(dirents: DataFrame, root: int = 0) -> DataFrame:
    """(file, inode, type, path): each directory once, by the path of the least trail; files once for each record below such a directory.

    Of a directory only the least trail so far is kept, and only directories
    whose trail fell hand theirs on, so the work is that of the graph and not
    of its ways. A trail that comes back to a directory has that directory's
    own trail as a prefix and is greater: cycles end by themselves.
    """
    folders = dirents.where(F.col("type") == DIRECTORY).select("file", "parent", "ordinal", F.col("inode").alias("_inode"), "name")
    best = cut(
        folders.where(F.col("parent") == root)
        .groupBy("file", F.col("_inode").alias("inode"))
        .agg(F.min(F.struct(F.array("ordinal").alias("trail"), F.col("name").alias("path"))).alias("b"))
        .withColumn("new", F.lit(True))
    )
    while not best.where("new").isEmpty():
        reached = best.where("new").select("file", F.col("inode").alias("parent"), "b").join(folders, ["file", "parent"])
        reached = reached.select("file", F.col("_inode").alias("inode"), F.struct(F.concat("b.trail", F.array("ordinal")).alias("trail"), F.concat_ws("/", "b.path", "name").alias("path")).alias("b"))
        known = best.select("file", "inode", "b", F.col("b").alias("old"))
        merged = known.unionByName(reached, allowMissingColumns=True).groupBy("file", "inode").agg(F.min("b").alias("b"), F.max("old").alias("old"))
        best = cut(merged.select("file", "inode", "b", (F.col("old").isNull() | (F.col("b") < F.col("old"))).alias("new")))
    first = best.select("file", "inode", F.col("b.path").alias("path"))
    folders = first.unionByName(dirents.select("file").distinct().select("file", F.lit(root).cast("long").alias("inode"), F.lit("").alias("path")))
    files = dirents.where(F.col("type") == FILE).select("file", "parent", F.col("inode").alias("_inode"), "name")
    below = folders.select("file", F.col("inode").alias("parent"), F.col("path").alias("_in")).join(files, ["file", "parent"])
    named = F.when(F.col("_in") == "", F.col("name")).otherwise(F.concat_ws("/", "_in", "name"))
    return first.withColumn("type", F.lit(DIRECTORY)).unionByName(below.select("file", F.col("_inode").alias("inode"), named.alias("path"), F.lit(FILE).alias("type")))


def resolve_path(walk: DataFrame, path: str) -> DataFrame:
    """The nodes at a path, ignoring case; none where a part of it is no directory."""
    return walk.where(F.lower("path") == path.strip("/").lower())


def preorder(walk: DataFrame) -> DataFrame:
    """Directories before files at every level, each followed by what lies below, by name."""
    keys = F.transform(F.split("path", "/"), lambda s: F.concat(F.lit("1"), s))
    last = F.concat(F.when(F.col("type") == DIRECTORY, "1").otherwise("2"), F.element_at(F.split("path", "/"), -1))
    key = F.concat(F.slice(keys, 1, F.size(keys) - 1), F.array(last))
    return walk.withColumn("sort_key", F.array_join(key, "\x01")).orderBy("file", "sort_key", "inode").drop("sort_key")
