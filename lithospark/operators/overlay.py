"""Unions, overlays, upserts and the closure of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.functions.paths import ancestors, normalize_key
from lithospark.operators.joins import missing_ignoring_case


def union_listing(entries: DataFrame, image: DataFrame) -> DataFrame:
    """The entry layer and the image layer as one listing."""
    return entries.unionByName(image, allowMissingColumns=True)


def last_writer_wins(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """One row for each key, from the last layer that has it; with layer, its number.

    Rows are combined by max_by, which works before the shuffle, so a key with
    many rows is no burden. Among rows of one layer the greatest wins.
    """
    columns = layers[0].columns
    every = None
    for k, layer in enumerate(layers):
        marked = layer.select(*columns).withColumn("layer", F.lit(k))
        every = marked if every is None else every.unionByName(marked)
    values = [c for c in columns if c not in key]
    best = F.max(F.struct("layer", *values))
    return every.groupBy(*key).agg(best.alias("_best")).select(*key, *(F.col(f"_best.{v}").alias(v) for v in values), F.col("_best.layer").alias("layer"))


def overlay_files(base: DataFrame, update: DataFrame, path: str = "path") -> DataFrame:
    """Files of both trees; the update's replaces the base's of the same path, ignoring case. Nothing is deleted."""
    keyed = [f.withColumn("_key", F.lower(path)) for f in (base, update)]
    return last_writer_wins(keyed, ["_key"]).drop("_key")


def overlay_profiles(base: DataFrame | None, update: DataFrame) -> DataFrame | None:
    """The same for policies by normalised path; without a base there is no profile at all."""
    if base is None:
        return None
    keyed = [p.select(normalize_key(F.col("path")).alias("path"), "policy") for p in (base, update)]
    return last_writer_wins(keyed, ["path"]).drop("layer")


def policy_precedence(attributes: DataFrame, profile: DataFrame) -> DataFrame:
    """(path, policy): the profile's policy, else the project's attribute."""
    a = attributes.select(normalize_key(F.col("path")).alias("path"), F.col("policy").alias("attribute"))
    b = profile.select(normalize_key(F.col("path")).alias("path"), F.col("policy").alias("profiled"))
    return a.join(b, "path", "full").select("path", F.coalesce("profiled", "attribute").alias("policy"))


def sfo_upsert(values: DataFrame, edits: DataFrame) -> DataFrame:
    """values without any row whose key an edit has, ignoring case, and the edits."""
    keys = edits.select("file", F.lower("key").alias("_key")).distinct()
    kept = values.withColumn("_key", F.lower("key")).join(keys, ["file", "_key"], "left_anti").drop("_key")
    return kept.unionByName(edits, allowMissingColumns=True)


def replace_placeholders(entries: DataFrame, given: DataFrame) -> DataFrame:
    """Name and data of given rows take the place of entries of the same id; other given rows are added."""
    new = given.select("id", F.col("name").alias("_name"), F.col("data").alias("_data"), F.lit(True).alias("_given"))
    return entries.join(new, "id", "full").select("id", F.when(F.col("_given"), F.col("_name")).otherwise(F.col("name")).alias("name"), F.when(F.col("_given"), F.col("_data")).otherwise(F.col("data")).alias("data"))


def parent_closure(paths: DataFrame, path: str = "path", fold: bool = True) -> DataFrame:
    """Every directory above any path, different ignoring case (the least spelling stands); without fold, case counts."""
    every = paths.select(F.explode(ancestors(F.col(path))).alias("path"))
    if not fold:
        return every.distinct()
    return every.groupBy(F.lower("path").alias("_key")).agg(F.min("path").alias("path")).drop("_key")


def missing_parents(paths: DataFrame, path: str = "path") -> DataFrame:
    """Directories of the closure that are not among the paths themselves."""
    return missing_ignoring_case(parent_closure(paths, path), paths.select(F.col(path).alias("path")))


def empty_directories(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Directories that no file lies in or below."""
    return missing_ignoring_case(directories, parent_closure(files))


def moved_tree(tree: DataFrame, source: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """tree with the rows of source below a prefix, overwriting what is there."""
    moved = source.withColumn(path, F.concat(F.lit(prefix), F.col(path)))
    return overlay_files(tree, moved, path)
