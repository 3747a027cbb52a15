"""XML, JSON and folder inputs. Documents are columns of text; what does not parse gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMED = ["content_id", "passcode", "storage_type", "app_type", "version", "title_id", "title", "app_version"]
PROJECT = (
    f"volume struct<volume_type: string, package: struct<{', '.join(f'{n}: string, _{n}: string' for n in _NAMED)}>>, "
    "files struct<file: array<struct<_targ_path: string, _orig_path: string, _pfs_compression: string, orig_path: string, entry: struct<_path: string>>>>"
)
TITLE_PATCH = (
    "_titleid string, tag array<struct<_name: string, _mandatory: string, package: array<struct<_version: string, _size: long, _digest: string, _manifest_url: string, _content_id: string, "
    "_system_ver: string, _type: string, _remaster: string, _patchgo: string>>>>"
)
MANIFEST = "originalFileSize long, packageDigest string, numberOfSplitFiles int, pieces array<struct<url: string, fileOffset: long, fileSize: long, hashValue: string>>"


def without_declaration(xml: Column) -> Column:
    return F.regexp_replace(xml, r"^\s*<\?xml.*?\?>", "")


def projects(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """rows with project: the volume's values (child elements before attributes) and files (target, origin, compression)."""
    parsed = rows.withColumn("_p", F.from_xml(without_declaration(F.col(xml)), F.lit(PROJECT)))
    package = F.col("_p.volume.package")
    values = [F.coalesce(F.trim(package[n]), F.trim(package[f"_{n}"]), F.lit("")).alias(n) for n in _NAMED]
    target = lambda f: F.coalesce(f["entry"]["_path"], f["_targ_path"], F.lit(""))
    files = F.transform(
        F.filter(F.col("_p.files.file"), lambda f: target(f) != ""),
        lambda f: F.struct(target(f).alias("path"), F.coalesce(F.nullif(f["orig_path"], F.lit("")), F.nullif(f["_orig_path"], F.lit("")), target(f)).alias("origin"), F.coalesce(f["_pfs_compression"], F.lit("")).alias("compression")),
    )
    return parsed.withColumn("project", F.when(F.col("_p").isNotNull(), F.struct(F.trim("_p.volume.volume_type").alias("volume_type"), *values, files.alias("files")))).drop("_p")


def project_files(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("project.files").alias("ordinal", "f")).select("file", "ordinal", "f.*")


def profile_policies(rows: DataFrame, json: str = "json") -> DataFrame:
    """(file, path, policy) of profiles; names of either case, and of version 1 only (others give nothing)."""
    named = F.from_json(F.regexp_replace(F.regexp_replace(F.col(json), r'"[Vv]ersion"\s*:', '"version":'), r'"[Ff]iles"\s*:', '"files":'), "struct<version: int, files: map<string, string>>")
    parsed = rows.select("file", named.alias("p")).where(F.coalesce("p.version", F.lit(1)) == 1)
    return parsed.select("file", F.explode("p.files").alias("path", "policy")).withColumn("policy", F.lower("policy"))


def title_patches(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """rows with patch: the first package of the first tag; null when the shape differs."""
    parsed = F.from_xml(without_declaration(F.col(xml)), F.lit(TITLE_PATCH))
    tag = F.get(parsed["tag"], F.lit(0))
    package = F.get(tag["package"], F.lit(0))
    names = ["version", "size", "digest", "manifest_url", "content_id", "system_ver", "type", "remaster", "patchgo"]
    value = F.struct(parsed["_titleid"].alias("title_id"), tag["_name"].alias("tag"), tag["_mandatory"].alias("mandatory"), *(package[f"_{n}"].alias(n) for n in names))
    return rows.withColumn("patch", F.when(package.isNotNull(), value))


def manifests(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with manifest; null for anything else."""
    parsed = F.from_json(F.col(json), MANIFEST)
    return rows.withColumn("manifest", F.when(parsed["originalFileSize"].isNotNull() | parsed["pieces"].isNotNull(), parsed))


def manifest_pieces(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("manifest.pieces").alias("ordinal", "p")).select("file", "ordinal", "p.*")


def relative(path: Column, root: str) -> Column:
    """A file's path below root, whatever scheme it is listed with."""
    return F.replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), F.lit("/" + root.split("://", 1)[-1].strip("/") + "/"), F.lit(""))


def folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of every file below root, without content. Paths are relative; directories without files show in folder_directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return files.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder_directories(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every directory below root, from a listing by the driver."""
    import pyarrow.fs as fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    names = [(f.path[len(base) + 1 :],) for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.Directory]
    return spark.createDataFrame(sorted(names), "path string")
