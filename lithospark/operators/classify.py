"""Projections and predicates over package relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.constants import ADDON_CATEGORIES, CATEGORY_TYPES, CONTENT_TYPES, ENTRY_NAMES, MANAGED_FILES, META_ENTRY_IDS, THEME_PREFIXES, TROPHY_PATTERNS
from lithospark.functions.paths import unprefixed
from lithospark.functions.scalars import align, parse_number


def addon_type(content_id: Column, title: Column) -> Column:
    """Theme by the content id's prefix or the title, else Dlc."""
    prefix = F.lower(F.substring(F.coalesce(content_id, F.lit("")), 1, 6))
    return F.when(prefix.isin(THEME_PREFIXES) | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("theme")), "Theme").otherwise("Dlc")


def package_type(category: Column, content_type: Column, content_id: Column, title: Column) -> Column:
    """By category; without one by content type; add-ons by addon_type. An unknown category is an Addon."""
    key = F.lower(F.coalesce(category, F.lit("")))
    out = F.when(key.isin(ADDON_CATEGORIES), addon_type(content_id, title))
    for name, kind in CATEGORY_TYPES.items():
        out = out.when(key == name, kind)
    out = out.when(key != "", "Addon")
    for number, kind in CONTENT_TYPES.items():
        out = out.when(content_type == number, kind)
    return out.otherwise(addon_type(content_id, title))


def is_content_entry(entry_id: Column) -> Column:
    return ~entry_id.isin(META_ENTRY_IDS)


def entry_name(name: Column, entry_id: Column) -> Column:
    """The name, or one made of the id."""
    return F.coalesce(name, F.format_string("Sc0/entry_%04X.bin", entry_id))


def file_sizes(stored: Column, uncompressed: Column) -> tuple[Column, Column]:
    """(size, packed_size): the uncompressed size counts if it is positive and another than the stored one."""
    return F.when((uncompressed > 0) & (uncompressed != stored), uncompressed).otherwise(stored), stored


def shown_size(size: Column, packed_size: Column, style: str) -> Column:
    return packed_size if style == "packed_size" else size


def live_dirents(dirents: DataFrame, inode_count: Column) -> DataFrame:
    """Records that name something: not . or .., not the path table, with an inode in range."""
    return dirents.where(~F.col("type").isin(4, 5) & (F.col("name") != "flat_path_table") & (F.col("inode") >= 0) & (F.col("inode") < inode_count))


def is_managed_file(path: Column) -> Column:
    key = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return key.isin(MANAGED_FILES) | key.startswith("sce_sys/about/") | (key.startswith("sce_discmap") & key.endswith(".plt"))


def is_overlay_exempt(area: Column, path: Column) -> Column:
    """The metadata file of either area, which an overlay never replaces."""
    key = F.lower(path)
    return ((area == "Sc0") & (key == "param.sfo")) | ((area == "Image0") & (key == "sce_sys/param.sfo"))


def entry_id_of(name: Column) -> Column:
    """The id of a known name, a numbered change list or a carried entry; else 0."""
    out = F.lit(0).cast("long")
    carried = F.regexp_extract(name, "^entry_([0-9A-Fa-f]{4})\\.bin$", 1)
    number = F.regexp_extract(name, "(?i)^changeinfo/changeinfo_(\\d{1,9})\\.xml$", 1)
    n = F.when(number != "", number).cast("long")
    out = F.when(carried != "", F.conv(carried, 16, 10).cast("long")).otherwise(out)
    out = F.when(n.between(1, 30), F.lit(0x1260) + n + 1).otherwise(out)
    for known, text in ENTRY_NAMES.items():
        out = F.when(name == text, F.lit(known)).otherwise(out)
    return out


def routed(files: DataFrame, path: str = "path") -> DataFrame:
    """files with layer (entry or image), entry_id and target: system files of a known id go to the entry table."""
    plain = unprefixed(F.col(path), "Image0/")
    system = F.lower(plain).startswith("sce_sys/")
    number = F.when(system, entry_id_of(F.substr(plain, F.lit(9)))).otherwise(F.lit(0).cast("long"))
    return files.withColumn("entry_id", number).withColumn("layer", F.when(number > 0, "entry").otherwise("image")).withColumn("target", F.when(number > 0, F.substr(plain, F.lit(9))).otherwise(plain))


def compression_attribute(path: Column, given: Column) -> Column:
    """What is given, else disable for system files and the main program, enable for the rest."""
    system = path.startswith("sce_sys/") | path.startswith("sce_module/") | (path == "eboot.bin")
    return F.when(F.coalesce(given, F.lit("")) != "", given).when(system, "disable").otherwise("enable")


def first_version(*candidates: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))


def newer(base: Column, update: Column) -> Column:
    """The update's value only if it is greater; nulls lose."""
    return F.greatest(base, update)


def trophy_rank(name: Column) -> Column:
    """The class of a trophy file in listing order; what matches none comes last."""
    out = F.lit(len(TROPHY_PATTERNS))
    for k in range(len(TROPHY_PATTERNS) - 1, -1, -1):
        out = F.when(name.rlike(TROPHY_PATTERNS[k]), F.lit(k)).otherwise(out)
    return out


def sfo_lookup(values: DataFrame, keys: list[str], by: str = "key", value: str = "value", group: str = "file", order: str = "ordinal") -> DataFrame:
    """A column for each key with its first value by ordinal, ignoring case; missing text is empty."""
    wanted = [k.lower() for k in keys]
    own = F.lower(by)
    return values.where(own.isin(wanted)).groupBy(group).agg(*(F.coalesce(F.min_by(value, F.when(own == k, F.col(order))), F.lit("")).alias(name) for k, name in zip(wanted, keys, strict=True)))


def sfo_edited(kind: Column, old: Column, new: Column) -> Column:
    """The kind of an edited value: it stays a number where it was one and the new text is one, else it is text."""
    return F.when((kind == "int32") & parse_number(new).isNotNull(), "int32").otherwise("utf8")


def sfo_edits(values: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, key, format, max_length, number, text) of edits (file, key, value), against the values that are there.

    The first value of the same key, ignoring case, gives the kind and the least
    room; a new key is text. Text takes its bytes and an end byte, to a multiple
    of four.
    """
    old = values.groupBy("file", F.lower("key").alias("_key")).agg(F.min_by(F.struct("format", "max_length"), "ordinal").alias("old"))
    new = edits.withColumn("_key", F.lower("key")).join(old, ["file", "_key"], "left")
    kind = sfo_edited(F.col("old.format"), F.lit(""), F.col("value"))
    number = F.when(kind == "int32", parse_number(F.col("value"))).cast("int")
    room = F.when(kind == "int32", F.lit(4)).otherwise(align(F.octet_length("value") + 1, 4))
    return new.select("file", "key", kind.alias("format"), F.greatest(room, F.coalesce("old.max_length", F.lit(0))).cast("long").alias("max_length"), number.alias("number"), F.when(kind != "int32", F.col("value")).alias("text"))


def field_rows(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): one row for each field, values as text."""
    return table.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, fields, "field", "value")


def field_dump(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, hex, decimal) of whole-number fields, in their order."""
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field")).cast("int")
    rows = table.select(key, *(F.col(f).cast("long").alias(f) for f in fields)).unpivot(key, fields, "field", "decimal")
    return rows.select(key, place.alias("ordinal"), "field", F.format_string("0x%X", "decimal").alias("hex"), "decimal").orderBy(key, "ordinal")


def field_diff(left: DataFrame, right: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Rows of both sides by key with SAME or DIFF; nulls are equal to each other."""
    a, b = left.withColumnRenamed(value, "left_value"), right.withColumnRenamed(value, "right_value")
    return a.join(b, key, "full").withColumn("status", F.when(F.col("left_value").eqNullSafe(F.col("right_value")), "SAME").otherwise("DIFF"))


def pair_problems(pairs: DataFrame) -> DataFrame:
    """Why a base and an update can't be merged: wrong types, or titles that differ ignoring case."""
    problem = F.when(F.coalesce(F.col("base_type"), F.lit("")) != "Game", "base is not a game").when(F.coalesce(F.col("update_type"), F.lit("")) != "Patch", "update is not a patch")
    problem = problem.when(~F.lower("base_title_id").eqNullSafe(F.lower("update_title_id")), "title ids differ")
    return pairs.withColumn("problem", problem).where("problem is not null")


def request_problems(request: dict) -> list[str]:
    """What is wrong with a merge request: missing paths, negative workers, or an output that is an input."""
    out = [f"{name} is required" for name in ("base", "update", "output") if not str(request.get(name) or "").strip()]
    if (request.get("workers") or 0) < 0:
        out.append("workers must not be negative")
    if request.get("output") and request["output"] in (request.get("base"), request.get("update")):
        out.append("output must differ from the inputs")
    return out
