"""Integrity rules. Each gives violations as rows: (file, stage, ordinal, structure, offset, reason, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, ENTRY_ALIGN, IMAGE_ALIGN, KEY_FILES
from lithospark.functions.hashes import is_all_zero
from lithospark.functions.scalars import align
from lithospark.operators.joins import unreferenced_inodes
from lithospark.operators.windows import falling, stored_sizes

COLUMNS = ["file", "stage", "ordinal", "structure", "offset", "reason", "severity"]


def violation(rows: DataFrame, when: Column, stage: int, structure: str, reason: str, offset: str | None = None, ordinal: str | None = None, severity: str = "failure") -> DataFrame:
    """Rows for which a condition holds, as violations. A condition that is null holds not."""
    zero = F.lit(0).cast("long")
    return rows.where(when).select(
        "file", F.lit(stage).alias("stage"), (F.col(ordinal).cast("long") if ordinal else zero).alias("ordinal"), F.lit(structure).alias("structure"),
        (F.col(offset).cast("long") if offset else zero).alias("offset"), F.lit(reason).alias("reason"), F.lit(severity).alias("severity"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def header_violations(headers: DataFrame) -> DataFrame:
    """V1-V3: the image begins somewhere, aligned, and ends within the file."""
    at, size = F.col("pfs_image_offset"), F.col("pfs_image_size")
    return union([
        violation(headers, at == 0, 1, "header", "image offset is zero", "pfs_image_offset"),
        violation(headers, at % IMAGE_ALIGN != 0, 1, "header", "image offset is not aligned", "pfs_image_offset"),
        violation(headers, (at < 0) | (size < 0) | (at + size > F.col("file_size")), 1, "header", "image ends beyond the file", "pfs_image_offset"),
    ])


def entry_violations(entries: DataFrame, stored: Column | None = None) -> DataFrame:
    """V5, V6: an entry's stored range lies in the file, and an encrypted one is aligned. One pass over the entries."""
    size = stored if stored is not None else F.when(F.col("is_encrypted"), align(F.col("data_size"), ENTRY_ALIGN)).otherwise(F.col("data_size"))
    at = F.col("data_offset")
    found = F.filter(
        F.array(
            F.when(at + size > F.col("file_size"), F.struct(F.lit(1).alias("stage"), F.lit("range").alias("reason"))),
            F.when(F.col("is_encrypted") & (at % ENTRY_ALIGN != 0), F.struct(F.lit(2).alias("stage"), F.lit("alignment").alias("reason"))),
        ),
        lambda v: v.isNotNull(),
    )
    return entries.select("file", "ordinal", F.lit("entry").alias("structure"), at.cast("long").alias("offset"), F.explode(found).alias("v")).select(
        "file", "v.stage", F.col("ordinal").cast("long").alias("ordinal"), "structure", "offset", "v.reason", F.lit("failure").alias("severity")
    )


def duplicate_violations(entries: DataFrame) -> DataFrame:
    """V4: no two entries of a file share an id."""
    twice = entries.groupBy("file", "id").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("ordinal")).where("n > 1")
    return violation(twice, F.lit(True), 1, "entry", "duplicate id", ordinal="ordinal")


def inode_violations(inodes: DataFrame, pointers: DataFrame, image_blocks: Column, stage: int = 2) -> DataFrame:
    """V7-V9: inodes are in use, their blocks lie in the image, and no block has two owners.

    inodes: (file, inode, mode); pointers: (file, inode, block). -1 marks a run, and no pointer is 0.
    """
    real = pointers.where("block > 0")
    shared = real.groupBy("file", "block").agg(F.countDistinct("inode").alias("owners"), F.min("inode").alias("inode")).where("owners > 1")
    return union([
        violation(inodes, F.col("mode") == 0, stage, "inode", "inode is not in use", ordinal="inode"),
        violation(real, F.col("block") >= image_blocks, stage, "inode", "block lies beyond the image", "block", "inode"),
        violation(shared, F.lit(True), stage, "block", "block has several owners", "block", "inode"),
    ])


def container_violations(headers: DataFrame) -> DataFrame:
    """Magic, offsets, sizes and table of a compressed container."""
    data, at, size, block = F.col("data_offset"), F.col("table_offset"), F.col("rounded_size"), F.col("block_size")
    entries = (size / F.greatest(block, F.lit(1))).cast("long") + 1
    return union([
        violation(headers, F.col("magic") != "PFSC", 3, "container", "bad magic"),
        violation(headers, (data < BLOCK) | (data % BLOCK != 0), 3, "container", "bad data offset", "data_offset"),
        violation(headers, (at <= 0) | (at >= data), 3, "container", "bad table offset", "table_offset"),
        violation(headers, (size <= 0) | (block <= 0) | F.coalesce(size % F.nullif(block, F.lit(0)) != 0, F.lit(True)), 3, "container", "bad size", "rounded_size"),
        violation(headers, (at + entries * 8 > data) | (at + entries * 8 > F.col("file_size")), 3, "container", "table overlaps the data", "table_offset"),
        violation(headers, (block <= 0) | (block.bitwiseAND(block - 1) != 0), 3, "container", "block size is no power of two", "block_size"),
    ])


def table_violations(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Offsets never fall, stored sizes fit in a block, and the last offset is the file's length."""
    down = falling(blocks, "offset", ["block_no"], ["file"])
    last = blocks.groupBy("file").agg(F.max_by("offset", "block_no").alias("last"), F.max("block_no").alias("block_no")).join(headers.select("file", "file_size"), "file")
    sized = stored_sizes(blocks).withColumnRenamed("stored_size", "stored").join(headers.select("file", "block_size"), "file")
    return union([
        violation(down, F.lit(True), 3, "table", "offset falls", "offset", "block_no"),
        violation(last, F.col("last") != F.col("file_size"), 3, "table", "table does not end with the file", "last", "block_no"),
        violation(sized, F.col("stored") > F.col("block_size"), 3, "table", "stored size exceeds the block size", "offset", "block_no"),
    ])


def content_violations(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Every block inflates to its size (content is null where it did not), and all together have the file's size."""
    total = blocks.groupBy("file").agg(F.sum(F.octet_length("content")).alias("total")).join(headers.select("file", "rounded_size"), "file")
    return union([
        violation(blocks, F.col("content").isNull(), 3, "block", "block does not inflate", "offset", "block_no"),
        violation(total, F.coalesce(F.col("total"), F.lit(0)) != F.col("rounded_size"), 3, "container", "content has another size"),
    ])


def digest_violations(digests: DataFrame, tolerant: bool = False, stage: int = 5) -> DataFrame:
    """Stored and computed digests agree; with tolerant, an all-zero stored digest is a warning.

    digests: (file, ordinal, structure, stored, computed), both binary.
    """
    severity = F.when(is_all_zero(F.col("stored")) & F.lit(tolerant), "warning").otherwise("failure")
    wrong = digests.where(~F.col("stored").eqNullSafe(F.col("computed")))
    return wrong.select("file", F.lit(stage).alias("stage"), F.col("ordinal").cast("long").alias("ordinal"), "structure", F.lit(0).cast("long").alias("offset"), F.lit("digest differs").alias("reason"), severity.alias("severity"))


def listing_violations(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Every file lists something."""
    return violation(files.select("file").join(listing.select("file"), "file", "left_anti"), F.lit(True), 7, "listing", "nothing is listed")


def verified_entries(entries: DataFrame, payloads: DataFrame, digests: DataFrame) -> DataFrame:
    """(file, ordinal, id, status) for each entry: OK, FAIL, or SKIPPED for the first one and those out of bounds.

    A payload reaches to the next greater offset at most. payloads: (file, ordinal, data) of stored bytes; digests: (file, ordinal, stored).
    """
    after = F.min("data_offset").over(Window.partitionBy("file").orderBy("data_offset").rangeBetween(1, Window.unboundedFollowing))
    bounded = entries.withColumn("_room", F.coalesce(after, F.col("file_size")) - F.col("data_offset"))
    joined = bounded.join(digests.select("file", "ordinal", "stored"), ["file", "ordinal"], "left").join(payloads.select("file", "ordinal", "data"), ["file", "ordinal"], "left")
    size = F.least(F.col("data_size"), F.col("_room")).cast("int")
    same = F.sha2(F.substring(F.col("data"), F.lit(1), size), 256) == F.lower(F.hex("stored"))
    status = F.when((F.col("ordinal") == 0) | F.col("data").isNull() | F.col("stored").isNull() | (F.col("data_offset") + F.col("data_size") > F.col("file_size")), "SKIPPED").when(same, "OK").otherwise("FAIL")
    return joined.select("file", "ordinal", "id", status.alias("status"))


def sfo_violations(files: DataFrame, values: DataFrame) -> DataFrame:
    """A metadata file has its magic and at least one value; files: (file, magic_ok)."""
    empty = files.where("magic_ok").join(values.select("file"), "file", "left_anti")
    return union([violation(files, ~F.col("magic_ok"), 1, "sfo", "bad magic"), violation(empty, F.lit(True), 1, "sfo", "no values")])


def dump_violations(dumps: DataFrame, listing: DataFrame) -> DataFrame:
    """A folder dump has an Image0 area and its key files, and an Sc0 area with its metadata.

    dumps: (file) names each dump; listing: (file, area, path).
    """
    have = listing.select("file", "area", F.lower("path").alias("path"))
    without = lambda on: dumps.select("file").join(on.select("file"), "file", "left_anti")
    parts = [
        violation(without(have.where("area = 'Image0'")), F.lit(True), 1, "dump", "Image0 is missing"),
        violation(without(have.where("area = 'Sc0' and path = 'param.sfo'")), F.lit(True), 1, "dump", "Sc0/param.sfo is missing"),
    ]
    parts += [violation(without(have.where((F.col("area") == "Image0") & (F.col("path") == name))), F.lit(True), 2, "dump", f"{name} is missing", severity="warning") for name in KEY_FILES]
    return union(parts)


def consumer_violations(inodes: DataFrame, ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files have an inode in range, a path, and a block range within the table whose ends do not fall.

    ranges: (file, ordinal, path, inode, start_block, block_count); blocks: (file, block_no, offset).
    """
    counts = inodes.groupBy("file").agg((F.max("inode") + 1).alias("inodes"))
    tables = blocks.groupBy("file").agg(F.max("block_no").alias("blocks"))
    known = ranges.join(counts, "file", "left").join(tables, "file", "left")
    start, n = F.col("start_block"), F.col("block_count")
    ends = (
        ranges.withColumn("block_no", start).join(blocks.withColumnRenamed("offset", "_low"), ["file", "block_no"]).drop("block_no")
        .withColumn("block_no", start + n).join(blocks.withColumnRenamed("offset", "_high"), ["file", "block_no"])
    )
    return union([
        violation(known, (F.col("inode") < 0) | (F.col("inode") >= F.coalesce("inodes", F.lit(0))), 8, "file", "inode is out of range", "inode", "ordinal"),
        violation(known, F.coalesce(F.col("path"), F.lit("")) == "", 8, "file", "path is empty", ordinal="ordinal"),
        violation(known, n <= 0, 8, "file", "block count is not positive", "start_block", "ordinal"),
        violation(known, (start < 0) | (start + n > F.coalesce("blocks", F.lit(0))), 8, "file", "range lies beyond the table", "start_block", "ordinal"),
        violation(ends, F.col("_high") < F.col("_low"), 8, "file", "table falls within the range", "start_block", "ordinal"),
    ])


def scan_counters(headers: DataFrame, inodes: DataFrame, dirents: DataFrame, longest_name: int = 255) -> DataFrame:
    """Declared and reached inodes, unreferenced ones, and records of implausible size, for each image."""
    reached = dirents.groupBy("file").agg(
        F.countDistinct("inode").alias("reached"), F.count_if((F.col("name_length") <= 0) | (F.col("name_length") > longest_name)).alias("bad_names"), F.count_if((F.col("entry_size") < 17) | (F.col("entry_size") % 8 != 0)).alias("bad_sizes")
    )
    loose = unreferenced_inodes(inodes, dirents).groupBy("file").agg(F.count(F.lit(1)).alias("unreferenced"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return headers.select("file", F.col("dinode_count").alias("declared")).join(reached, "file", "left").join(loose, "file", "left").select("file", "declared", *(zero(c) for c in ("reached", "unreferenced", "bad_names", "bad_sizes")))


def audio_violations(files: DataFrame) -> DataFrame:
    """Form, chunks, channels and loop bounds of audio files, from their metadata rows."""
    return union([
        violation(files, F.col("form") != "WAVE", 1, "audio", "form is not WAVE"),
        violation(files, ~F.col("has_fmt"), 1, "audio", "no format chunk"),
        violation(files, ~F.col("has_fact"), 1, "audio", "no fact chunk"),
        violation(files, ~F.col("has_data"), 1, "audio", "no data chunk"),
        violation(files, (F.col("channels") < 1) | (F.col("channels") > 8), 1, "audio", "bad number of channels"),
        violation(files, (F.col("loop_start") > F.col("loop_end")) | (F.col("loop_end") > F.col("sample_count")), 1, "audio", "loop lies beyond the samples"),
    ])
