"""A plaintext file system image laid out and written from relations.

Everything is a relation of (offset, bytes): the header, the inode table, the
records of every directory, the table of path hashes with its resolver, and the
content of files. A writer sorts the pieces and streams them into one file.

Blocks: 0 the header, then inodes, the super root's records, the path table, one
empty block (or the resolver), the user root's records, directories, files.
Inodes: super root, path table, resolver if two paths share a hash, user root,
directories, files; both in the order of their paths' segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, INODE_SIZE, PFS_MAGIC
from lithospark.functions.hashes import hash31
from lithospark.functions.paths import basename, dirname
from lithospark.functions.scalars import blocks_of, dirent_size
from lithospark.operators import overlay, windows
from lithospark.session import cut

# Modes and flags of inodes, kinds of records, and the pad after a resolver's group.
DIRECTORY_MODE, FILE_MODE = 0x416D, 0x816D
INNER_FLAGS, OUTER_FLAGS = 0x10, 0x20010
FILE, DIRECTORY, DOT, DOT_DOT = 2, 3, 4, 5
RESOLVER_PAD = 0x18
HEADER_MODE = 0x8


@dataclass
class Layout:
    """nodes: (path, is_directory, inode, size, blocks, start_block, links, hash, slot); records: (block, offset, inode, type, name); facts: numbers of the image."""

    nodes: DataFrame
    records: DataFrame
    facts: dict[str, int]


def ceil_blocks(n: int) -> int:
    return -(-n // BLOCK)


def image_layout(files: DataFrame, directories: DataFrame | None = None) -> Layout:
    """The layout of an image that holds files (path, size), and directories (path) that may be empty. Case counts in names.

    Numbers of nodes and a few sums come to the driver, and no relation does.
    """
    own = files.select("path", F.lit(False).alias("is_directory"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    folders = overlay.parent_closure(files, fold=False)
    if directories is not None:
        named = directories.select(F.regexp_replace("path", "/+$", "").alias("path"))
        folders = folders.unionByName(named).unionByName(overlay.parent_closure(named, fold=False)).distinct()
    nodes = cut(folders.select("path", F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size")).unionByName(own).withColumn("hash", hash31(F.concat(F.lit("/"), "path"))))
    shared = nodes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    n, collides = nodes.count(), not shared.isEmpty()
    root = 3 if collides else 2
    numbered = cut(windows.ordinals(nodes, start=root + 1).withColumnRenamed("ordinal", "inode"))
    count = root + 1 + n
    super_block = 1 + -(-count // (BLOCK // INODE_SIZE))
    table_block = super_block + 1
    resolver_block = table_block + ceil_blocks(8 * n)
    root_block = resolver_block + 1
    # Records of each directory, in order; one that would cross a block's end starts the next block.
    inside = numbered.select(dirname(F.col("path")).alias("in"), F.col("inode").alias("target"), F.when(F.col("is_directory"), DIRECTORY).otherwise(FILE).alias("type"), basename(F.col("path")).alias("name"))
    places = numbered.where("is_directory").select("path", "inode").unionByName(nodes.sparkSession.createDataFrame([("", root)], "path string, inode long"))
    above = places.select(F.col("path").alias("up"), F.col("inode").alias("up_inode"))
    places = places.join(above, F.when(F.col("path") == "", "").otherwise(dirname(F.col("path"))) == F.col("up"))
    dots = places.select(F.col("path").alias("in"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("inode").alias("target"), F.lit(DOT).alias("type"), F.lit(".").alias("name")), F.struct(F.lit(1).alias("o"), F.col("up_inode").alias("target"), F.lit(DOT_DOT).alias("type"), F.lit("..").alias("name")))).alias("r")).select("in", "r.*")
    every = dots.unionByName(inside.withColumn("o", F.lit(2)))
    listed = every.groupBy("in").agg(F.sort_array(F.collect_list(F.struct("o", "target", "type", "name"))).alias("r"))  # a directory is one unit
    placed = listed.withColumn("at", windows.packed_dirents(F.col("r.name")))
    end = F.element_at("at", -1) + dirent_size(F.octet_length(F.element_at("r.name", -1)).cast("long"))
    placed = cut(placed.select("in", "r", "at", end.alias("bytes"), F.size(F.filter("r", lambda r: r["type"] == DIRECTORY)).alias("subs")))
    root_bytes, root_subs = placed.where("`in` = ''").select("bytes", "subs").first()
    sized = numbered.join(placed.select(F.col("in").alias("path"), F.lit(True).alias("is_directory"), "bytes", "subs"), ["path", "is_directory"], "left").withColumn("blocks", blocks_of(F.coalesce("bytes", "size")))
    base = root_block + ceil_blocks(root_bytes)
    laid = windows.running_before(sized, "blocks", ["inode"], "start_block").withColumn("start_block", F.col("start_block") + base)
    # The resolver: for each shared hash the records of its paths, and a pad; the table's slots lead there by byte offset.
    full = F.concat(F.lit("/"), F.col("path"))
    groups = numbered.join(shared, "hash").groupBy("hash").agg(F.sum(dirent_size(F.octet_length(full).cast("long"))).alias("bytes"))
    resolved = windows.running_before(groups.withColumn("bytes", F.col("bytes") + RESOLVER_PAD), "bytes", ["hash"], "resolver")
    laid = laid.drop("bytes").join(resolved.select("hash", "resolver"), "hash", "left")
    slot = F.when(F.col("resolver").isNotNull(), F.lit(0x80000000) + F.col("resolver")).when(F.col("is_directory"), F.col("inode") + F.lit(0x20000000)).otherwise(F.col("inode"))
    final = cut(laid.select("path", "is_directory", "inode", F.when(F.col("is_directory"), F.col("blocks") * BLOCK).otherwise(F.col("size")).alias("size"), "blocks", "start_block", F.when(F.col("is_directory"), F.col("subs") + 2).otherwise(1).alias("links"), "hash", slot.alias("slot"), "resolver"))
    homes = final.where("is_directory").select(F.col("path").alias("in"), "start_block").unionByName(nodes.sparkSession.createDataFrame([("", root_block)], "in string, start_block long"))
    records = placed.join(homes, "in").select("start_block", F.explode(F.arrays_zip("at", "r")).alias("x")).select(F.col("start_block").alias("block"), F.col("x.at").alias("offset"), F.col("x.r.target").alias("inode"), F.col("x.r.type").alias("type"), F.col("x.r.name").alias("name"))
    facts = {
        "root": root, "inodes": count, "inode_blocks": super_block - 1, "super_block": super_block, "table_block": table_block, "table_bytes": 8 * n, "resolver_block": resolver_block, "root_block": root_block, "root_links": 3 + root_subs,
        "root_blocks": ceil_blocks(root_bytes), "resolver_bytes": (resolved.agg(F.sum("bytes")).first()[0] or 0) if collides else 0, "blocks": base + (final.agg(F.sum("blocks")).first()[0] or 0),
    }
    return Layout(final, records, facts)


def _record(inode: int, kind: int, name: str) -> bytes:
    text = name.encode("latin-1", "replace")
    size = -(-(len(text) + 17) // 8) * 8
    return (struct.pack("<I3i", inode, kind, len(text), size) + text).ljust(size, b"\0")


def _inode(mode: int, links: int, flags: int, size: int, blocks: int, start: int) -> bytes:
    direct = [start] + [-1 if blocks > 1 else 0] * 11
    return (struct.pack("<2HI2q", mode, links, flags, size, size).ljust(0x60, b"\0") + struct.pack("<I17i", blocks, *direct, *[0] * 5)).ljust(INODE_SIZE, b"\0")


def _packed(rows: DataFrame, offset: str, make) -> DataFrame:
    """(offset, data) with the bytes that make gives for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"offset": frame[offset], "data": [make(r) for r in frame.itertuples()]})

    return rows.mapInPandas(run, "offset long, data binary")


def image_pieces(layout: Layout, contents: DataFrame) -> DataFrame:
    """(offset, data) of all that an image holds. contents: (path, offset, data) in pieces of any size."""
    f, spark = layout.facts, contents.sparkSession
    head = struct.pack("<3q4B2H2I4q", 1, PFS_MAGIC, 0, 0, 0, 1, 0, HEADER_MODE, 0, BLOCK, 0, 1, f["inodes"], f["blocks"], f["inode_blocks"])
    first = [_inode(DIRECTORY_MODE, 1, OUTER_FLAGS, BLOCK, 1, f["super_block"]), _inode(FILE_MODE, 1, OUTER_FLAGS, f["table_bytes"], ceil_blocks(f["table_bytes"]), f["table_block"])]
    top = [(1, FILE, "flat_path_table")]
    if f["root"] == 3:
        first.append(_inode(FILE_MODE, 1, OUTER_FLAGS, f["resolver_bytes"], ceil_blocks(f["resolver_bytes"]), f["resolver_block"]))
        top.append((2, FILE, "collision_resolver"))
    first.append(_inode(DIRECTORY_MODE, f["root_links"], INNER_FLAGS, f["root_blocks"] * BLOCK, f["root_blocks"], f["root_block"]))
    top.append((f["root"], DIRECTORY, "uroot"))
    fixed = [(0, head), (BLOCK, b"".join(first)), (f["super_block"] * BLOCK, b"".join(_record(*r) for r in top))]
    nodes = layout.nodes
    inodes = _packed(nodes.withColumn("at", windows.inode_position(F.col("inode"), INODE_SIZE)), "at", lambda r: _inode(DIRECTORY_MODE if r.is_directory else FILE_MODE, int(r.links), INNER_FLAGS, int(r.size), int(r.blocks), int(r.start_block)))
    records = _packed(layout.records.withColumn("at", F.col("block") * BLOCK + F.col("offset")), "at", lambda r: _record(int(r.inode), int(r.type), r.name))
    slots = windows.running_before(nodes.withColumn("_eight", F.lit(8)), "_eight", ["hash", "inode"], "at").withColumn("at", F.col("at") + f["table_block"] * BLOCK)
    table = _packed(slots, "at", lambda r: struct.pack("<2I", int(r.hash), int(r.slot)))
    full = nodes.where("resolver is not null").withColumn("name", F.concat(F.lit("/"), "path"))
    length = full.withColumn("_n", dirent_size(F.octet_length("name").cast("long")))
    told = windows.running_before(length, "_n", ["inode"], "_in", ["hash"]).withColumn("at", F.col("_in") + F.col("resolver") + f["resolver_block"] * BLOCK)
    resolver = _packed(told, "at", lambda r: _record(int(r.inode), DIRECTORY if r.is_directory else FILE, r.name))
    body = contents.join(nodes.where("not is_directory").select("path", "start_block"), "path").select((F.col("start_block") * BLOCK + F.col("offset")).alias("offset"), "data")
    return spark.createDataFrame(fixed, "offset long, data binary").unionByName(inodes).unionByName(records).unionByName(table).unionByName(resolver).unionByName(body)


def write_image(layout: Layout, contents: DataFrame, path: str) -> DataFrame:
    """Writes the image under a temporary name and renames it; gives (path, bytes) when the result is read. One task streams the sorted pieces."""
    size = layout.facts["blocks"] * BLOCK
    pieces = image_pieces(layout, contents).repartition(1).sortWithinPartitions("offset")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, target = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        if "/" in target:
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        at = 0

        def zeros(out, until: int) -> int:
            for a in range(at, until, 1 << 20):
                out.write(bytes(min(1 << 20, until - a)))
            return max(at, until)

        with system.open_output_stream(target + ".tmp") as out:
            for frame in frames:
                for offset, data in zip(frame.offset, frame.data, strict=True):
                    if offset < at:
                        raise ValueError(f"two pieces overlap at {offset}")
                    at = zeros(out, int(offset))
                    out.write(data)
                    at += len(data)
            at = zeros(out, size)
        system.move(target + ".tmp", target)
        yield pd.DataFrame({"path": [path], "bytes": [at]})

    return pieces.mapInPandas(run, "path string, bytes long")


def whole_blocks(pieces: DataFrame, n: int) -> DataFrame:
    """(block_no, data) of all n blocks of an image from its pieces, with zeros where none lies. A block holds a bounded number of pieces."""
    cuts = pieces.where(F.octet_length("data") > 0).withColumn("end", F.col("offset") + F.octet_length("data"))
    number = lambda c: F.floor(c / F.lit(BLOCK)).cast("long")
    split = cuts.withColumn("block_no", F.explode(F.sequence(number(F.col("offset")), number(F.col("end") - 1))))
    low, high = F.greatest("offset", F.col("block_no") * BLOCK), F.least("end", (F.col("block_no") + 1) * BLOCK)
    parts = split.select("block_no", (low - F.col("block_no") * BLOCK).cast("int").alias("at"), F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("data"))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = bytearray(BLOCK)
        for at, data in zip(rows["at"], rows["data"], strict=True):
            if data is not None:
                out[int(at) : int(at) + len(data)] = data
        return pd.DataFrame({"block_no": [rows.block_no.iloc[0]], "data": [bytes(out)]})

    every = pieces.sparkSession.range(n).select(F.col("id").alias("block_no"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("data"))
    return parts.unionByName(every).groupBy("block_no").applyInPandas(join, "block_no long, data binary")


def folder_contents(spark, root: str, block: int = BLOCK) -> DataFrame:
    """(path, offset, data) of every file below root, a block a row. A file as a whole must fit in a row."""
    from lithospark.functions.blocks import split_blocks
    from lithospark.sources.documents import relative

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(F.col("path"), root).alias("path"), "content")
    return split_blocks(files, "content", block).select("path", (F.col("block_no") * block).cast("long").alias("offset"), "data")
