"""Reports and files written from relations."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, INODE_SIZE, PFSC_MAGIC, SFO_FORMATS, STRUCTURAL_INODES, SWEEP_COLUMNS, SYSTEM_ENTRIES, TROPHY_PATTERNS
from lithospark.functions.paths import is_traversal, normalize_key
from lithospark.functions.scalars import scrub
from lithospark.operators.classify import trophy_rank


def sweep_lines(report: DataFrame) -> DataFrame:
    """The nine columns of a sweep report; tabs and line ends are scrubbed in title and error."""
    source = {"File": "file", "Result": "status", "Type": "type", "Title": "title", "TitleId": "title_id", "ContentId": "content_id", "Category": "category", "Passcode": "passcode", "Error": "error"}
    value = lambda c: F.coalesce(F.col(source[c]), F.lit("")) if source[c] in report.columns else F.lit("")
    return report.select(*(scrub(value(c)).alias(c) if c in ("Title", "Error") else value(c).alias(c) for c in SWEEP_COLUMNS))


def write_sweep(report: DataFrame, path: str) -> None:
    """One tab-separated file in the order of the files' names, with a byte order mark and a header. Rows are streamed."""
    system, target = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(target) as out:
        out.write(b"\xef\xbb\xbf" + "\t".join(SWEEP_COLUMNS).encode() + b"\r\n")
        for row in sweep_lines(report).orderBy("File").toLocalIterator(prefetchPartitions=True):
            out.write("\t".join(row).encode() + b"\r\n")


def profile_json(policies: DataFrame, group: str = "file") -> DataFrame:
    """(file, json): a profile's policies by normalised path, without those that are none. A profile is one document."""
    kept = policies.where("policy <> 'none'").select(group, normalize_key(F.col("path")).alias("path"), F.col("policy"))
    entries = F.sort_array(F.collect_list(F.struct("path", "policy")))
    return kept.groupBy(group).agg(F.to_json(F.struct(F.lit(1).alias("Version"), F.map_from_entries(entries).alias("Files"))).alias("json"))


def build_manifest(files: DataFrame, project: dict, facts: dict, n_entries: int = 0) -> DataFrame:
    """(json): what was built, in one row. files: (path, size) of the image.

    project has content_id, title_id, title and volume_type; facts has what is
    known of inner_size, container_size, outer_size, package_size, mode, time
    and sha256. What is not known is null.
    """
    from lithospark.operators.aggregate import directory_totals

    inodes = F.col("files") + F.col("directories") + STRUCTURAL_INODES
    blocks = F.ceil(inodes * INODE_SIZE / F.lit(BLOCK))
    value = lambda v, kind="string": F.lit(v).cast(kind)
    fields = [
        value("lithospark").alias("tool"), value(facts.get("version")).alias("version"), value(facts.get("time")).alias("buildTimestamp"), value(project.get("content_id", "")).alias("contentId"), value(project.get("title_id", "")).alias("titleId"),
        value(project.get("title", "")).alias("title"), value(project.get("volume_type", "")).alias("packageType"), value(facts.get("mode")).alias("pfscMode"), F.col("files").alias("fileCount"), F.col("directories").alias("directoryCount"),
        value(facts.get("inner_size"), "long").alias("innerPfsSize"), value(facts.get("container_size"), "long").alias("pfscSize"), value(facts.get("outer_size"), "long").alias("outerPfsSize"), value(facts.get("package_size"), "long").alias("pkgSize"),
        inodes.alias("inodeCount"), blocks.alias("inodeBlockCount"), F.lit(n_entries + SYSTEM_ENTRIES).alias("sc0EntryCount"), value(facts.get("sha256")).alias("sha256"),
    ]
    return directory_totals(files).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def project_xml(project: dict, files: list[tuple[str, str, str]], directories: list[str]) -> str:
    """A project document: values, files (target, origin, compression) and the tree of their directories."""
    tree: dict = {}
    for path in [*(f[0].rsplit("/", 1)[0] for f in files if "/" in f[0]), *directories]:
        node = tree
        for part in filter(None, path.split("/")):
            node = node.setdefault(part, {})

    def dirs(node: dict, depth: int) -> Iterator[str]:
        for name in sorted(node, key=lambda n: (n.lower(), n)):
            pad = "  " * depth
            if node[name]:
                yield f"{pad}<dir targ_name={quoteattr(name)}>"
                yield from dirs(node[name], depth + 1)
                yield f"{pad}</dir>"
            else:
                yield f"{pad}<dir targ_name={quoteattr(name)}/>"

    values = " ".join(f"{k}={quoteattr(str(v))}" for k, v in project.items() if k != "volume_type")
    lines = ['<?xml version="1.1" encoding="utf-8" standalone="yes"?>', "<psproject>", "  <volume>", f"    <volume_type>{project.get('volume_type', '')}</volume_type>", f"    <package {values}/>", "  </volume>", "  <files>"]
    lines += [f"    <file targ_path={quoteattr(t)} orig_path={quoteattr(o)} pfs_compression={quoteattr(c)}/>" for t, o, c in files]
    return "\n".join([*lines, "  </files>", "  <rootdir>", *dirs(tree, 2), "  </rootdir>", "</psproject>", ""])


def sfo_bytes(rows: pd.DataFrame) -> bytes:
    """A metadata file of key, format, max_length, number and text; keys in order, values at the distance of their greatest length."""
    code = {v: k for k, v in SFO_FORMATS.items()}
    rows = rows.sort_values("key")
    n, names, data, table = len(rows), b"", b"", b""
    for r in rows.itertuples():
        body = struct.pack("<i", int(r.number)) if r.format == "int32" else str(r.text or "").encode() + (b"\0" if r.format == "utf8" else b"")
        most = max(int(r.max_length), 4 if r.format == "int32" else 1)
        table += struct.pack("<2H3I", len(names), code[r.format], len(body), most, len(data))
        names += r.key.encode() + b"\0"
        data += body[:most].ljust(most, b"\0")
    keys = 0x14 + 16 * n
    start = -(-(keys + len(names)) // 4) * 4
    return (b"\0PSF" + struct.pack("<4I", 0x101, keys, start, n) + table + names).ljust(start, b"\0") + data


def sfo_files(values: DataFrame) -> DataFrame:
    """(file, content) from (file, key, format, max_length, number, text)."""
    return values.groupBy("file").applyInPandas(lambda rows: pd.DataFrame({"file": [rows.file.iloc[0]], "content": [sfo_bytes(rows)]}), "file string, content binary")


def trophy_bytes(rows: pd.DataFrame) -> bytes:
    """A trophy archive of (name, data) rows in their given order, data at multiples of 16, with the digest of the whole."""
    at, table, body = 0x60 + 0x40 * len(rows), b"", b""
    for name, data in zip(rows.name, rows.data, strict=True):
        flag = 3 if name.upper().endswith(".ESFM") else 1 if name.upper().endswith(".SFM") else 0
        table += name.encode("latin-1")[:32].ljust(32, b"\0") + struct.pack(">4I", 0, at + len(body), 0, len(data)) + struct.pack(">I", flag) + bytes(12)
        body += data + bytes(-len(data) % 16)
    head = struct.pack(">IIQIII", 0xDCA24D00, 3, at + len(body), len(rows), 0x40, 0)
    whole = bytearray((head + bytes(20) + b"010\0").ljust(0x60, b"\0") + table + body)
    whole[0x1C:0x30] = hashlib.sha1(whole).digest()
    return bytes(whole)


def trophy_files(entries: DataFrame) -> DataFrame:
    """(file, content) from (file, name, data); entries by class and name."""
    assert len(TROPHY_PATTERNS) == 8
    ranked = entries.withColumn("_rank", trophy_rank(F.col("name")))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_low=rows.name.str.lower()).sort_values(["_rank", "_low", "name"])
        return pd.DataFrame({"file": [rows.file.iloc[0]], "content": [trophy_bytes(rows)]})

    return ranked.groupBy("file").applyInPandas(build, "file string, content binary")


def container_layout(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """blocks (file, block_no, stored) with offset, where each lies in a compressed container."""
    from lithospark.operators.windows import running_before

    n = blocks.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    start = (F.ceil((F.lit(0x400) + (F.col("_n") + 1) * 8) / F.lit(BLOCK)) * F.lit(BLOCK)).cast("long")
    sized = blocks.withColumn("_len", F.octet_length("stored"))
    placed = running_before(sized, "_len", ["block_no"], "offset", ["file"]).join(n, "file")
    return placed.withColumn("offset", F.col("offset") + F.greatest(start, F.lit(BLOCK))).drop("_len", "_n")


def write_containers(placed: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes each file's container below folder, under a temporary name first; gives (file, path, bytes).

    Blocks come sorted and are written as they pass, the table last, so a
    container of any size takes the memory of one block.
    """
    sorted_ = placed.select("file", "block_no", "offset", "stored").repartition("file").sortWithinPartitions("file", "block_no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        name, out, table, parts, at = None, None, [], None, 0

        def finish() -> pd.DataFrame:
            n = len(table)
            start = table[0]
            head = PFSC_MAGIC + struct.pack("<5I3Q", 0, 6, block, 0x10000, 0, 0x400, start, n * block)
            index = struct.pack(f"<{n + 1}Q", *table, at)
            out.close()
            path = f"{root}/{name}"
            with system.open_output_stream(path + ".tmp") as whole:
                whole.write((head.ljust(0x400, b"\0") + index).ljust(start, b"\0"))
                with system.open_input_stream(parts) as body:
                    while data := body.read(1 << 20):
                        whole.write(data)
            system.delete_file(parts)
            system.move(path + ".tmp", path)
            return pd.DataFrame({"file": [name], "path": [f"{folder}/{name}"], "bytes": [at]})

        for frame in frames:
            for f, offset, stored in zip(frame.file, frame.offset, frame.stored, strict=True):
                if f != name:
                    if out is not None:
                        yield finish()
                    name, table, parts = f, [], f"{root}/{f}.blocks.tmp"
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(parts)
                out.write(stored)
                table.append(int(offset))
                at = int(offset) + len(stored)
        if out is not None:
            yield finish()

    return sorted_.mapInPandas(run, "file string, path string, bytes long")


def extract(files: DataFrame, folder: str, continue_on_error: bool = True) -> DataFrame:
    """Writes (path, data) rows below folder; gives (path, error) for those that fail. The action runs when the result is read.

    Each file goes to a temporary name and is renamed. Paths that would leave
    the folder, and rows without data, fail; others are not affected, unless
    continue_on_error is off.
    """
    guarded = files.select("path", "data", is_traversal(F.col("path")).alias("_out"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for frame in frames:
            failed = []
            for path, data, leaves in zip(frame.path, frame.data, frame._out, strict=True):
                try:
                    if leaves:
                        raise ValueError("path leaves the folder")
                    if data is None:
                        raise ValueError("no data")
                    target = f"{root}/{path}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(target + ".tmp") as out:
                        out.write(data)
                    system.move(target + ".tmp", target)
                except (OSError, ValueError) as e:
                    if not continue_on_error:
                        raise
                    failed.append((path, str(e)))
            yield pd.DataFrame(failed, columns=["path", "error"], dtype="str")

    return guarded.mapInPandas(run, "path string, error string")


def wav_bytes(samples: list[int], channels: int, rate: int, loop: tuple[int, int] | None = None) -> bytes:
    """16-bit PCM; the extensible form for more than two channels, and a loop chunk where there is a loop."""
    data = struct.pack(f"<{len(samples)}h", *samples)
    form = struct.pack("<HHIIHH", 0xFFFE if channels > 2 else 1, channels, rate, rate * channels * 2, channels * 2, 16)
    if channels > 2:
        form += struct.pack("<HHI", 22, 16, (1 << channels) - 1) + struct.pack("<I", 1) + bytes.fromhex("000010008000") + bytes.fromhex("00aa00389b71")
    chunks = b"fmt " + struct.pack("<I", len(form)) + form
    if loop is not None:
        body = struct.pack("<9I", 0, 0, 1_000_000_000 // rate, 60, 0, 0, 0, 1, 0) + struct.pack("<6I", 0, 0, loop[0], loop[1], 0, 0)
        chunks += b"smpl" + struct.pack("<I", len(body)) + body
    chunks += b"data" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def console_listing(listing: DataFrame) -> DataFrame:
    """(line): F or D, size and path of each row, in path order."""
    return listing.orderBy(F.lower("path"), "path").select(F.concat_ws(" ", F.when(F.col("is_directory"), "D 0").otherwise(F.concat(F.lit("F "), F.col("size").cast("string"))), F.col("path")).alias("line"))
