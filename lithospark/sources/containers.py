"""Container files as tables: spark.read.format("strata").option("relation", ...).load(path).

A relation reads only its own bytes: the block table of a container never
touches payloads. Files are opened where the reader runs, through Arrow's file
systems (local paths and the schemes these know), and are read by seeking;
blocks of one container are dealt over several partitions. The option only names
the files to open. Filters are not taken over from the query: in Spark 4.1 a
frame that was read with a pushed filter keeps it in later, unfiltered reads.

A damaged file fails the query, unless the option onError is "row": then
relations give no rows for it, and the relation sweep tells why.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lithospark.sources import layouts

#: Blocks of a container that one partition reads: 16 MiB of content.
PART_BLOCKS = 256

_NUMBERS = ", ".join(f"{name} long" for name, _, _ in layouts.HEADER_FIELDS)
_DIGESTS = ", ".join(f"{name} binary" for name, _ in layouts.HEADER_DIGESTS)

RELATIONS: dict[str, tuple[str, object]] = {
    "header": (f"{_NUMBERS}, {_DIGESTS}, content_id string, is_finalized boolean, file_size long", lambda r, n: [layouts.package_header(r, n)]),
    "entries": (
        "ordinal long, id long, name_offset long, flags1 long, flags2 long, data_offset long, data_size long, is_encrypted boolean, key_index int, file_size long, raw binary",
        layouts.package_entries,
    ),
    "names": ("ordinal long, offset long, name string", layouts.package_names),
    "payloads": ("ordinal long, id long, is_encrypted boolean, in_bounds boolean, data binary", layouts.entry_payloads),
    "payload_pieces": ("ordinal long, id long, offset long, data binary", layouts.payload_pieces),
    "regions": ("region string, offset long, data binary", layouts.package_regions),
    "image_header": (
        "version long, magic long, id long, fmode short, clean short, read_only short, rsv short, mode int, unk1 int, block_size long, nbackup long, nblock long, dinode_count long, ndblock long, "
        "dinode_block_count long, seed binary, file_size long",
        lambda r, n: [layouts.image_header(r, n)],
    ),
    "inodes": ("inode long, mode int, nlink int, flags long, size long, size_uncompressed long, blocks long, direct array<long>, indirect array<long>, raw binary", layouts.image_inodes),
    "dirents": ("parent long, ordinal long, inode long, type int, name_length int, entry_size int, name string", layouts.image_dirents),
    "image_content": ("inode long, ordinal long, data binary", layouts.image_content),
    "image_blocks": ("inode long, ordinal long, block long", layouts.image_blocks),
    "container_header": (
        "magic string, unk1 long, unk2 long, block_size long, alignment long, unk3 long, table_offset long, data_offset long, rounded_size long, file_size long",
        lambda r, n: [layouts.container_header(r, n)],
    ),
    "container_table": ("block_no long, offset long", layouts.container_table),
    "container_blocks": ("block_no long, offset long, stored_size long, content binary", layouts.container_blocks),
    "sfo": ("ordinal long, key string, format string, length long, max_length long, number int, text string, value string, data binary", layouts.sfo_values),
    "trophies": ("ordinal long, name string, offset long, size long, data binary", layouts.trophy_entries),
    "audio": (
        "form string, has_fmt boolean, has_fact boolean, has_data boolean, format_tag int, channels int, sample_rate int, block_align int, config binary, sample_count int, delay int, loop_start int, "
        "loop_end int, frames long",
        lambda r, n: [layouts.audio_metadata(r, n)],
    ),
    "sweep": ("status string, content_id string, content_type long, category string, title string, title_id string, version string, error string", None),
}


#: Relations of an image; a compressed container that holds one is opened on the way.
IMAGES = {"image_header", "inodes", "dirents", "image_content", "image_blocks"}


def swept(read, size: int) -> dict:
    """What a package says of itself, or why it can't be read. Nothing is kept from before an error."""
    row = dict.fromkeys(("content_id", "content_type", "category", "title", "title_id", "version", "error"))
    try:
        head = layouts.package_header(read, size)
        sfo = next((e for e in layouts.package_entries(read, size) if e["id"] == 0x1000), None)
        values = {}
        if sfo is not None and not sfo["is_encrypted"]:
            body = read(sfo["data_offset"], sfo["data_size"])
            for v in layouts.sfo_values(lambda a, n: body[a : a + n], len(body)):
                values.setdefault(v["key"].lower(), v["value"])
        named = {"category": "category", "title": "title", "title_id": "title_id", "version": "app_ver"}
        return row | {"status": "OK", "content_id": head["content_id"], "content_type": head["content_type"]} | {k: values.get(v) or "" for k, v in named.items()}
    except ValueError as e:
        return row | {"status": "FAIL", "error": str(e)}


class Part(InputPartition):
    def __init__(self, path: str, size: int, first: int | None = None, last: int | None = None, is_last: bool = True):
        super().__init__((path, first))
        self.path, self.size, self.first, self.last, self.is_last = path, size, first, last, is_last


def found(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files below a folder, or the file itself, with sizes."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in files if f.path.lower().endswith(suffix.lower()))


class StrataReader(DataSourceReader):
    def __init__(self, relation: str, path: str, suffix: str, lenient: bool, only: set[str]):
        self.relation, self.path, self.suffix, self.lenient, self.only = relation, path, suffix, lenient, only

    def partitions(self) -> Sequence[InputPartition]:
        parts: list[Part] = []
        for path, size in found(self.path, self.suffix):
            if self.only and path not in self.only:
                continue
            if self.relation in ("container_table", "container_blocks"):
                try:
                    with _open(path) as read:
                        head = layouts.container_header(read, size)
                    n = head["rounded_size"] // max(1, head["block_size"])
                except ValueError:
                    n = 0  # the reader meets the error again
                step = PART_BLOCKS if self.relation == "container_blocks" else PART_BLOCKS * 4096
                parts += [Part(path, size, a, min(n, a + step), a + step >= n) for a in range(0, max(n, 1), step)]
            else:
                parts.append(Part(path, size))
        return parts

    def read(self, part: Part | None) -> Iterator[tuple]:
        if part is None:  # a folder without such files
            return
        schema, scan = RELATIONS[self.relation]
        names = [f.split()[0] for f in schema.split(", ")]
        with _open(part.path) as read:
            try:
                if scan is None:
                    rows = [swept(read, part.size)]
                elif self.relation in IMAGES:
                    rows = scan(*layouts.unwrapped(read, part.size))
                elif part.first is None:
                    rows = scan(read, part.size)
                else:
                    rows = scan(read, part.size, part.first, part.last)
                for row in rows:
                    # The offset that ends a part begins the next one; only the last part gives it.
                    if self.relation != "container_table" or row["block_no"] < part.last or part.is_last:
                        yield (part.path, *(row[n] for n in names))
            except ValueError:
                if not self.lenient:
                    raise


class _open:
    """The file as a callable (offset, length) -> bytes."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self):
        system, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        self.file = system.open_input_file(name)

        def read(offset: int, length: int) -> bytes:
            size = self.file.size()
            return self.file.read_at(max(0, min(length, size - offset)), offset) if 0 <= offset < size and length > 0 else b""

        return read

    def __exit__(self, *_):
        self.file.close()


class StrataSource(DataSource):
    """Options: relation (see RELATIONS), path, suffix (of file names), only (files to open, one a line), onError (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "strata"

    def _relation(self) -> str:
        relation = self.options.get("relation", "sweep")
        if relation not in RELATIONS:
            raise ValueError(f"unknown relation {relation}; there are {', '.join(sorted(RELATIONS))}")
        return relation

    def schema(self) -> str:
        return "file string, " + RELATIONS[self._relation()][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return StrataReader(self._relation(), self.options["path"], self.options.get("suffix", ""), self.options.get("onerror", self.options.get("onError", "fail")) == "row", set(filter(None, self.options.get("only", "").split("\n"))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrataSource)
