"""Images written from relations and read back through the source."""

import random

import pytest
from pyspark.sql import functions as F

from lithospark.functions.hashes import _utf16_hash
from lithospark.operators import joins, rules, trees
from lithospark.plans import image
from lithospark.plans import workflows as w


def written(spark, tmp_path, files, empty=()):
    path = str(tmp_path / "out" / "inner.img")
    listing = spark.createDataFrame([(p, len(d)) for p, d in files.items()], "path string, size long")
    folders = spark.createDataFrame([(p,) for p in empty], "path string") if empty else None
    pieces = [(p, a, d[a : a + 65536]) for p, d in files.items() for a in range(0, len(d), 65536)]
    layout = image.image_layout(listing, folders)
    done = image.write_image(layout, spark.createDataFrame(pieces, "path string, offset long, data binary"), path).first()
    assert done.bytes == layout.facts["blocks"] * 65536
    return layout, lambda r: w.load(spark, r, path)


@pytest.mark.parametrize("case", ["plain", "collision", "many"])
def test_written_images_read_back(spark, tmp_path, case):
    rng = random.Random(3)
    files = {"eboot.bin": b"main", "sce_sys/param.sfo": rng.randbytes(70_000), "data/a/x.bin": rng.randbytes(200_001), "data/a/empty": b"", "data/b.txt": b"b"}
    empty = ["data/none/", "top"]
    if case == "collision":
        files |= {"Data/b.txt": b"other case, same hash", "data/a/X.BIN": b"and again"}
    if case == "many":
        files |= {f"many/{'n' * 30}{k:05d}": str(k).encode() for k in range(2300)}  # records over one block, inodes over several
    layout, load = written(spark, tmp_path, files, empty)
    root = layout.facts["root"]
    assert root == (3 if case == "collision" else 2)
    head = load("image_header").first()
    assert (head.dinode_count, head.ndblock, head.dinode_block_count, head.mode) == (layout.facts["inodes"], layout.facts["blocks"], layout.facts["inode_blocks"], 8)
    listing = w.image_listing(load("dirents"), load("inodes"), root)
    got = {r.path: (r.size, r.is_directory) for r in listing.collect()}
    folders = {"/".join(p.split("/")[:k]) for p in [*files, *(e.rstrip("/") + "/." for e in empty)] for k in range(1, p.count("/") + 1)}
    assert {p for p, (_, d) in got.items() if d} == {f"Image0/{p}" for p in folders}
    assert {p: s for p, (s, d) in got.items() if not d} == {f"Image0/{p}": len(d) for p, d in files.items()}
    content = {}
    for r in w.inner_content(load("image_content"), listing).orderBy("path", "ordinal").collect():
        content[r.path.removeprefix("Image0/")] = content.get(r.path.removeprefix("Image0/"), b"") + bytes(r.data)
    assert {p: d for p, d in files.items() if d} == {p: d for p, d in content.items() if d}
    # No block has two owners, and every inode but the super root and the table is reached.
    assert w.validate_images(load("inodes"), load("image_blocks"), F.lit(head.ndblock)).count() == 0
    assert {r.inode for r in joins.unreferenced_inodes(load("inodes"), load("dirents")).collect()} <= {0}
    assert rules.scan_counters(load("image_header"), load("inodes"), load("dirents")).first().bad_sizes == 0
    assert trees.resolve_path(trees.tree_walk(load("dirents"), root), "data/a/empty").count() == 1
    # The path table: sorted hashes, each leading to its inode or to the resolver.
    table = b"".join(bytes(r.data) for r in load("image_content").where("inode = 1").orderBy("ordinal").collect())
    slots = [(int.from_bytes(table[a : a + 4], "little"), int.from_bytes(table[a + 4 : a + 8], "little")) for a in range(0, len(table), 8)]
    assert slots == sorted(slots) and len(slots) == len(files) + len(folders)
    inode = {r.path: r.inode for r in layout.nodes.collect()}
    hashes = {}
    for p in inode:
        hashes.setdefault(_utf16_hash("/" + p), []).append(p)
    for h, slot in slots:
        own = hashes[h]
        assert slot >> 31 if len(own) > 1 else slot == inode[own[0]] | (0x20000000 if own[0] in folders else 0)
    if case == "collision":
        resolver = b"".join(bytes(r.data) for r in load("image_content").where("inode = 2").orderBy("ordinal").collect())
        for h, slot in slots:
            if slot >> 31:
                at = slot & 0x7FFFFFFF
                for p in sorted(hashes[h], key=inode.get):
                    number, kind, length, size = (int.from_bytes(resolver[at + k : at + k + 4], "little") for k in (0, 4, 8, 12))
                    assert (number, kind, resolver[at + 16 : at + 16 + length].decode()) == (inode[p], 3 if p in folders else 2, "/" + p)
                    at += size


def test_an_empty_image(spark, tmp_path):
    layout, load = written(spark, tmp_path, {"a": b""})
    assert load("image_header").first().dinode_count == 4 and w.image_listing(load("dirents"), load("inodes"), 2).count() == 1
