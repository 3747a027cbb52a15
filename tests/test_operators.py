"""Operators over relations: edge cases, invariants and independence of partitioning."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithospark.functions import blocks, paths, scalars
from lithospark.operators import aggregate, classify, joins, ordering, overlay, trees, windows
from lithospark.plans import workflows as w


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_paths(spark):
    df = spark.createDataFrame([(" Image0/A\\B// ",), ("x\\",), ("/",), ("",), (None,), ("a//b",)], "p string")
    got = df.select(paths.normalize_key(F.col("p")), paths.normalize_entry_path(F.col("p")), paths.basename(F.col("p")), F.size(paths.ancestors(F.col("p")))).collect()
    assert got[0][0] == "a/b" and got[1][0] == "x" and got[1][1] == "x/" and got[2][0] == "" and got[4][0] is None and got[5][3] == 1 and got[3][3] == 0
    bad = spark.createDataFrame([("../x", True), ("a/../b", False), ("a/../../b", True), ("/x", True), ("c:\\x", True), ("ok/x", False), ("..\\x", True), ("", False)], "p string, e boolean")
    assert bad.where(paths.is_traversal(F.col("p")) != F.col("e")).count() == 0
    assert [r.path for r in overlay.parent_closure(spark.createDataFrame([("a/b/c",), ("A/x",), ("top",)], "path string")).orderBy("path").collect()] == ["A", "a/b"]


def test_scalars(spark):
    df = spark.createDataFrame([("0x1A",), ("26",), ("zz",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.parse_number(F.col("t"))).collect()] == [26, 26, None, None]
    df = spark.createDataFrame([(0,), (1,), (65536,), (65537,)], "n long")
    assert [r[0] for r in df.select(scalars.blocks_of(F.col("n"))).collect()] == [1, 1, 1, 2]
    assert [r[0] for r in df.select(scalars.align(F.col("n"), 16)).collect()] == [0, 16, 65536, 65552]
    kinds = spark.createDataFrame([(" pkg_ps4_app ",), ("other",)], "t string").select(scalars.volume_type(F.col("t")).alias("k"))
    assert [r[0] for r in kinds.select(scalars.volume_text(F.col("k"))).collect()] == ["pkg_ps4_app", "pkg_ps4_theme"]
    one = spark.createDataFrame([("a\tb\nc", 'n<a>:"m"|?*', "2024-01-02 03:04:05")], "s string, f string, t string").select(
        scalars.scrub(F.col("s")), scalars.safe_filename(F.col("f"), 6), scalars.compact_date(F.to_timestamp("t")), scalars.iso_date(F.to_timestamp("t")), scalars.percent(F.lit(1), F.lit(0))
    )
    assert one.first() == ("a b c", "n_a___", "20240102", "2024-01-02T03:04:05Z", 100.0)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_block_roundtrip(data):
    packed = blocks.deflate_block(data)
    if packed is None:
        assert blocks.inflate_block(data, len(data)) == data
    else:
        assert len(packed) < len(data) and blocks.inflate_block(packed, len(data)) == data
        damaged = bytes([*packed[:-1], packed[-1] ^ 1])
        assert blocks.inflate_block(damaged, len(data)) is None and blocks.inflate_block(damaged, len(data), check=False) == data


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_running_sums_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") * 3).alias("v")).repartition(parts)
    before, want, by = 0, [], {0: 0, 1: 0, 2: 0}
    for i in range(500):
        want.append((i, before, by[i % 3]))
        v = 3 * i if i % 7 else 0
        before += v
        by[i % 3] += v
    got = windows.running_before(df, "v", ["id"], "a").join(windows.running_before(df, "v", ["id"], "b", ["g"]).select("id", "b"), "id").orderBy("id").select("id", "a", "b")
    assert [tuple(r) for r in got.collect()] == want
    assert windows.running_before(df.limit(0), "v", ["id"], "a").count() == 0


def test_layout_is_disjoint(spark):
    files = spark.createDataFrame([(f"f{k}", k * 40_000) for k in range(20)] + [("none", None)], "path string, size long")
    layout = windows.block_layout(files, "size", ["path"], base=5).orderBy("start_block").collect()
    at = 5
    for r in layout:
        assert r.start_block == at and r.block_count >= 1
        at += r.block_count
    pinned = spark.createDataFrame([("p", 1, 10, None), ("p", 2, 10, 64), ("p", 3, 1, None)], "file string, id long, size long, pin long")
    assert [r.offset for r in windows.aligned_offsets(pinned, "size", ["id"], ["file"], pinned="pin").orderBy("id").collect()] == [0, 64, 16]


def test_dirents_do_not_cross_blocks(spark):
    names = [f"{'n' * 40}{k}" for k in range(40)]
    at = spark.createDataFrame([(names,)], "n array<string>").select(windows.packed_dirents(F.col("n"), 512)).first()[0]
    size = [-(-(len(n) + 17) // 8) * 8 for n in names]
    assert all(a // 512 == (a + s - 1) // 512 for a, s in zip(at, size, strict=True)) and all(y >= x + s for x, y, s in zip(at, at[1:], size, strict=False))
    spots = spark.range(0, 800).select(windows.inode_position(F.col("id"), 0xA8)).collect()
    assert spots[389][0] == 65536 + 389 * 0xA8 and spots[390][0] == 131072


def test_overlay_properties(spark):
    base = spark.createDataFrame([("A/x", 1), ("b", 2), ("c", 3)], "path string, size long")
    update = spark.createDataFrame([("a/X", 9), ("d", 4)], "path string, size long")
    out = overlay.overlay_files(base, update)
    assert rows(out.select("path", "size", "layer")) == [("a/X", 9, 1), ("b", 2, 0), ("c", 3, 0), ("d", 4, 1)]
    assert rows(overlay.overlay_files(base, base).select("path", "size")) == rows(base)
    assert overlay.overlay_profiles(None, base.select("path", F.lit("enable").alias("policy"))) is None
    assert joins.policy_diff(base.withColumn("policy", F.lit("enable")), base.withColumn("policy", F.lit("enable"))).where("status <> 'identical'").count() == 0
    dirs = spark.createDataFrame([("A",), ("empty",)], "path string")
    assert rows(overlay.empty_directories(dirs, base)) == [("empty",)]
    values = spark.createDataFrame([("f", "TITLE", "a"), ("f", "title", "b"), ("f", "X", "c")], "file string, key string, value string")
    assert rows(overlay.sfo_upsert(values, spark.createDataFrame([("f", "Title", "n")], "file string, key string, value string"))) == [("f", "Title", "n"), ("f", "X", "c")]
    entries = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, data string")
    assert rows(overlay.replace_placeholders(entries, spark.createDataFrame([(2, "B", "z"), (3, "c", "w")], "id long, name string, data string"))) == [(1, "a", "x"), (2, "B", "z"), (3, "c", "w")]
    moved = overlay.moved_tree(spark.createDataFrame([("s/a", 1)], "path string, size long"), spark.createDataFrame([("A", 2), ("b", 3)], "path string, size long"), "s/")
    assert rows(moved.select("path", "size")) == [("s/A", 2), ("s/b", 3)]


def test_walks_differ_on_hard_links(spark):
    edges = spark.createDataFrame([("f", 0, 0, 1, 3, "a"), ("f", 0, 1, 2, 3, "b"), ("f", 1, 0, 3, 3, "sub"), ("f", 2, 0, 3, 3, "again"), ("f", 3, 0, 1, 3, "up"), ("f", 3, 1, 9, 2, "file")], "file string, parent long, ordinal long, inode long, type int, name string")
    every = {r.path for r in trees.tree_walk(edges).collect()}
    assert every == {"a", "b", "a/sub", "b/again", "a/sub/file", "b/again/file", "b/again/up", }
    once = {r.path for r in trees.tree_walk_global(edges).collect()}
    assert once == {"a", "b", "a/sub", "a/sub/file"}
    assert [r.path for r in trees.preorder(trees.tree_walk(edges)).collect()][:3] == ["a", "a/sub", "a/sub/file"]
    assert trees.tree_walk(edges.limit(0)).count() == 0
    assert trees.tree_walk(edges, max_depth=3).count() == len(every)
    with pytest.raises(ValueError, match="deeper than 2"):
        trees.tree_walk(edges, max_depth=2)


def test_global_walk_is_the_depth_first_one(spark):
    import random

    for seed in range(4):
        draw = random.Random(seed)
        edges = [("f", draw.randrange(9), k, draw.randrange(9), 3, f"n{k}") for k in range(26)]
        below: dict = {}
        for e in edges:
            below.setdefault(e[1], []).append(e)
        met: dict = {}

        def visit(node, path):
            for _, _, _, inode, _, name in sorted(below.get(node, []), key=lambda e: e[2]):
                if inode not in met:
                    met[inode] = path + name
                    visit(inode, met[inode] + "/")

        visit(0, "")
        got = trees.tree_walk_global(spark.createDataFrame(edges, "file string, parent long, ordinal long, inode long, type int, name string"))
        assert {r.inode: r.path for r in got.collect()} == met


def test_neighbours_and_ranks(spark):
    data = [(g, k, (k * 37) % 11) for g in "ab" for k in range(40)]
    df = spark.createDataFrame(data, "g string, k long, v long").repartition(5)
    after = {(r.g, r.k): r.n for r in windows.neighbour(df, "v", ["k"], "n", ["g"]).collect()}
    before = {(r.g, r.k): r.n for r in windows.neighbour(df, "v", ["k"], "n", ["g"], forward=False).collect()}
    value = {(g, k): v for g, k, v in data}
    assert after == {(g, k): value.get((g, k + 1)) for g, k in value}
    assert before == {(g, k): value.get((g, k - 1)) for g, k in value}
    got = {(r.g, r.k): r.rn for r in ordering.ranked(df, ["g"], -F.col("k")).collect()}
    assert got == {(g, k): 40 - k for g, k in value}


def test_directories_and_case(spark):
    files = spark.createDataFrame([("x/y/z/f",), ("https://h/a/b",), ("https://h/a/c",), ("top",), ("X/y/z/g",)], "path string")
    assert tuple(aggregate.directory_totals(files).first()) == (5, 3)
    assert sorted(r.path for r in overlay.parent_closure(files.where("path like '%/z/%'"), fold=False).collect()) == ["X", "X/y", "X/y/z", "x", "x/y", "x/y/z"]


def test_orders_and_digests(spark):
    bad = spark.createDataFrame([("f", 2, 0, "late"), ("f", 1, 5, "first"), ("f", 1, 7, "x"), ("g", 3, 1, "only")], "file string, stage int, ordinal long, reason string")
    assert rows(ordering.fail_fast(bad)) == [("f", 1, 5, "first"), ("g", 3, 1, "only")]
    import hashlib

    pieces = spark.createDataFrame([("k", 4, b"efgh"), ("k", 0, b"abcd"), ("j", 0, b"z")], "key string, offset long, data binary")
    assert rows(aggregate.region_digest(pieces)) == sorted([("j", hashlib.sha256(b"z").hexdigest()), ("k", hashlib.sha256(b"abcdefgh").hexdigest())])
    chain = aggregate.chained_digest(spark.createDataFrame([("f", 1, b"one"), ("f", 16, b"sixteen"), ("f", 5, b"no")], "file string, id long, data binary"), ["file"], "id", "data", [16, 1])
    assert chain.first().digest == hashlib.sha256(b"sixteenone").hexdigest()
    a = spark.createDataFrame([("f", 0, b"12345678abcdefgh"), ("f", 1, b"same")], "file string, ordinal long, raw binary")
    b = spark.createDataFrame([("f", 0, b"12345678abcdefgX"), ("f", 1, b"same")], "file string, ordinal long, raw binary")
    diff = joins.differing_words(a, b)
    assert rows(diff) == [("f", 0, 8)] and aggregate.first_divergence(diff).first().first_offset == 8
    use = joins.block_use(spark.createDataFrame([(1, "a")], "block_no long, owner string"), spark.createDataFrame([(2, "b")], "block_no long, owner string"))
    assert rows(use) == [(1, "a", None), (2, None, "b")]
    table = spark.createDataFrame([(0x768C03E1, 0x20000007, 0), (0x768C03E1, 9, 1)], "hash long, slot long, ordinal long")
    probe = joins.hash_probe(spark.createDataFrame([("eboot.bin",), ("none",)], "path string"), table)
    assert rows(probe.select("path", "inode")) == [("eboot.bin", 7), ("none", None)]


def test_requests_and_pairs(spark):
    assert classify.request_problems({"base": "a", "update": " ", "output": "a", "workers": -1}) == ["update is required", "workers must not be negative", "output must differ from the inputs"]
    assert classify.request_problems({"base": "a", "update": "b", "output": "c"}) == []
    pairs = spark.createDataFrame([("Game", "Patch", "T1", "t1"), ("Patch", "Patch", "T", "T"), ("Game", "Game", "T", "T"), ("Game", "Patch", "A", "B"), (None, "Patch", "A", "A")], "base_type string, update_type string, base_title_id string, update_title_id string")
    assert sorted(r.problem for r in classify.pair_problems(pairs).collect()) == ["base is not a game", "base is not a game", "title ids differ", "update is not a patch"]


def test_merge_end_to_end(spark):
    tree = lambda rows_: spark.createDataFrame(rows_, "area string, path string, size long")
    base = tree([("Image0", "eboot.bin", 100), ("Image0", "data/a", 70_000), ("Image0", "sce_sys/keystone", 9), ("Sc0", "param.sfo", 5), ("Sc0", "icon0.png", 6), ("Sc0", "license.dat", 4)])
    update = tree([("Image0", "EBOOT.BIN", 200), ("Image0", "data/new/b", 10), ("Sc0", "param.sfo", 50), ("Sc0", "changeinfo/changeinfo_02.xml", 3), ("Sc0", "param.sfo.original", 1)])
    pair = spark.createDataFrame([("Game", "Patch", "T", "t")], "base_type string, update_type string, base_title_id string, update_title_id string")
    profile = spark.createDataFrame([("Image0/data/a", "disable")], "path string, policy string")
    plan = w.merge_plan(pair, base, update, profile, spark.createDataFrame([("data/new/b", "enable")], "path string, policy string"))
    assert plan["problems"].count() == 0
    tree_rows = {r.path: (r["size"], r.source) for r in plan["tree"].collect()}
    assert tree_rows["EBOOT.BIN"] == (200, "update") and tree_rows["param.sfo"] == (5, "base") and tree_rows["data/a"] == (70_000, "base")
    assert rows(plan["restructured"].where("action = 'delete'").select("path")) == [("param.sfo.original",)]
    compression = {r.path: r.compression for r in plan["project"].collect()}
    assert compression["data/a"] == "disable" and compression["data/new/b"] == "enable" and "sce_sys/license.dat" not in compression
    entries = {r.target: r.entry_id for r in plan["build_entries"].collect()}
    assert entries == {"param.sfo": 0x1000, "icon0.png": 0x1200, "changeinfo/changeinfo_02.xml": 0x1263}
    layout = plan["build_layout"].orderBy("start_block").collect()
    assert sum(r.block_count for r in layout) == 5 and plan["build_raw_blocks"].count() == 3
    assert w.restructure_plan(base.select("area", "path"), for_packager=True).where("action = 'delete'").first().path == "license.dat"
    repack = w.repack_plan(base, profile)
    assert repack["build_nodes"].where("is_directory").count() == 2 and repack["build_path_table"].count() == 5
    dumps = spark.createDataFrame([("d",)], "file string")
    from lithospark.operators import rules

    found = rules.dump_violations(dumps, base.withColumn("file", F.lit("d")))
    assert rows(found.select("reason", "severity")) == [("sce_sys/param.sfo is missing", "warning")]


def test_streams(spark, tmp_path):
    from lithospark.streaming import sweep
    from tests import fixtures as fx

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pkg").write_bytes(fx.minimal_package())
    (tmp_path / "in" / "b.pkg").write_bytes(b"junk")
    stream = sweep.stream_sweep(spark, str(tmp_path / "in"))
    run = stream.writeStream.format("memory").queryName("swept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("swept").select("status", "title")) == [("FAIL", None), ("OK", "A game")]
    spark.range(5).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "s"))
    source = spark.readStream.schema("k string, v long").parquet(str(tmp_path / "s"))
    sweep.overlay_batches(source, str(tmp_path / "out"), "k", str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "0")).count() == 5
