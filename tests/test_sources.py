"""Sources, sinks and rules on synthesized bytes."""

import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithospark.constants import BLOCK
from lithospark.functions import blocks, hashes
from lithospark.operators import aggregate, joins, rules, trees
from lithospark.plans import workflows as w
from lithospark.sources import containers, documents, layouts, sinks
from tests import fixtures as fx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    (root / "a.pkg").write_bytes(fx.minimal_package(image=b"x" * 70000))
    (root / "b.pkg").write_bytes(fx.minimal_package(content_id="IP9100-THEME", content_type=0x1B))
    (root / "bad.pkg").write_bytes(b"nonsense" * 1000)
    (root / "short.pkg").write_bytes(fx.minimal_package()[:0x800])
    return str(root)


def test_sweep_never_fails(spark, folder):
    report = w.sweep(spark, folder)
    rows = {r.file.rsplit("/", 1)[1]: r for r in report.collect()}
    assert rows["a.pkg"].status == "OK" and rows["a.pkg"].type == "Game" and rows["a.pkg"].title == "A game"
    assert rows["bad.pkg"].status == rows["short.pkg"].status == "FAIL" and rows["bad.pkg"].title is None and "magic" in rows["bad.pkg"].error
    parts = w.sweep_summary(report)
    assert parts["outcome"].first() == (2, 2) and parts["types"].first().n == 2 and parts["failures"].count() == 2
    lines = sinks.sweep_lines(report).collect()
    assert len(lines[0]) == 9


def test_entries_names_and_listing(spark, folder):
    load = lambda r: w.load(spark, r, folder + "/a.pkg")
    entries = load("entries")
    assert entries.count() == 10 and entries.where("is_encrypted").select("id", "key_index").first() == (0x402, 3)
    listing = w.listing(w.entry_listing(entries, load("names")))
    paths = [r.path for r in listing.collect()]
    assert paths == ["Sc0/entry_2345.bin", "Sc0/icon0.png", "Sc0/nptitle.dat", "Sc0/param.sfo"]
    assert load("payloads").where("is_encrypted and data is not null").count() == 0
    assert aggregate.listing_totals(listing).first().files == 4
    assert sinks.console_listing(listing).first().line.startswith("F 5 ")


def test_chosen_files_and_errors(spark, folder):
    containers.register(spark)
    df = spark.read.format("strata").options(relation="entries", path=folder, suffix=".pkg").load()
    chosen = spark.read.format("strata").options(relation="entries", path=folder, only=folder + "/a.pkg").load()
    assert chosen.count() == 10  # the damaged files are never opened
    with pytest.raises(Exception, match="magic|beyond"):
        df.count()
    lenient = spark.read.format("strata").options(relation="entries", path=folder, suffix=".pkg", onError="row").load()
    assert lenient.count() == 20


def test_package_info_and_digests(spark, folder, tmp_path):
    load = lambda r, p=folder + "/a.pkg": w.load(spark, r, p)
    sfo = load("payloads").where("id = 4096").select("file", "data").collect()[0]
    (tmp_path / "param.sfo").write_bytes(bytes(sfo.data))
    values = load("sfo", str(tmp_path / "param.sfo")).withColumn("file", F.lit(sfo.file))
    info = w.package_info(values, load("header")).first()
    assert (info.TITLE, info.TITLE_ID, info.type, info.app_version) == ("A game", "CUSA00001", "Game", "01.00")
    assert w.validate_packages(load("header"), load("entries"), load("payloads"), load("regions")).count() == 0
    for at, structure in ((0x2005, "entries_digest_1"), (0x80000 + 5, "signed_digest"), (0x150, "table_digest"), (0x1800, None)):
        damaged = bytearray(fx.minimal_package(image=b"x" * 70000))
        damaged[at] ^= 1
        path = tmp_path / f"{at}.pkg"
        path.write_bytes(damaged)
        found = w.validate_packages(*(load(r, str(path)) for r in ("header", "entries", "payloads", "regions")))
        got = {r.structure for r in found.collect()}
        assert structure is None or structure in got, (at, got)
    assert w.verdict(found.withColumn("severity", F.lit("failure"))).count() <= 1


def test_rules_on_headers_and_entries(spark):
    heads = spark.createDataFrame([("ok", 0x80000, 10, 0x90000), ("zero", 0, 10, 100), ("odd", 5, 10, 100), ("long", 0x80000, 99, 0x80010)], "file string, pfs_image_offset long, pfs_image_size long, file_size long")
    got = {(r.file, r.reason) for r in rules.header_violations(heads).collect()}
    assert got == {("zero", "image offset is zero"), ("odd", "image offset is not aligned"), ("long", "image ends beyond the file")}
    entries = spark.createDataFrame([("f", 0, 1, 0, 20, True, 100), ("f", 1, 1, 8, 20, True, 100), ("f", 2, 3, 90, 20, False, 100)], "file string, ordinal long, id long, data_offset long, data_size long, is_encrypted boolean, file_size long")
    assert [(r.ordinal, r.reason) for r in rules.entry_violations(entries).orderBy("ordinal").collect()] == [(1, "alignment"), (2, "range")]
    assert rules.duplicate_violations(entries).first().ordinal == 1
    digests = spark.createDataFrame([("f", 0, "a", bytes(32), b"x" * 32), ("f", 1, "b", b"y" * 32, b"x" * 32), ("f", 2, "c", b"x", b"x")], "file string, ordinal int, structure string, stored binary, computed binary")
    assert [r.severity for r in rules.digest_violations(digests, tolerant=True).orderBy("ordinal").collect()] == ["warning", "failure"]


def test_verify_entries(spark):
    entries = spark.createDataFrame([("f", k, 100 + k, at, n, 1000) for k, (at, n) in enumerate([(0, 4), (16, 4), (32, 4), (999, 9)])], "file string, ordinal long, id long, data_offset long, data_size long, file_size long")
    import hashlib

    payloads = spark.createDataFrame([("f", k, b"abcd") for k in range(4)], "file string, ordinal long, data binary")
    slots = spark.createDataFrame([("f", 0, b"z"), ("f", 1, hashlib.sha256(b"abcd").digest()), ("f", 2, bytes(32)), ("f", 3, bytes(32))], "file string, ordinal long, stored binary")
    assert [r.status for r in rules.verified_entries(entries, payloads, slots).orderBy("ordinal").collect()] == ["SKIPPED", "OK", "FAIL", "SKIPPED"]


def test_image_walks(spark, tmp_path):
    # 0 root; 1 uroot; 2 dir a; 3 file; 4 linked twice; 5 cycle back to 2; many inodes cross a block
    files = {3: b"hello", 4: b"z" * 150_000, 500: b"late"}
    dirs = {0: [(1, 3, "uroot"), (2, 4, ".")], 1: [(2, 3, "a"), (3, 2, "f.txt"), (5, 3, "b"), (9, 2, "flat_path_table")], 2: [(4, 2, "big"), (5, 3, "in")], 5: [(2, 3, "back"), (500, 2, "late")]}
    path = tmp_path / "inner.img"
    path.write_bytes(fx.image(files, dirs))
    load = lambda r: w.load(spark, r, str(path))
    assert load("inodes").count() == 501 and load("image_header").first().dinode_count == 501
    assert load("image_blocks").where("inode = 4").count() == 3
    listing = w.image_listing(load("dirents"), load("inodes"), 1)
    paths = {r.path: r.size for r in listing.collect()}
    assert paths["Image0/a/big"] == 150_000 and paths["Image0/b/back/big"] == 150_000 and paths["Image0/b/late"] == 4
    assert "Image0/a/in/back" not in paths and "Image0/flat_path_table" not in paths
    once = trees.tree_walk_global(load("dirents").where("name <> 'flat_path_table'"), 1)
    assert sorted(r.path for r in once.where("type = 3").collect()) == ["a", "a/in"]  # the first in depth-first order
    assert {r.inode for r in joins.unreferenced_inodes(load("inodes"), load("dirents")).where("inode < 10").collect()} == {0, 6, 7, 8}
    counters = rules.scan_counters(load("image_header"), load("inodes"), load("dirents")).first()
    assert counters.declared == 501 and counters.bad_sizes == 0
    assert trees.resolve_path(trees.tree_walk(load("dirents"), 1), "A/BIG").count() == 1
    found = w.validate_images(load("inodes").where("inode in (1, 2, 3, 4, 5, 500)"), load("image_blocks").where("inode in (1, 2, 3, 4, 5, 500)"), F.lit(10_000))
    assert found.count() == 0


def test_container_blocks(spark, tmp_path):
    content = b"".join(bytes([k % 251]) * BLOCK for k in range(600)) + b"tail"
    path = tmp_path / "c.pfsc"
    path.write_bytes(fx.container(content, raw={0, 599}))
    load = lambda r: w.load(spark, r, str(path))
    got = load("container_blocks").orderBy("block_no").collect()
    assert b"".join(bytes(r.content) for r in got) == content.ljust(601 * BLOCK, b"\0")
    assert load("container_blocks").rdd.getNumPartitions() == 3
    table = load("container_table")
    assert table.count() == 602
    assert w.validate_containers(load("container_header"), table, load("container_blocks")).count() == 0
    files = spark.createDataFrame([(str(path), "first", 0, 2), (str(path), "raw", 599, 1), (str(path), "packed", 1, 2), (str(path), "beyond", 600, 5), (str(path), "empty", 3, 0)], "file string, path string, start_block long, block_count long")
    policies, stats = w.container_profile(load("container_blocks"), files)
    assert {r.path: r.policy for r in policies.collect()} == {"first": "none", "raw": "disable", "packed": "enable", "beyond": "none", "empty": "none"}
    assert stats.first().raw_blocks == 2
    data = bytearray(path.read_bytes())
    data[BLOCK + BLOCK + 20] ^= 255
    struct.pack_into("<Q", data, 0x400 + 8 * 300, 1)
    (tmp_path / "d.pfsc").write_bytes(data)
    bad = lambda r: w.load(spark, r, str(tmp_path / "d.pfsc"))
    reasons = {r.reason for r in w.validate_containers(bad("container_header"), bad("container_table"), bad("container_blocks")).collect()}
    assert {"offset falls", "block does not inflate"} <= reasons


def test_container_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([("x.pfsc", b"q" * (3 * BLOCK)), ("y.pfsc", bytes(range(256)) * 512)], "file string, content binary")
    stored = blocks.store_blocks(blocks.split_blocks(rows, "content"))
    done = sinks.write_containers(sinks.container_layout(stored), str(tmp_path)).collect()
    assert sorted(r.file for r in done) == ["x.pfsc", "y.pfsc"]
    back = w.load(spark, "container_blocks", str(tmp_path), suffix=".pfsc").orderBy("file", "block_no").collect()
    assert b"".join(bytes(r.content) for r in back) == b"q" * (3 * BLOCK) + bytes(range(256)) * 512


def test_sfo_trophies_audio(spark, tmp_path):
    (tmp_path / "p.sfo").write_bytes(fx.sfo({"TITLE": "x", "N": 5, "title": "y"}))
    (tmp_path / "q.sfo").write_bytes(b"no such thing")
    values = w.load(spark, "sfo", str(tmp_path), suffix=".sfo")
    assert [(r.key, r.value) for r in values.orderBy("ordinal").collect()] == [("TITLE", "x"), ("N", "5"), ("title", "y")]
    whole = sinks.sfo_files(values.select("file", "key", "format", "max_length", "number", "text")).first()
    assert [(r["key"], r["value"]) for r in layouts.sfo_values(lambda a, n: whole.content[a : a + n], len(whole.content))] == [("N", "5"), ("TITLE", "x"), ("title", "y")]
    files = spark.createDataFrame([("p", True), ("q", False), ("r", True)], "file string, magic_ok boolean")
    assert {(r.file, r.reason) for r in rules.sfo_violations(files, files.where("file = 'p'")).collect()} == {("q", "bad magic"), ("r", "no values")}
    entries = pd.DataFrame({"name": ["zzz", "TROP001.PNG", "TROPCONF.SFM", "TROP.ESFM"], "data": [b"1", b"22", b"333", b""]})
    archive = sinks.trophy_files(spark.createDataFrame([("t.trp", r.name_, r.data) for r in entries.rename(columns={"name": "name_"}).itertuples()], "file string, name string, data binary")).first()
    (tmp_path / "t.trp").write_bytes(archive.content)
    got = w.load(spark, "trophies", str(tmp_path / "t.trp")).orderBy("ordinal").collect()
    assert [(r.name, bytes(r.data)) for r in got] == [("TROPCONF.SFM", b"333"), ("TROP.ESFM", b""), ("TROP001.PNG", b"22"), ("zzz", b"1")]
    (tmp_path / "s.at9").write_bytes(fx.audio((10, 6000)))
    audio = w.load(spark, "audio", str(tmp_path / "s.at9"))
    assert audio.select("channels", "frames", "sample_count", "delay").first() == (2, 5, 5000, 256)
    assert [r.reason for r in rules.audio_violations(audio).collect()] == ["loop lies beyond the samples"]
    wav = sinks.wav_bytes([0, 1, -1, 2], 2, 48000, (0, 1))
    assert layouts.audio_metadata(lambda a, n: wav[a : a + n], len(wav))["frames"] == 2


def test_documents(spark, tmp_path):
    xml = sinks.project_xml({"volume_type": "pkg_ps4_app", "content_id": "X", "title": 'a "b"'}, [("sce_sys/param.sfo", "o/param.sfo", "disable"), ("data/x", "", "")], ["empty/in"])
    other = "<psproject><volume><volume_type> pkg_ps4_patch </volume_type><package><content_id>Y</content_id></package></volume><files><file><entry path='e'/><orig_path>oo</orig_path></file></files></psproject>"
    rows = spark.createDataFrame([("a", xml), ("b", other), ("c", None)], "file string, xml string")
    parsed = documents.projects(rows)
    got = {r.file: r.project for r in parsed.collect()}
    assert got["a"].content_id == "X" and got["a"].title == 'a "b"' and got["b"].content_id == "Y" and got["b"].volume_type == "pkg_ps4_patch" and got["c"] is None
    assert [(r.path, r.origin, r.compression) for r in documents.project_files(parsed).orderBy("file", "ordinal").collect()] == [("sce_sys/param.sfo", "o/param.sfo", "disable"), ("data/x", "data/x", ""), ("e", "oo", "")]
    profile = sinks.profile_json(spark.createDataFrame([("p", "Image0/A", "enable"), ("p", "b\\c/", "disable"), ("p", "n", "none")], "file string, path string, policy string"))
    assert json.loads(profile.first().json) == {"Version": 1, "Files": {"a": "enable", "b/c": "disable"}}
    lower = spark.createDataFrame([("q", '{"version":1,"files":{"z":"Enable"}}'), ("r", '{"Version":2,"Files":{"z":"enable"}}'), ("s", "not json")], "file string, json string")
    assert [tuple(r) for r in documents.profile_policies(lower.unionByName(profile)).orderBy("file", "path").collect()] == [("p", "a", "enable"), ("p", "b/c", "disable"), ("q", "z", "enable")]
    patch = "<titlepatch titleid='T'><tag name='n' mandatory='true'><package version='01.01' size='5' manifest_url='u' content_id='C'/><package version='01.02' size='6'/></tag></titlepatch>"
    patches = documents.title_patches(spark.createDataFrame([("a", patch), ("b", "<other/>"), ("c", "junk")], "file string, xml string"))
    assert {r.file: r.patch and (r.patch.title_id, r.patch.version, r.patch.size) for r in patches.collect()} == {"a": ("T", "01.01", 5), "b": None, "c": None}
    text = '{"originalFileSize":10,"pieces":[{"url":"u","fileOffset":0,"fileSize":6,"hashValue":"h"},{"url":"v","fileOffset":6,"fileSize":4,"hashValue":"i"}]}'
    found = documents.manifests(spark.createDataFrame([("a", text), ("b", "x")], "file string, json string"))
    assert documents.manifest_pieces(found).count() == 2 and found.where("manifest is null").count() == 1
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f.bin").write_bytes(b"123")
    assert [(r.path, r["size"]) for r in documents.folder(spark, str(tmp_path)).collect()] == [("d/f.bin", 3)]
    assert [r.path for r in documents.folder_directories(spark, str(tmp_path)).collect()] == ["d", "d/e"]


def test_extract(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"1"), ("../out", b"2"), ("c", None), ("d", b"")], "path string, data binary")
    failed = {r.path: r.error for r in sinks.extract(rows, str(tmp_path / "out")).collect()}
    assert failed == {"../out": "path leaves the folder", "c": "no data"}
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"1" and (tmp_path / "out/d").read_bytes() == b"" and not (tmp_path / "out/a/b.txt.tmp").exists()
    with pytest.raises(Exception, match="leaves|no data"):
        sinks.extract(rows, str(tmp_path / "out"), continue_on_error=False).collect()


def test_hash_golden(spark):
    df = spark.createDataFrame([("/eboot.bin", b"PFSC1"), ("ß", bytes(4)), ("", b"")], "p string, b binary")
    got = df.select(hashes.hash31(F.col("p")), hashes.hash31_any()("p"), hashes.is_pfsc(F.col("b")), hashes.is_all_zero(F.col("b")), hashes.adler32()("b")).collect()
    assert got[0][:4] == (0x768C03E1, 0x768C03E1, True, False) and got[1][1:4] == (0xDF, False, True) and got[2] == (0, 0, False, False, 1)


def test_inner_image_in_a_container(spark, tmp_path):
    inner = fx.image({3: b"hello", 4: b"z" * 150_000}, {0: [(3, 2, "f.txt"), (4, 2, "big")]})
    (tmp_path / "image.pfsc").write_bytes(fx.container(inner, raw={0}))
    load = lambda r: w.load(spark, r, str(tmp_path / "image.pfsc"))
    listing = w.image_listing(load("dirents"), load("inodes"), 0)
    content = w.inner_content(load("image_content"), listing).orderBy("path", "ordinal").collect()
    assert b"".join(bytes(r.data) for r in content if r.path.endswith("f.txt")) == b"hello"
    assert b"".join(bytes(r.data) for r in content if r.path.endswith("big")) == b"z" * 150_000


def test_commands(spark, folder, tmp_path, capsys):
    from lithospark import cli
    from lithospark.plans.options import entry_argument

    assert entry_argument("C:\\x.pkg") == ("C:\\x.pkg", None) and entry_argument("a.pkg:Sc0/x") == ("a.pkg", "Sc0/x")
    one = folder + "/a.pkg"
    for command in ("list", "info", "entries", "fields", "verify", "validate"):
        cli.main([command, one], spark)
    assert cli.main(["validate", one], spark).count() == 0
    assert {r.status for r in cli.main(["verify", one], spark).collect()} <= {"SKIPPED", "FAIL"}
    assert cli.main(["extract", one + ":sc0/icon0.png", "--output", str(tmp_path / "x")], spark).count() == 0
    assert (tmp_path / "x/Sc0/icon0.png").read_bytes() == b"png"
    cli.main(["sweep", folder, "--output", str(tmp_path / "report")], spark)
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "report")).count() == 4
    assert cli.main(["relation", one, "--relation", "payload_pieces"], spark).count() == 9
