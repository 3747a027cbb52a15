"""Commands that plan and write, over synthesized folders and files."""

import json
import random

import pytest

from lithospark import cli
from lithospark.plans.options import assignments
from lithospark.sources.layouts import sfo_values
from tests import fixtures as fx


def put(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def meta(category, **more):
    return fx.sfo({"TITLE": "A game", "TITLE_ID": "CUSA00001", "CATEGORY": category, "APP_VER": "01.00", "ATTRIBUTE": 7} | more)


def run(spark, *arguments):
    return cli.main([str(a) for a in arguments], spark)


def test_merge_repack_restructure(spark, tmp_path, capsys):
    base = put(tmp_path / "base", {"Image0/eboot.bin": b"old", "Image0/data/a": b"1", "Image0/data/b": b"22", "Sc0/param.sfo": meta("gd"), "Sc0/icon0.png": b"png"})
    update = put(tmp_path / "update", {"Image0/EBOOT.BIN": b"newer", "Image0/data/c": b"333", "Sc0/param.sfo": meta("gp")})
    moved = {r.path: (r.target, r.action) for r in run(spark, "restructure", base).where("area = 'Sc0'").collect()}
    assert moved == {"param.sfo": ("sce_sys/param.sfo", "move"), "icon0.png": ("sce_sys/icon0.png", "move")}
    assert {r.path for r in run(spark, "repack", base).collect()} >= {"eboot.bin", "data/a", "data/b", "sce_sys/icon0.png"}
    plan = {r.path.lower(): r.size for r in run(spark, "merge", base, "--update", update).where("not is_directory").collect()}
    assert plan["eboot.bin"] == 5 and plan["data/c"] == 3 and plan["data/b"] == 2
    assert [r.problem for r in run(spark, "merge", update, "--update", base).collect()] == ["base is not a game"]
    assert [r.problem for r in run(spark, "merge", base, "--update", update, "--target", base, "--workers", "-1").collect()] == ["workers must not be negative", "output must differ from the inputs"]
    assert "eboot.bin" in capsys.readouterr().out.lower()


def test_project_and_build(spark, tmp_path, capsys):
    rng = random.Random(1)
    files = {"eboot.bin": rng.randbytes(90_000), "data/zeros": bytes(300_000), "data/x.txt": b"text", "sce_sys/param.sfo": meta("gd")}
    root = put(tmp_path / "game", files)
    (tmp_path / "game/hollow/inner").mkdir(parents=True)
    rows = {r.path: r.compression for r in run(spark, "gp4gen", root, "--output", tmp_path / "p.gp4", "--values", "volume_type=pkg_ps4_app", "content_id=EP0001").collect()}
    assert rows["eboot.bin"] == "disable" and rows["data/x.txt"] == "enable" and "hollow/inner/" in rows
    text = (tmp_path / "p.gp4").read_text()
    assert '<file targ_path="data/x.txt"' in text and "<volume_type>pkg_ps4_app</volume_type>" in text and 'content_id="EP0001"' in text
    told = json.loads(run(spark, "build", root, "--output", tmp_path / "inner.img", "--container", tmp_path / "inner.pfsc", "--values", "title_id=CUSA1").first().json)
    assert told["fileCount"] == 4 and told["titleId"] == "CUSA1" and told["pkgSize"] is None and len(told) == 18
    assert told["innerPfsSize"] == (tmp_path / "inner.img").stat().st_size and told["pfscSize"] == (tmp_path / "inner.pfsc").stat().st_size < told["innerPfsSize"]
    image, packed = (run(spark, "list-image", tmp_path / name, "--root", 2).collect() for name in ("inner.img", "inner.pfsc"))
    assert image == packed and any("hollow/inner" in r.line for r in image)
    content = run(spark, "relation", tmp_path / "inner.pfsc", "--relation", "container_blocks").orderBy("block_no").collect()
    assert b"".join(bytes(r.content) for r in content) == (tmp_path / "inner.img").read_bytes()
    # The policies that the container shows, against a profile.
    shown = {r.path: r.policy for r in run(spark, "profile", tmp_path / "inner.pfsc", "--output", tmp_path / "own.json").collect()}
    assert shown["Image0/data/zeros"] == "enable"
    assert json.loads((tmp_path / "own.json").read_text())["Files"]["data/zeros"] == "enable"
    counts = run(spark, "profile", tmp_path / "inner.pfsc", "--ref", tmp_path / "own.json").first()
    assert (counts.identical, counts.mismatched, counts.only_here, counts.only_reference) == (4, 0, 0, 0)
    assert run(spark, "profile", tmp_path / "inner.pfsc", "--stats").first().blocks * 65536 == told["innerPfsSize"]
    # Two images of which one has another file.
    assert run(spark, "compare", tmp_path / "inner.img", "--other", tmp_path / "inner.pfsc", "--show", "words").count() == 0
    put(tmp_path / "game", {"data/x.txt": b"longer text"})
    run(spark, "build", root, "--output", tmp_path / "b.img")
    changed = run(spark, "compare", tmp_path / "inner.img", "--other", tmp_path / "b.img", "--show", "words").collect()
    assert len({r.ordinal for r in changed}) == 1 and {r.offset for r in changed} == {8, 16}
    assert run(spark, "compare", tmp_path / "inner.img", "--other", tmp_path / "b.img", "--show", "blocks").count() == 0
    assert run(spark, "compare", tmp_path / "inner.img", "--other", tmp_path / "b.img").where("status = 'DIFF'").count() == 0
    assert run(spark, "path-table", tmp_path / "b.img").count() == 4 + 4  # eboot.bin, zeros, x.txt, param.sfo; data, hollow, inner, sce_sys


def test_metadata_and_trophies(spark, tmp_path, capsys):
    path = tmp_path / "param.sfo"
    path.write_bytes(meta("gd"))
    run(spark, "sfo-set", path, "--values", "title=Other = name", "ATTRIBUTE=0x1F", "NEW=n", "--output", tmp_path / "out.sfo")
    got = {r.key: (r.format, r.value) for r in run(spark, "sfo", tmp_path / "out.sfo").collect()}
    assert got["title"] == ("utf8", "Other = name") and got["ATTRIBUTE"][0] == "int32" and got["NEW"] == ("utf8", "n") and "TITLE" not in got and got["CATEGORY"] == ("utf8", "gd")
    data = (tmp_path / "out.sfo").read_bytes()
    assert {v["key"]: v["number"] for v in sfo_values(lambda a, n: data[a : a + n], len(data))}["ATTRIBUTE"] == 31
    run(spark, "sfo-set", path, "--new", "--values", "TITLE=A title of some length", "--output", tmp_path / "fresh.sfo")
    assert [(r.key, r.value) for r in run(spark, "sfo", tmp_path / "fresh.sfo").collect()] == [("TITLE", "A title of some length")]
    with pytest.raises(ValueError, match="not KEY=VALUE"):
        assignments(["nothing"])
    root = put(tmp_path / "trophies", {"TROP001.PNG": b"one", "TROPCONF.SFM": b"conf", "ICON0.PNG": b"icon"})
    run(spark, "trophies-create", root, "--output", tmp_path / "t.trp")
    assert [r.name for r in run(spark, "trophies", tmp_path / "t.trp").collect()] == ["TROPCONF.SFM", "ICON0.PNG", "TROP001.PNG"]


def test_output_is_whole(spark, tmp_path, capsys):
    put(tmp_path / "many", {f"{k}.pkg": b"not a package" for k in range(30)})
    run(spark, "sweep", tmp_path / "many", "--output", tmp_path / "report.tsv")
    lines = (tmp_path / "report.tsv").read_bytes()
    assert lines.startswith(b"\xef\xbb\xbfFile\tResult") and lines.count(b"\r\n") == 31
    names = [x.split(b"\t")[0] for x in lines.split(b"\r\n")[1:-1]]
    assert names == sorted(names)
    capsys.readouterr()
    image = tmp_path / "many.img"
    image.write_bytes(fx.image({k: b"x" for k in range(1, 1300)}, {0: [(k, 2, f"f{k}") for k in range(1, 1300)]}))
    run(spark, "list-image", image)
    assert capsys.readouterr().out.count("\n") == 1300
    run(spark, "list-image", image, "--limit", 5)
    assert capsys.readouterr().out.count("\n") == 6
