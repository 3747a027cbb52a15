"""Commands over packages: python -m lithospark.cli COMMAND PATH ...

Each prints a relation or a report, whole unless --limit is given. Only what is
named by --output is written.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.constants import BLOCK
from lithospark.functions import blocks as blk
from lithospark.functions import paths
from lithospark.operators import aggregate, classify, joins, ordering, overlay, rules, windows
from lithospark.plans import image
from lithospark.plans import workflows as w
from lithospark.plans.options import assignments, entry_argument
from lithospark.session import local_session
from lithospark.sources import documents, layouts, sinks


def _list(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return sinks.console_listing(w.entry_listing(w.load(spark, "entries", a.path), w.load(spark, "names", a.path)))


def _list_image(spark, a):
    return sinks.console_listing(w.image_listing(w.load(spark, "dirents", a.path), w.load(spark, "inodes", a.path), a.root))


def _info(spark, a):
    head = w.load(spark, "header", a.path)
    return head.select("file", "content_id", *(F.col(c) for c in ("content_type", "drm_type", "entry_count", "package_size", "pfs_image_offset", "pfs_image_size")))


def _entries(spark, a):
    named = joins.named_entries(w.load(spark, "entries", a.path), w.load(spark, "names", a.path))
    return ordering.by_id(named).select("ordinal", F.format_string("0x%X", "id").alias("id"), "name", "data_offset", "data_size", "is_encrypted", "key_index")


def _fields(spark, a):
    return classify.field_dump(w.load(spark, "header", a.path), "file", [name for name, _, _ in layouts.HEADER_FIELDS])


def _verify(spark, a):
    entries, payloads = w.load(spark, "entries", a.path), w.load(spark, "payloads", a.path)
    table = payloads.where("id = 1").select("file", "data")
    n = F.col("n").cast("int")
    slots = entries.groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(table, "file").withColumn("ordinal", F.explode(F.sequence(F.lit(0), n - 1)))
    digests = slots.select("file", F.col("ordinal").cast("long").alias("ordinal"), F.substring(F.col("data"), F.col("ordinal") * 32 + 1, F.lit(32)).alias("stored"))
    return rules.verified_entries(entries, payloads, digests).orderBy("file", "ordinal")


def _validate(spark, a):
    load = lambda r: w.load(spark, r, a.path)
    return w.validate_packages(load("header"), load("entries"), load("payloads"), load("regions"), a.tolerant).orderBy("file", "stage", "ordinal")


def _validate_container(spark, a):
    load = lambda r: w.load(spark, r, a.path)
    return w.validate_containers(load("container_header"), load("container_table"), load("container_blocks")).orderBy("file", "stage", "ordinal")


def _sweep(spark, a):
    report = w.sweep(spark, a.path, a.suffix)
    if a.output:
        sinks.write_sweep(report, a.output)
    return w.sweep_summary(report)["types"]


def _sfo(spark, a):
    return w.load(spark, "sfo", a.path).orderBy("file", "ordinal").select("file", "key", "format", "value")


def _trophies(spark, a):
    return ordering.by_trophy_class(w.load(spark, "trophies", a.path)).select("name", "offset", "size")


def _audio(spark, a):
    return w.load(spark, "audio", a.path)


def _relation(spark, a):
    return w.load(spark, a.relation, a.path)


def _extract(spark, a):
    path, entry = entry_argument(a.path)
    listing = w.entry_listing(w.load(spark, "entries", path), w.load(spark, "names", path))
    if entry is not None:
        listing = listing.where(F.lower("path") == entry.lower())
    rows = listing.join(w.load(spark, "payloads", path).select("file", F.col("id").alias("entry_id"), "data"), ["file", "entry_id"])
    return sinks.extract(rows, a.output, not a.stop)


def _profile(spark, a):
    """Policies of a container's files, or with --ref how they differ from a profile's."""
    load = lambda r: w.load(spark, r, a.path)
    if a.stats:
        return aggregate.image_stats(windows.stored_sizes(load("container_table")), a.block, ["file"])
    policies = w.image_policies(w.image_listing(load("dirents"), load("inodes"), a.root), load("inodes"), load("container_table"), a.block)
    if a.output:
        sinks.extract(sinks.profile_json(policies).select(F.lit(_name(a.output)).alias("path"), F.encode("json", "utf-8").alias("data")), _folder(a.output), False).collect()
    if not a.ref:
        return policies.orderBy("path")
    text = spark.read.text(a.ref, wholetext=True).select(F.lit("reference").alias("file"), F.col("value").alias("json"))
    report = w.profile_report(policies, documents.profile_policies(text))
    return report["mismatches"] if a.mismatches else report["counts"]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _folder(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else "."


def _dump(spark, root: str) -> DataFrame:
    """(area, path, size) of a folder dump."""
    return documents.folder(spark, root).select(F.substring_index("path", "/", 1).alias("area"), F.expr("substr(path, instr(path, '/') + 1)").alias("path"), "size")


def _restructure(spark, a):
    return w.restructure_plan(_dump(spark, a.path).select("area", "path"), a.for_packager).orderBy("target")


def _repack(spark, a):
    return w.repack_plan(_dump(spark, a.path))[a.show]


def _identity(spark, root: str, side: str) -> DataFrame:
    """The type and title id that a dump's metadata file tells."""
    files = documents.folder(spark, root).where(F.lower("path").isin("sc0/param.sfo", "image0/sce_sys/param.sfo")).orderBy("path").limit(1).select("path").collect()
    values = w.load(spark, "sfo", f"{root}/{files[0].path}") if files else w.load(spark, "sfo", root, suffix="no such file")
    found = classify.sfo_lookup(values, ["CATEGORY", "TITLE_ID", "CONTENT_ID", "TITLE"])
    kind = classify.package_type(F.col("CATEGORY"), F.lit(0), F.col("CONTENT_ID"), F.col("TITLE"))
    return found.select(kind.alias(f"{side}_type"), F.col("TITLE_ID").alias(f"{side}_title_id"), F.lit(1).alias("pair"))


def _merge(spark, a):
    """The plan of a merge; problems of the request or of the pair come first."""
    asked = classify.request_problems({"base": a.path, "update": a.update, "output": a.target, "workers": a.workers})
    if asked:
        return spark.createDataFrame([(p,) for p in asked], "problem string")
    pair = spark.createDataFrame([(1,)], "pair int").join(_identity(spark, a.path, "base"), "pair", "left").join(_identity(spark, a.update, "update"), "pair", "left")
    plan = w.merge_plan(pair, _dump(spark, a.path), _dump(spark, a.update))
    problems = plan["problems"].select("problem")
    return problems if not problems.isEmpty() else plan[a.show]


def _gp4gen(spark, a):
    """The project of a folder of game files, as a relation; --output writes the document."""
    plan = w.project_plan(documents.folder(spark, a.path).select("path", "size"), documents.folder_directories(spark, a.path))
    if a.output:
        rows = plan.select("path", "compression", "is_directory").toLocalIterator()  # one document
        files, empty = [], []
        for r in rows:
            empty.append(r.path) if r.is_directory else files.append((r.path, r.path, r.compression))
        text = sinks.project_xml(dict(assignments(a.values)), files, empty)
        one = spark.createDataFrame([(_name(a.output), bytearray(text.encode()))], "path string, data binary")
        sinks.extract(one, _folder(a.output), False).collect()
    return plan


def _build(spark, a):
    """Writes the plaintext image of a folder, and with --container its compressed container; what else a build holds is a plan."""
    files = documents.folder(spark, a.path).select("path", "size")
    layout = image.image_layout(files, documents.folder_directories(spark, a.path))
    done = image.write_image(layout, image.folder_contents(spark, a.path), a.output).collect()
    container = None
    if a.container:
        content = image.image_pieces(layout, image.folder_contents(spark, a.path))
        size, name = done[0].bytes, _name(a.container)
        blocks = image.whole_blocks(content, size // BLOCK).select(F.lit(name).alias("file"), "block_no", "data")
        container = sinks.write_containers(sinks.container_layout(blk.store_blocks(blocks)), _folder(a.container)).collect()[0].bytes
    return sinks.build_manifest(files, dict(assignments(a.values)), {"inner_size": done[0].bytes, "container_size": container, "mode": "container" if container else "none"})


def _compare(spark, a):
    """Where two images differ; paths do not matter."""
    here, there = (lambda r, p=p: w.load(spark, r, p).withColumn("file", F.lit("image")) for p in (a.path, a.other))
    owners = lambda load: load("image_blocks").groupBy(F.col("block").alias("block_no")).agg(F.min("inode").alias("owner"))
    inodes = lambda load: load("inodes").select("file", F.col("inode").alias("ordinal"), "raw")
    found = w.image_diff(here("image_header"), there("image_header"), inodes(here), inodes(there), owners(here), owners(there))
    return found[a.show]


def _path_table(spark, a):
    return w.path_table(w.load(spark, "image_content", a.path)).select("ordinal", F.format_string("%08X", "hash").alias("hash"), F.format_string("%08X", "slot").alias("slot"), "inode", "flags").orderBy("ordinal")


def _sfo_set(spark, a):
    """A metadata file with values set; a path that names no file gives one with nothing else."""
    edits = spark.createDataFrame([("sfo", k, v) for k, v in assignments(a.values)], "file string, key string, value string")
    values = w.load(spark, "sfo", a.path).withColumn("file", F.lit("sfo")) if not a.new else w.load(spark, "sfo", _folder(a.output), suffix="no such file")
    kept = values.select("file", "key", "format", "max_length", "number", "text")
    rows = overlay.sfo_upsert(kept, classify.sfo_edits(values, edits))
    if a.output:
        sinks.extract(sinks.sfo_files(rows).select(F.lit(_name(a.output)).alias("path"), F.col("content").alias("data")), _folder(a.output), False).collect()
    return rows.orderBy("key")


def _trophies_create(spark, a):
    """A trophy archive of the files in a folder."""
    files = spark.read.format("binaryFile").load(a.path).select(F.lit("archive").alias("file"), paths.basename(F.col("path")).alias("name"), F.col("content").alias("data"))
    sinks.extract(sinks.trophy_files(files).select(F.lit(_name(a.output)).alias("path"), F.col("content").alias("data")), _folder(a.output), False).collect()
    return ordering.by_trophy_class(files.select("name", F.octet_length("data").alias("size")))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lithospark", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, run, **options) -> None:
        c = commands.add_parser(name, help=(run.__doc__ or name))
        c.add_argument("path")
        c.add_argument("--limit", type=int, help="rows to print; all without it")
        for option, settings in options.items():
            c.add_argument("--" + option.replace("_", "-"), **settings)
        c.set_defaults(run=run)

    add("list", _list)
    add("list-image", _list_image, root={"type": int, "default": 0})
    add("info", _info)
    add("entries", _entries)
    add("fields", _fields)
    add("verify", _verify)
    add("validate", _validate, tolerant={"action": "store_true"})
    add("validate-container", _validate_container)
    add("sweep", _sweep, suffix={"default": ".pkg"}, output={})
    add("sfo", _sfo)
    add("trophies", _trophies)
    add("audio", _audio)
    flag = {"action": "store_true"}
    add("profile", _profile, block={"type": int, "default": 0x10000}, root={"type": int, "default": 2}, ref={}, output={}, stats=flag, mismatches=flag)
    add("restructure", _restructure, for_packager=flag)
    add("repack", _repack, show={"default": "project"})
    add("merge", _merge, update={"required": True}, target={"default": "merged"}, workers={"type": int, "default": 0}, show={"default": "project"})
    add("gp4gen", _gp4gen, output={}, values={"nargs": "*", "default": []})
    add("build", _build, output={"required": True}, container={}, values={"nargs": "*", "default": []})
    add("compare", _compare, other={"required": True}, show={"default": "fields", "choices": ["fields", "words", "first", "blocks"]})
    add("path-table", _path_table)
    add("sfo-set", _sfo_set, values={"nargs": "+", "required": True}, output={}, new=flag)
    add("trophies-create", _trophies_create, output={"required": True})
    add("extract", _extract, output={"required": True}, stop={"action": "store_true"})
    add("relation", _relation, relation={"required": True})
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(arguments)
    result = a.run(spark or local_session(cores="*"), a)
    print("\t".join(result.columns))
    for row in (result if a.limit is None else result.limit(a.limit)).toLocalIterator(prefetchPartitions=True):
        print("\t".join("" if v is None else v.hex() if isinstance(v, (bytes, bytearray)) else str(v) for v in row))
    return result


if __name__ == "__main__":
    main()
