"""The composed commands as chains of relations. Each ends in a table that says what would be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.constants import BLOCK, IMAGE_FIELDS, REMADE_FILES
from lithospark.functions import scalars
from lithospark.functions.paths import normalize_key
from lithospark.operators import aggregate, classify, joins, ordering, overlay, rules, trees, windows
from lithospark.sources import containers


def load(spark: SparkSession, relation: str, path: str, **options: str) -> DataFrame:
    containers.register(spark)
    return spark.read.format("strata").options(relation=relation, path=path, **options).load()


# Sweep.


def sweep(spark: SparkSession, path: str, suffix: str = ".pkg") -> DataFrame:
    """A row for each package: OK with what it says of itself and its type, or FAIL with the error."""
    rows = load(spark, "sweep", path, suffix=suffix)
    kind = classify.package_type(F.col("category"), F.col("content_type"), F.col("content_id"), F.col("title"))
    return rows.withColumn("type", F.when(F.col("status") == "OK", kind))


def sweep_summary(report: DataFrame) -> dict[str, DataFrame]:
    return {
        "outcome": aggregate.outcome(report),
        "types": aggregate.count_by(report.where("status = 'OK'"), "type"),
        "failures": ordering.first_n(aggregate.failures(report).select("file", "error"), 20, "file"),
    }


# list, entries, info.


def entry_listing(entries: DataFrame, names: DataFrame) -> DataFrame:
    """The files of the entry table: names by offset, by id, or made of the id."""
    named = joins.named_entries(entries.where(classify.is_content_entry(F.col("id"))), names)
    return named.select(
        "file", classify.entry_name(F.when(F.col("name").isNotNull(), F.concat(F.lit("Sc0/"), "name")), F.col("id")).alias("path"), F.col("data_size").alias("size"), F.col("data_size").alias("packed_size"),
        F.lit(False).alias("is_directory"), "is_encrypted", F.col("id").alias("entry_id"), F.col("data_offset").alias("offset"),
    )


def image_listing(dirents: DataFrame, inodes: DataFrame, root: int) -> DataFrame:
    """Files and directories below the root's inode, with their sizes."""
    walk = trees.tree_walk(dirents.where("name <> 'flat_path_table'"), root).join(inodes.select("file", "inode", F.col("size").alias("_stored"), "size_uncompressed"), ["file", "inode"])
    size, packed = classify.file_sizes(F.col("_stored"), F.col("size_uncompressed"))
    return walk.select(
        "file", F.concat(F.lit("Image0/"), "path").alias("path"), size.alias("size"), packed.alias("packed_size"), (F.col("type") == trees.DIRECTORY).alias("is_directory"), F.lit(False).alias("is_encrypted"),
        F.lit(None).cast("long").alias("entry_id"), F.lit(None).cast("long").alias("offset"), "inode",
    )


def listing(entries: DataFrame, image: DataFrame | None = None) -> DataFrame:
    return ordering.by_path(entries if image is None else overlay.union_listing(entries, image))


def package_info(sfo: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each package: its named values and type."""
    wanted = ["TITLE", "TITLE_ID", "CATEGORY", "APP_VER", "VERSION", "CONTENT_ID"]
    values = classify.sfo_lookup(sfo, wanted)
    joined = headers.select("file", F.col("content_id").alias("header_content_id"), "content_type").join(values, "file", "left")
    kind = classify.package_type(F.col("CATEGORY"), F.col("content_type"), F.col("header_content_id"), F.col("TITLE"))
    return joined.withColumn("type", kind).withColumn("app_version", classify.first_version(F.col("APP_VER"), F.col("VERSION")))


def inner_content(content: DataFrame, listing_: DataFrame) -> DataFrame:
    """(path, ordinal, data) of the image files of a listing, block by block."""
    return listing_.where(~F.col("is_directory")).select("file", "inode", "path").join(content, ["file", "inode"]).select("file", "path", "ordinal", "data")


def image_diff(left: DataFrame, right: DataFrame, left_inodes: DataFrame | None = None, right_inodes: DataFrame | None = None, left_blocks: DataFrame | None = None, right_blocks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Where two images of one name differ: header fields, and as far as they are given raw inode words and use of blocks.

    Inodes: (file, ordinal, raw); blocks: (block_no, owner). words has the place
    of each differing word and first the least of each file; blocks has those
    whose owners differ.
    """
    fields = [c for c in IMAGE_FIELDS if c in left.columns]
    out = {"fields": classify.field_diff(classify.field_rows(left, "file", fields), classify.field_rows(right, "file", fields), ["file", "field"])}
    if left_inodes is not None and right_inodes is not None:
        out["words"] = joins.differing_words(left_inodes, right_inodes)
        out["first"] = aggregate.first_divergence(out["words"].withColumn("offset", F.col("ordinal") * F.lit(1 << 20) + F.col("offset")))
    if left_blocks is not None and right_blocks is not None:
        out["blocks"] = joins.block_use(left_blocks, right_blocks).where(~F.col("left_owner").eqNullSafe(F.col("right_owner")))
    return out


# Profile.


def container_profile(blocks: DataFrame, files: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(policies of files, statistics of images); blocks with stored_size, files with start_block and block_count."""
    return joins.range_policies(files, blocks, block), aggregate.image_stats(blocks, block, ["file"])


def image_policies(listing_: DataFrame, inodes: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, path, policy) of an image's files by the stored sizes of their blocks; no block is inflated."""
    start = F.get("direct", F.lit(0))
    files = listing_.where(~F.col("is_directory")).select("file", "inode", "path").join(inodes.select("file", "inode", start.alias("start_block"), F.col("blocks").alias("block_count")), ["file", "inode"])
    return joins.range_policies(files, windows.stored_sizes(table).where("stored_size is not null"), block).select("file", "path", "policy")


def path_table(content: DataFrame) -> DataFrame:
    """(file, ordinal, hash, slot, inode, flags) of an image's path table, from its content."""
    rows = content.where("inode = 1").withColumn("k", F.explode(F.sequence(F.lit(0), (F.octet_length("data") / 8).cast("int") - 1)))
    number = lambda at: F.conv(F.concat(*(F.hex(F.substring(F.col("data"), F.col("k") * 8 + at + b, F.lit(1))) for b in (4, 3, 2, 1))), 16, 10).cast("long")
    slots = rows.select("file", (F.col("ordinal") * F.lit(BLOCK // 8) + F.col("k")).alias("ordinal"), number(0).alias("hash"), number(4).alias("slot"))
    return slots.withColumns({"inode": scalars.slot_inode(F.col("slot")), "flags": scalars.slot_flags(F.col("slot"))})


def profile_report(this: DataFrame, other: DataFrame) -> dict[str, DataFrame]:
    diff = joins.policy_diff(this, other)
    return {"counts": joins.diff_counts(diff), "mismatches": ordering.first_n(diff.where("status = 'mismatched'"), 20, "path")}


# L3: restructure.


def restructure_plan(files: DataFrame, for_packager: bool = False) -> DataFrame:
    """files (area, path) with action and target: entry files move below sce_sys, and what a packager makes anew goes.

    Without for_packager nothing but leftovers is deleted; app/playgo-chunk.dat always stays.
    """
    target = F.when(F.col("area") == "Sc0", F.concat(F.lit("sce_sys/"), "path")).otherwise(F.col("path"))
    moved = files.withColumn("target", target).withColumn("_key", F.lower(target))
    gone = F.col("_key") == "sce_sys/param.sfo.original"
    if for_packager:
        gone = gone | F.col("_key").isin([f"sce_sys/{n}" for n in REMADE_FILES] + [f"sce_sys/app/{n}" for n in REMADE_FILES if n != "playgo-chunk.dat"])
    action = F.when(gone, "delete").when(F.col("area") == "Sc0", "move").otherwise("keep")
    # What moves replaces what is there.
    latest = F.max(F.struct((F.col("area") == "Sc0").cast("int").alias("o"), "area", "path", "target", "action"))
    return moved.withColumn("action", action).groupBy("_key").agg(latest.alias("b")).select("b.area", "b.path", "b.target", "b.action")


# L4: project.


def project_plan(files: DataFrame, directories: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Files with their compression attribute in path order, and empty directories with a trailing slash."""
    own = files.where(~classify.is_managed_file(F.col("path")))
    ruled = own.withColumn("policy", F.lit(None).cast("string")) if profile is None else joins.with_policy(own, profile)
    # A profile's none becomes enable, as an attribute has two values only.
    given = F.when(F.col("policy") == "none", "enable").otherwise(F.col("policy"))
    rows = ruled.select("path", "size", classify.compression_attribute(F.col("path"), given).alias("compression"), F.lit(False).alias("is_directory"))
    empty = overlay.empty_directories(directories, files.select("path")).select(F.concat("path", F.lit("/")).alias("path"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("compression"), F.lit(True).alias("is_directory"))
    return rows.unionByName(empty).orderBy("is_directory", F.lower("path"), "path")


# Build.


def build_plan(files: DataFrame, profile: DataFrame | None = None, block: int = BLOCK) -> dict[str, DataFrame]:
    """What a build would hold: files by layer, nodes with ordinals, the path table, and the blocks of image files with their policy.

    files: (path, size, compression). Nothing is encrypted or signed.
    """
    routed = classify.routed(files)
    image = routed.where("layer = 'image'")
    attributes = image.select("path", F.col("compression").alias("policy"))
    policies = attributes.withColumn("path", normalize_key(F.col("path"))) if profile is None else overlay.policy_precedence(attributes, profile)
    parents = overlay.parent_closure(image, "target", fold=False).select("path", F.lit(True).alias("is_directory"))
    nodes = parents.unionByName(image.select(F.col("target").alias("path"), F.lit(False).alias("is_directory")))
    numbered = windows.ordinals(nodes, start=1)
    hashed = numbered.withColumn("hash", joins.hash31(F.concat(F.lit("/"), F.col("path"))))
    shared = aggregate.collisions(hashed, "hash", "path")
    # A slot leads to an inode; one that several paths share leads to a list of them instead.
    flag = F.when(F.col("is_directory"), F.lit(2 << 28)).otherwise(F.lit(0)).cast("long")
    table = hashed.join(shared.select("hash", F.lit(True).alias("_shared")), "hash", "left")
    slots = table.select("hash", "path", F.coalesce("_shared", F.lit(False)).alias("collides"), F.when(F.col("_shared"), F.lit(0x80000000)).otherwise(F.col("ordinal") + flag).alias("slot"))
    layout = windows.block_layout(image.select(F.col("target").alias("path"), "size").withColumn("_key", F.lower("path")), "size", ["_key", "path"], block).drop("_key")
    placed = layout.withColumn("_key", normalize_key(F.col("path"))).join(policies.withColumnRenamed("path", "_key"), "_key", "left").drop("_key")
    entries = windows.aligned_offsets(routed.where("layer = 'entry'").select("entry_id", "target", "size", F.lit("package").alias("file")), "size", ["entry_id"], ["file"])
    return {
        "entries": entries, "nodes": numbered, "path_table": slots.orderBy("hash", "path"), "collisions": shared, "layout": placed, "raw_blocks": joins.raw_blocks(placed, placed.select("path", "policy")),
        "space": aggregate.space_estimate(image, "size", block=block),
    }


# L1, L2: merge and repack.


def merge_plan(pair: DataFrame, base: DataFrame, update: DataFrame, base_profile: DataFrame | None = None, update_profile: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """Problems of the pair, the overlaid tree with where each file comes from, its restructured form, profile and build.

    base, update: (area, path, size). The metadata file is never overlaid.
    """
    problems = classify.pair_problems(pair)
    keyed = [t.select("area", F.concat_ws("/", "area", "path").alias("full"), "path", "size") for t in (base, update.where(~classify.is_overlay_exempt(F.col("area"), F.col("path"))))]
    tree = overlay.overlay_files(*keyed, path="full").withColumn("source", F.when(F.col("layer") == 0, "base").otherwise("update"))
    plan = restructure_plan(tree.select("area", "path"))
    sizes = tree.select("area", "path", "size", "source")
    files = plan.where("action <> 'delete'").join(sizes, ["area", "path"]).select(F.col("target").alias("path"), "size", "source")
    profile = overlay.overlay_profiles(base_profile, update_profile) if update_profile is not None else base_profile
    directories = overlay.parent_closure(files)
    project = project_plan(files, directories, profile)
    build = build_plan(project.where("not is_directory").select("path", "size", "compression"), profile)
    return {"problems": problems, "tree": tree.drop("full", "layer"), "restructured": plan, "project": project, "profile": profile} | {f"build_{k}": v for k, v in build.items()}


def repack_plan(tree: DataFrame, profile: DataFrame | None = None) -> dict[str, DataFrame]:
    """The same for one tree: restructured, as a project, and built."""
    plan = restructure_plan(tree.select("area", "path"))
    files = plan.where("action <> 'delete'").join(tree, ["area", "path"]).select(F.col("target").alias("path"), "size")
    project = project_plan(files, overlay.parent_closure(files), profile)
    return {"restructured": plan, "project": project} | {f"build_{k}": v for k, v in build_plan(project.where("not is_directory").select("path", "size", "compression"), profile).items()}


# Validate.


# Entries whose payloads a header digest covers, in the order of the chain.
DIGEST_CHAINS = {"entries_digest_1": [0x10, 0x20, 0x80, 0x100, 0x1], "entries_digest_2": [0x10, 0x20, 0x80, 0x100], "table_digest": [0x1]}
#: Of the table of entries the second chain covers the six system records only.
SHORT_TABLE = 6 * 32


def package_digests(headers: DataFrame, payloads: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, ordinal, structure, stored, computed) for the seven digests of each package header."""
    computed = []
    for name, ids in DIGEST_CHAINS.items():
        short = (F.col("id") == 0x100) & F.lit(name == "entries_digest_2")
        cut = payloads.withColumn("data", F.when(short, F.substring("data", 1, SHORT_TABLE)).otherwise(F.col("data")))
        computed.append(aggregate.chained_digest(cut, ["file"], "id", "data", ids).select("file", F.lit(name).alias("structure"), "digest"))
    keyed = regions.withColumn("key", F.concat_ws("|", "region", "file"))
    found = aggregate.region_digest(keyed, "key")
    computed.append(found.select(F.regexp_extract("key", "^[a-z_]+\\|(.*)$", 1).alias("file"), F.substring_index("key", "|", 1).alias("structure"), "digest"))
    names = [*DIGEST_CHAINS, "header_digest", "body_digest", "image_digest", "signed_digest"]
    stored = headers.unpivot("file", names, "structure", "stored")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("structure")).cast("int")
    return stored.join(rules.union(computed), ["file", "structure"], "left").select("file", place.alias("ordinal"), "structure", "stored", F.unhex("digest").alias("computed"))


def validate_packages(headers: DataFrame, entries: DataFrame, payloads: DataFrame | None = None, regions: DataFrame | None = None, tolerant: bool = False) -> DataFrame:
    found = [rules.header_violations(headers), rules.entry_violations(entries), rules.duplicate_violations(entries)]
    if payloads is not None and regions is not None:
        found.append(rules.digest_violations(package_digests(headers, payloads, regions), tolerant))
    return rules.union(found)


def validate_containers(headers: DataFrame, table: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    found = [rules.container_violations(headers), rules.table_violations(table, headers)]
    if blocks is not None:
        found.append(rules.content_violations(blocks, headers))
    return rules.union(found)


def validate_images(inodes: DataFrame, pointers: DataFrame, blocks: Column) -> DataFrame:
    return rules.inode_violations(inodes, pointers, blocks)


def verdict(violations: DataFrame, group: str = "file") -> DataFrame:
    """The first violation of each file: validation ends there."""
    return ordering.fail_fast(violations.where("severity = 'failure'"), group)
