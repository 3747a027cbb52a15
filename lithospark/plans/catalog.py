"""Queries over the driver's tables, each an analogue of an operator over package relations, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.constants import ENTRY_NAMES, MANAGED_FILES
from lithospark.functions import blocks as blk
from lithospark.functions import hashes, paths, scalars
from lithospark.operators import aggregate, classify, joins, ordering, overlay, trees, windows
from lithospark.plans import rule_queries, shape_queries  # noqa: F401  they register their queries
from lithospark.plans.registry import QUERIES, SQL, query, table
from lithospark.sources import documents

STRICT_URL = r"^https?://[a-z0-9.-]+(/[^?#]*)?$"
TLD = r"^[a-z]+://[^/?#]*\.([a-z]+)"


def swept(pages: DataFrame) -> DataFrame:
    """A status row for each page's address, whatever it looks like."""
    return pages.select(
        "page_id",
        "url",
        F.when(F.col("url").rlike(STRICT_URL), "OK").otherwise("FAIL").alias("status"),
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", TLD, 1).alias("tld"),
    )


@query(rf"""
SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '{TLD}', 1) AS tld,
       CASE WHEN regexp_matches(url, '{STRICT_URL}') THEN 'OK' ELSE 'FAIL' END AS status, count(*)::BIGINT AS n
FROM pages GROUP BY ALL
""")
def sweep_report(spark, sf_dir):
    return aggregate.count_by(swept(table(spark, sf_dir, "pages")), "scheme", "tld", "status")


@query(rf"""
SELECT count(*) FILTER (regexp_matches(url, '{STRICT_URL}'))::BIGINT AS ok, count(*) FILTER (NOT regexp_matches(url, '{STRICT_URL}'))::BIGINT AS fail FROM pages
""")
def sweep_outcome(spark, sf_dir):
    return aggregate.outcome(swept(table(spark, sf_dir, "pages")))


@query("""
WITH p AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' theme' ELSE '' END AS title,
  CASE p_size % 9 WHEN 0 THEN 'gd' WHEN 1 THEN 'GP' WHEN 2 THEN 'th' WHEN 3 THEN 'av' WHEN 4 THEN 'wa' WHEN 5 THEN 'ac' WHEN 6 THEN 'zz' WHEN 7 THEN '' END AS category,
  CASE p_partkey % 4 WHEN 0 THEN 26 WHEN 1 THEN 30 ELSE 27 END AS content_type,
  CASE WHEN p_partkey % 11 = 0 THEN 'ip9102-X' ELSE 'EP0001-X' END AS content_id FROM part),
a AS (SELECT *, CASE WHEN lower(content_id[1:6]) IN ('ip9100', 'ip9102', 'ip9104') OR contains(lower(title), 'theme') THEN 'Theme' ELSE 'Dlc' END AS addon, lower(coalesce(category, '')) AS k FROM p)
SELECT p_partkey, CASE WHEN k = 'gd' THEN 'Game' WHEN k = 'gp' THEN 'Patch' WHEN k = 'th' THEN 'Theme' WHEN k = 'av' THEN 'Avatar' WHEN k = 'wa' THEN 'Wallpaper'
  WHEN k IN ('ac', 'al') THEN addon WHEN k <> '' THEN 'Addon' WHEN content_type = 26 THEN 'Game' WHEN content_type = 30 THEN 'Patch' ELSE addon END AS package_type FROM a
""")
def type_classify(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("gd", "GP", "th", "av", "wa", "ac", "zz", "", None))), F.col("p_size") % 9 + 1)
    number = F.when(F.col("p_partkey") % 4 == 0, 26).when(F.col("p_partkey") % 4 == 1, 30).otherwise(27)
    content = F.when(F.col("p_partkey") % 11 == 0, "ip9102-X").otherwise("EP0001-X")
    title = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, " theme").otherwise(""))
    return part.select("p_partkey", classify.package_type(kind, number, content, title).alias("package_type"))


@query("""
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS name, CASE event_id % 7 WHEN 0 THEN 256 WHEN 1 THEN 128 ELSE event_id % 60000 + 4096 END AS id FROM events)
SELECT event_id, coalesce(name, 'Sc0/entry_' || printf('%04X', id) || '.bin') AS name FROM e WHERE id NOT IN (1, 16, 32, 128, 256, 512)
""")
def meta_exclude(spark, sf_dir):
    number = F.when(F.col("event_id") % 7 == 0, 256).when(F.col("event_id") % 7 == 1, 128).otherwise(F.col("event_id") % 60000 + 4096)
    entries = table(spark, sf_dir, "events").select("event_id", number.alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("name"))
    return entries.where(classify.is_content_entry(F.col("id"))).select("event_id", classify.entry_name(F.col("name"), F.col("id")).alias("name"))


@query("""
SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'system'), '') AS "system", coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS "user",
  coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS assistant FROM conversations GROUP BY conv_id
""")
def eav_pivot(spark, sf_dir):
    return classify.sfo_lookup(table(spark, sf_dir, "conversations"), ["system", "user", "assistant"], by="role", value="text", group="conv_id", order="turn")


@query("""
SELECT o_orderkey, coalesce(nullif(trim(CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE o_orderstatus END), ''), nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c_mktsegment END), ''), 'none') AS version,
  greatest(o_custkey, o_orderkey % 1000) AS system_version FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def version_fallback(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    first = F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 2, F.col("o_orderstatus"))
    second = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    return rows.select("o_orderkey", classify.first_version(first, second, F.lit("none")).alias("version"), classify.newer(F.col("o_custkey"), F.col("o_orderkey") % 1000).alias("system_version"))


# An address as a path of either dialect, with trailing slashes and a prefix on some.
ODD_PATH_SQL = "CASE page_id % 4 WHEN 0 THEN ' Image0/' || url || '/ ' WHEN 1 THEN replace(url, '/', chr(92)) || '//' WHEN 2 THEN 'Sc0/' || url ELSE url END"


def odd_path():
    k, url = F.col("page_id") % 4, F.col("url")
    return F.when(k == 0, F.concat(F.lit(" Image0/"), url, F.lit("/ "))).when(k == 1, F.concat(F.replace(url, F.lit("/"), F.lit("\\")), F.lit("//"))).when(k == 2, F.concat(F.lit("Sc0/"), url)).otherwise(url)


@query(rf"""
WITH p AS (SELECT page_id, {ODD_PATH_SQL} AS path FROM pages)
SELECT page_id, lower(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/+$', ''), '^image0/', '', 'i')) AS "key", replace(regexp_replace(trim(path), '/+$', ''), chr(92), '/') AS entry_path,
  CASE WHEN starts_with(lower(path), 'sc0/') THEN path ELSE 'Sc0/' || path END AS with_prefix, CASE WHEN starts_with(lower(path), 'sc0/') THEN path[5:] ELSE path END AS without_prefix,
  regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::BIGINT AS depth FROM p
""")
def path_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", odd_path().alias("path"))
    c = F.col("path")
    return p.select(
        "page_id", paths.normalize_key(c).alias("key"), paths.normalize_entry_path(c).alias("entry_path"), paths.prefixed(c, "Sc0/").alias("with_prefix"),
        paths.unprefixed(c, "Sc0/").alias("without_prefix"), paths.basename(c).alias("base"), paths.dirname(c).alias("dir"), F.size(paths.segments(c)).cast("long").alias("depth"),
    )


@query("""
WITH s AS (SELECT list_filter(string_split(url, '/'), lambda s: s <> '') AS parts FROM pages),
a AS (SELECT array_to_string(parts[1:k], '/') AS path FROM s, unnest(range(1, len(parts))) AS t(k)),
c AS (SELECT min(path) AS path FROM a GROUP BY lower(path))
SELECT path FROM c WHERE lower(path) NOT IN (SELECT lower(array_to_string(parts, '/')) FROM s)
""")
def path_ancestors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.array_join(paths.segments(F.col("url")), "/").alias("path"))
    return overlay.missing_parents(pages)


HASH31_SQL = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper({0}), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"


@query(f"""
WITH h AS (SELECT 'part' AS kind, p_partkey AS id, {HASH31_SQL.format("p_name")} AS "hash" FROM part UNION ALL SELECT 'page', page_id, {HASH31_SQL.format("url")} FROM pages)
SELECT *, "hash" & 268435455 AS inode, "hash" >> 28 AS flags FROM h
""")
def path_hash31(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), hashes.hash31(F.col("p_name")).alias("hash"))
    page = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), hashes.hash31(F.col("url")).alias("hash"))
    h = part.unionByName(page)
    return h.withColumn("inode", scalars.slot_inode(F.col("hash"))).withColumn("flags", scalars.slot_flags(F.col("hash")))


@query(f"""
WITH d AS (SELECT DISTINCT p_name FROM part), h AS (SELECT {HASH31_SQL.format("p_name")} % 64 AS slot, p_name FROM d)
SELECT slot, string_agg(p_name, '|' ORDER BY p_name) AS paths, count(*)::BIGINT AS n FROM h GROUP BY slot HAVING count(*) > 1
""")
def hash_collisions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", (hashes.hash31(F.col("p_name")) % 64).alias("slot"))
    found = aggregate.collisions(part, "slot", "p_name")
    return found.select("slot", F.array_join("paths", "|").alias("paths"), F.size("paths").cast("long").alias("n"))


@query("""
SELECT n_nationkey, n_name, (1 + coalesce(sum(strlen(n_name) + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM nation
""")
def name_offsets(spark, sf_dir):
    return windows.name_offsets(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", "n_nationkey")


LAYOUT_SQL = """
c AS (SELECT doc_id, source, n_chars, greatest(1, (n_chars + 4095) // 4096) AS block_count FROM documents),
l AS (SELECT *, coalesce(sum(block_count) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_block FROM c)
"""


def laid_out(spark, sf_dir) -> DataFrame:
    return windows.block_layout(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "n_chars", ["doc_id"], block=4096)


@query(f"WITH {LAYOUT_SQL} SELECT doc_id, n_chars, block_count::BIGINT AS block_count, start_block FROM l")
def block_layout(spark, sf_dir):
    return laid_out(spark, sf_dir).select("doc_id", "n_chars", "block_count", "start_block")


@query("""
SELECT source, doc_id, coalesce(sum((n_chars + 15) // 16 * 16) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents
""")
def aligned_offsets(spark, sf_dir):
    return windows.aligned_offsets(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "n_chars", ["doc_id"], ["source"]).drop("n_chars")


# A table of blocks: one for each document, of stored size n_chars capped at the block size.
BLOCKS_SQL = "b AS (SELECT doc_id AS block_no, 'image' AS file, coalesce(sum(least(n_chars, 2048)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents), s AS (SELECT *, lead(\"offset\") OVER (ORDER BY block_no) - \"offset\" AS stored_size FROM b)"


def block_table(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("image").alias("file"), F.col("doc_id").alias("block_no"), F.least("n_chars", F.lit(2048)).alias("size"))
    offsets = windows.running_before(docs, "size", ["block_no"], "offset").drop("size")
    return windows.stored_sizes(offsets)


@query(f"""
WITH {BLOCKS_SQL} SELECT file, count(stored_size)::BIGINT AS blocks, count(*) FILTER (stored_size = 2048)::BIGINT AS raw_blocks, count(*) FILTER (stored_size <> 2048)::BIGINT AS compressed_blocks,
 coalesce(sum(stored_size) FILTER (stored_size = 2048), 0)::BIGINT AS raw_bytes, coalesce(sum(stored_size) FILTER (stored_size <> 2048), 0)::BIGINT AS compressed_bytes,
 100.0::DOUBLE * count(*) FILTER (stored_size <> 2048) / greatest(1, count(stored_size)) AS compressed_percent FROM s GROUP BY file
""")
def stored_size(spark, sf_dir):
    return aggregate.image_stats(block_table(spark, sf_dir), 2048, ["file"])


@query(f"""
WITH {BLOCKS_SQL}, f AS (SELECT c_custkey, c_custkey % 700 AS start_block, c_custkey % 5 AS block_count FROM customer),
m AS (SELECT max(block_no) AS most FROM s WHERE stored_size IS NOT NULL)
SELECT c_custkey, CASE WHEN block_count = 0 OR start_block = 0 OR start_block + block_count - 1 > (SELECT most FROM m) + 1 THEN 'none'
  WHEN EXISTS (SELECT 1 FROM s WHERE block_no >= start_block AND block_no < start_block + block_count AND stored_size <> 2048) THEN 'enable' ELSE 'disable' END AS policy FROM f
""")
def range_policy(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select("c_custkey", F.lit("image").alias("file"), (F.col("c_custkey") % 700).alias("start_block"), (F.col("c_custkey") % 5).alias("block_count"))
    blocks = block_table(spark, sf_dir).withColumn("stored_size", F.coalesce("stored_size", F.lit(2048)))
    return joins.range_policies(files, blocks, 2048).select("c_custkey", "policy")


@query(f"""
WITH {LAYOUT_SQL} SELECT DISTINCT start_block + k AS block_no FROM l JOIN labels USING (doc_id), unnest(range(block_count)) AS t(k) WHERE toxic = 1
""")
def raw_block_set(spark, sf_dir):
    policies = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "disable").otherwise("enable").alias("policy"))
    return joins.raw_blocks(laid_out(spark, sf_dir), policies, "doc_id")


@query(f"""
WITH {LAYOUT_SQL}, r AS (SELECT DISTINCT start_block + k AS block_no FROM l JOIN labels USING (doc_id), unnest(range(block_count)) AS t(k) WHERE toxic = 1)
SELECT doc_id, start_block FROM l WHERE start_block IN (SELECT block_no FROM r)
""")
def raw_block_members(spark, sf_dir):
    layout = laid_out(spark, sf_dir)
    blocks = layout.select("doc_id", "start_block", F.col("start_block").alias("block_no"))
    return joins.in_raw_blocks(blocks, raw_block_set(spark, sf_dir)).select("doc_id", "start_block")


PROFILES_SQL = """
a AS (SELECT 'doc/' || doc_id AS path, CASE lang WHEN 'en' THEN 'enable' ELSE 'disable' END AS here FROM documents),
b AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'other/' ELSE 'doc/' END || doc_id AS path, CASE quality WHEN 1 THEN 'enable' ELSE 'disable' END AS reference FROM labels),
d AS (SELECT path, here, reference, CASE WHEN here IS NULL THEN 'only-reference' WHEN reference IS NULL THEN 'only-here' WHEN here = reference THEN 'identical' ELSE 'mismatched' END AS status FROM a FULL JOIN b USING (path))
"""


def profiles(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("Image0/DOC/"), "doc_id").alias("path"), F.when(F.col("lang") == "en", "enable").otherwise("disable").alias("policy"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.when(F.col("doc_id") % 10 == 0, "other\\").otherwise("doc\\"), "doc_id", F.lit("/")).alias("path"), F.when(F.col("quality") == 1, "enable").otherwise("disable").alias("policy"))
    return joins.policy_diff(docs, labels)


@query(f"""
WITH {PROFILES_SQL} SELECT count(*) FILTER (status = 'identical')::BIGINT AS identical, count(*) FILTER (status = 'mismatched')::BIGINT AS mismatched,
  count(*) FILTER (status = 'only-here')::BIGINT AS only_here, count(*) FILTER (status = 'only-reference')::BIGINT AS only_reference FROM d
""")
def profile_diff(spark, sf_dir):
    return joins.diff_counts(profiles(spark, sf_dir))


@query(f"WITH {PROFILES_SQL} SELECT path, here, reference FROM d WHERE status = 'mismatched' ORDER BY path LIMIT 20")
def mismatch_top20(spark, sf_dir):
    return ordering.first_n(profiles(spark, sf_dir).where("status = 'mismatched'").select("path", "here", "reference"), 20, "path")


@query("""
WITH a AS (SELECT c_custkey, c_name AS path, c_nationkey FROM customer), u AS (SELECT c_custkey + 100000 AS c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'new/' || c_name ELSE upper(c_name) END AS path, c_nationkey FROM customer WHERE c_custkey % 3 = 0),
e AS (SELECT *, 0 AS layer FROM a UNION ALL SELECT *, 1 FROM u)
SELECT c_custkey, path, c_nationkey, layer FROM e QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY layer DESC) = 1
""")
def overlay_lww(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("path"), "c_nationkey")
    named = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.upper("path"))
    update = base.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100000).alias("c_custkey"), named.alias("path"), "c_nationkey")
    return overlay.overlay_files(base, update).select("c_custkey", "path", "c_nationkey", "layer")


@query("""
WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'sce_sys/' || page_id WHEN 1 THEN 'sce_module/' || page_id WHEN 2 THEN 'eboot.bin' ELSE 'data/' || page_id END AS path, CASE WHEN page_id % 7 = 0 THEN 'enable' WHEN page_id % 7 = 1 THEN '' END AS given FROM pages),
a AS (SELECT path, min(CASE WHEN coalesce(given, '') <> '' THEN given WHEN starts_with(path, 'sce_sys/') OR starts_with(path, 'sce_module/') OR path = 'eboot.bin' THEN 'disable' ELSE 'enable' END) AS attribute FROM f GROUP BY path),
p AS (SELECT 'data/' || page_id AS path, 'disable' AS profiled FROM pages WHERE page_id % 9 = 0)
SELECT path, coalesce(profiled, attribute) AS policy FROM a FULL JOIN p USING (path)
""")
def policy_precedence(spark, sf_dir):
    k, text = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("sce_sys/"), text)).when(k == 1, F.concat(F.lit("sce_module/"), text)).when(k == 2, "eboot.bin").otherwise(F.concat(F.lit("data/"), text))
    given = F.when(F.col("page_id") % 7 == 0, "enable").when(F.col("page_id") % 7 == 1, "")
    pages = table(spark, sf_dir, "pages")
    attributes = pages.select(path.alias("path"), classify.compression_attribute(path, given).alias("policy")).groupBy("path").agg(F.min("policy").alias("policy"))
    profile = pages.where("page_id % 9 = 0").select(F.concat(F.lit("Image0/Data/"), text).alias("path"), F.lit("disable").alias("policy"))
    return overlay.policy_precedence(attributes, profile)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.missing(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
SELECT *, min(cents) OVER (PARTITION BY o_custkey ORDER BY cents RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_value FROM o
""")
def next_offset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return windows.next_greater(orders, "cents", ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return aggregate.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
SELECT user_id, event_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE value < previous
""")
def monotonic(spark, sf_dir):
    return windows.falling(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", ["event_id"], ["user_id"])


CHECKS_SQL = """
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS quantity, l_partkey * 24 AS pos, l_suppkey % 2 = 0 AS enc FROM lineitem),
v AS (SELECT l_orderkey, 1 AS stage, l_partkey * 10 + l_linenumber AS ordinal, 'range' AS reason FROM q WHERE pos + quantity > 45000
  UNION ALL SELECT l_orderkey, 2, l_partkey * 10 + l_linenumber, 'alignment' FROM q WHERE enc AND pos % 16 <> 0)
"""


def line_violations(spark, sf_dir) -> DataFrame:
    from lithospark.operators.rules import entry_violations

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_partkey") * 24).alias("data_offset"),
        F.col("l_quantity").cast("long").alias("data_size"), (F.col("l_suppkey") % 2 == 0).alias("is_encrypted"), F.lit(45000).cast("long").alias("file_size"),
    )
    return entry_violations(lines, stored=F.col("data_size"))


@query(f"WITH {CHECKS_SQL} SELECT l_orderkey, reason, count(*)::BIGINT AS n FROM v GROUP BY ALL")
def bounds_check(spark, sf_dir):
    return line_violations(spark, sf_dir).groupBy(F.col("file").alias("l_orderkey"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {CHECKS_SQL} SELECT l_orderkey, min(stage)::INT AS stage, arg_min(ordinal, stage * 100000000 + ordinal) AS ordinal, arg_min(reason, stage * 100000000 + ordinal) AS reason,
  CASE arg_min(reason, stage * 100000000 + ordinal) WHEN 'range' THEN 'failure' ELSE 'warning' END AS severity FROM v GROUP BY l_orderkey
""")
def fail_fast(spark, sf_dir):
    first = ordering.fail_fast(line_violations(spark, sf_dir).select("file", "stage", "ordinal", "reason"))
    return first.select(F.col("file").alias("l_orderkey"), "stage", "ordinal", "reason", F.when(F.col("reason") == "range", "failure").otherwise("warning").alias("severity"))


# Part types in the place of trophy names.
NAME_SQL = "CASE p_partkey % 9 WHEN 0 THEN 'TROPCONF.SFM' WHEN 1 THEN 'trop.esfm' WHEN 2 THEN 'TROP_' || p_size || '.SFM' WHEN 3 THEN 'icon0.png' WHEN 4 THEN 'ICON0_' || p_size || '.PNG' WHEN 5 THEN 'GR' || p_size || '.PNG' WHEN 6 THEN 'gr' || p_size || '_1.png' WHEN 7 THEN 'TROP' || p_size || '.PNG' ELSE p_type END"


@query(rf"""
WITH n AS (SELECT p_partkey, {NAME_SQL} AS name FROM part), r AS (SELECT *, CASE WHEN regexp_matches(name, '^TROPCONF\.(E?SFM)$', 'i') THEN 0 WHEN regexp_matches(name, '^TROP\.(E?SFM)$', 'i') THEN 1 WHEN regexp_matches(name, '^TROP_\d+\.(E?SFM)$', 'i') THEN 2
 WHEN regexp_matches(name, '^ICON0\.PNG$', 'i') THEN 3 WHEN regexp_matches(name, '^ICON0_\d+\.PNG$', 'i') THEN 4 WHEN regexp_matches(name, '^GR\d+\.PNG$', 'i') THEN 5 WHEN regexp_matches(name, '^GR\d+_\d+\.PNG$', 'i') THEN 6 WHEN regexp_matches(name, '^TROP\d+\.PNG$', 'i') THEN 7 ELSE 8 END AS "rank" FROM n)
SELECT p_partkey, name, "rank"::INT AS "rank", row_number() OVER (PARTITION BY "rank" ORDER BY lower(name), name, p_partkey)::INT AS rn FROM r
""")
def rank_sort(spark, sf_dir):
    k, size = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    names = ["TROPCONF.SFM", "trop.esfm", F.concat(F.lit("TROP_"), size, F.lit(".SFM")), "icon0.png", F.concat(F.lit("ICON0_"), size, F.lit(".PNG")), F.concat(F.lit("GR"), size, F.lit(".PNG")), F.concat(F.lit("gr"), size, F.lit("_1.png")), F.concat(F.lit("TROP"), size, F.lit(".PNG"))]
    name = F.col("p_type")
    for i, n in enumerate(names):
        name = F.when(k == i, n).otherwise(name)
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return ordering.ranked(parts.withColumn("rank", classify.trophy_rank(F.col("name"))), ["rank"], F.lower("name"), "name", "p_partkey")


# Hosts and their address parts as a directory graph; every host has a record that leads to the first host.
GRAPH_SQL = f"""
s AS (SELECT DISTINCT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS raw FROM pages),
q AS (SELECT DISTINCT list_filter(raw, lambda x: x <> '') AS parts FROM s),
n AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS path, parts[k] AS name, CASE WHEN k = 1 THEN '' ELSE array_to_string(parts[1:k-1], '/') END AS up FROM q, unnest(range(1, len(parts) + 1)) AS t(k)),
d AS (SELECT path, name, up, CASE WHEN path IN (SELECT up FROM n) THEN 3 ELSE 2 END AS type, {HASH31_SQL.format("path")} AS inode, CASE WHEN up = '' THEN 0 ELSE {HASH31_SQL.format("up")} END AS parent FROM n),
h AS (SELECT min(path) AS path FROM d WHERE up = '' AND type = 3),
e AS (SELECT parent, inode AS ordinal, inode, type, name FROM d UNION ALL
  SELECT d.inode, 0, {HASH31_SQL.format("h.path")}, 3, '~peer' FROM d, h WHERE d.up = '' AND d.type = 3)
"""
WALK_SQL = """
w(inode, type, path, depth, trail, passed) AS (
  SELECT inode, type, name, 1, [ordinal], CASE WHEN type = 3 THEN [inode] ELSE [] END FROM e WHERE parent = 0
  UNION ALL SELECT e.inode, e.type, w.path || '/' || e.name, w.depth + 1, list_append(w.trail, e.ordinal), CASE WHEN e.type = 3 THEN list_append(w.passed, e.inode) ELSE w.passed END
  FROM w JOIN e ON e.parent = w.inode WHERE w.type = 3 AND (e.type <> 3 OR NOT list_contains(w.passed, e.inode)))
"""


def url_graph(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    parts = table(spark, sf_dir, "pages").select(paths.segments(bare).alias("parts")).distinct()
    up = F.when(F.col("k") == 1, "").otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("k") - 1), "/"))
    nodes = parts.where(F.size("parts") > 0).select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    nodes = nodes.select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("path"), F.element_at("parts", F.col("k")).alias("name"), up.alias("up")).distinct()
    inner = nodes.select(F.col("up").alias("path"), F.lit(3).alias("_t")).distinct()
    number = lambda c: hashes.hash31(F.col(c))
    nodes = nodes.join(inner, "path", "left").select("path", "name", "up", F.coalesce("_t", F.lit(2)).alias("type"), number("path").alias("inode"), F.when(F.col("up") == "", F.lit(0).cast("long")).otherwise(number("up")).alias("parent"))
    hosts = nodes.where("up = '' and type = 3")
    first = F.broadcast(hosts.agg(F.min("path").alias("first")))  # one row
    peers = hosts.join(first).select(F.col("inode").alias("parent"), F.lit(0).cast("long").alias("ordinal"), number("first").alias("inode"), F.lit(3).alias("type"), F.lit("~peer").alias("name"))
    return nodes.select("parent", F.col("inode").alias("ordinal"), "inode", "type", "name").unionByName(peers).withColumn("file", F.lit("pages"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {WALK_SQL} SELECT inode, type::INT AS type, path, depth::INT AS depth FROM w")
def tree_walk(spark, sf_dir):
    return trees.tree_walk(url_graph(spark, sf_dir)).select("inode", "type", "path", "depth")


@query(f"""
WITH RECURSIVE {GRAPH_SQL}, {WALK_SQL}, f AS (SELECT inode, arg_min(path, trail) AS path FROM w WHERE type = 3 GROUP BY inode)
SELECT inode, 3::INT AS type, path FROM f UNION ALL SELECT e.inode, 2, f.path || '/' || e.name FROM f JOIN e ON e.parent = f.inode WHERE e.type = 2 UNION ALL SELECT inode, 2, name FROM e WHERE parent = 0 AND type = 2
""")
def tree_walk_global(spark, sf_dir):
    return trees.tree_walk_global(url_graph(spark, sf_dir)).select("inode", "type", "path")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS digest FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS expected FROM documents)
SELECT doc_id, digest, CASE WHEN digest = expected THEN 'OK' ELSE 'FAIL' END AS status FROM a JOIN b USING (doc_id)
""")
def digest_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("docs").alias("file"), F.col("doc_id").alias("ordinal"), hashes.sha256(F.col("text").cast("binary")).alias("digest"))
    slots = docs.select("file", "ordinal", F.when(F.col("ordinal") % 13 == 0, F.upper("digest")).otherwise(F.col("digest")).alias("expected"))
    return joins.by_position(docs, slots).select(F.col("ordinal").alias("doc_id"), "digest", F.when(F.col("digest") == F.col("expected"), "OK").otherwise("FAIL").alias("status"))


@query("SELECT conv_id, sha256(string_agg(hex(encode(text)), '' ORDER BY turn)) AS hex_digest FROM conversations GROUP BY conv_id")
def digest_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    return aggregate.chained_digest(rows, ["conv_id"], "turn", "data").select("conv_id", "hex_digest")


@query("""
WITH c AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT) AS d FROM part)
SELECT p_partkey, ((len(d) + list_sum(list_transform(d, lambda x, i: (len(d) - i + 1) * x)))::BIGINT % 65521) * 65536 + (1 + list_sum(d))::BIGINT % 65521 AS checksum FROM c
""")
def adler32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashes.adler32()(F.col("p_name").cast("binary")).alias("checksum"))


@query("""
WITH c AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT) AS d FROM part)
SELECT p_partkey, ((len(d) + list_sum(list_transform(d, lambda x, i: (len(d) - i + 1) * x)))::BIGINT % 65521) * 65536 + (1 + list_sum(d))::BIGINT % 65521 AS checksum FROM c
""")
def adler32_closed_form(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashes.adler32_text(F.col("p_name")).alias("checksum"))


@query("""
SELECT doc_id, k::INT AS block_no, least(4096, octet_length(encode(text)) - 4096 * k)::BIGINT AS bytes, true AS same, true AS shorter FROM documents, unnest(range((octet_length(encode(text)) + 4095) // 4096)) AS t(k)
""")
def block_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    stored = blk.store_blocks(blk.split_blocks(docs, "content", 4096))
    back = blk.inflate()(F.col("stored"), F.octet_length("data"))
    shorter = F.when(F.col("is_raw"), F.col("stored") == F.col("data")).otherwise(F.octet_length("stored") < F.octet_length("data"))
    return stored.select("doc_id", "block_no", F.octet_length("data").cast("long").alias("bytes"), (back == F.col("data")).alias("same"), shorter.alias("shorter"))


@query("SELECT r_regionkey, field, value FROM (UNPIVOT (SELECT r_regionkey, r_regionkey::VARCHAR AS r_key, r_name FROM region) ON r_key, r_name INTO NAME field VALUE value)")
def field_dump(spark, sf_dir):
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_regionkey").cast("string").alias("r_key"), "r_name")
    return classify.field_rows(region, "r_regionkey", ["r_key", "r_name"])


@query("""
WITH l AS (SELECT n_nationkey, 'name' AS field, n_name AS left_value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation),
r AS (SELECT n_nationkey, 'name' AS field, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS right_value FROM nation WHERE n_nationkey > 2 UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation)
SELECT n_nationkey, field, left_value, right_value, CASE WHEN left_value IS NOT DISTINCT FROM right_value THEN 'SAME' ELSE 'DIFF' END AS status FROM l FULL JOIN r USING (n_nationkey, field)
""")
def field_diff(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    left = classify.field_rows(nation.select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "n_nationkey", ["name", "region"])
    changed = F.when(F.col("n_nationkey") % 4 == 0, F.lower("value")).otherwise(F.col("value"))
    right = left.where("n_nationkey > 2 or field = 'region'").select("n_nationkey", "field", F.when(F.col("field") == "name", changed).otherwise(F.col("value")).alias("value"))
    return classify.field_diff(left, right, ["n_nationkey", "field"])


# A profile document for each part: keys of either case, a version that is not read on some.
@query("""
SELECT p_partkey::VARCHAR AS file, unnest(['Image0/' || p_name, 'size/' || p_size]) AS path, unnest([CASE WHEN p_size % 2 = 0 THEN 'enable' ELSE 'disable' END, 'none']) AS policy FROM part WHERE p_partkey % 5 <> 0
""")
def json_profile(spark, sf_dir):
    k = F.col("p_partkey")
    policy = F.when(F.col("p_size") % 2 == 0, "Enable").otherwise("DISABLE")
    body = F.concat(F.lit('{"Image0/'), "p_name", F.lit('": "'), policy, F.lit('", "size/'), F.col("p_size").cast("string"), F.lit('": "none"}}'))
    head = F.concat(F.when(k % 2 == 0, F.lit('{"Version": ')).otherwise(F.lit('{"version" : ')), F.when(k % 5 == 0, "2").otherwise("1"), F.when(k % 3 == 0, F.lit(', "files": ')).otherwise(F.lit(', "Files" :')))
    return documents.profile_policies(table(spark, sf_dir, "part").select(k.cast("string").alias("file"), F.concat(head, body).alias("json")))


# A project document for each page, with values as children or attributes, and two files.
@query("""
SELECT page_id::VARCHAR AS file, CASE page_id % 3 WHEN 0 THEN 'pkg_ps4_app' ELSE 'pkg_ps4_patch' END AS volume_type, 'ID' || page_id AS content_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS title,
  unnest([0, 1])::INT AS ordinal, unnest(['data/' || page_id, 'sce_sys/p.bin']) AS path, unnest([url, 'sce_sys/p.bin']) AS origin, unnest(['enable', '']) AS compression FROM pages
""")
def xml_pages(spark, sf_dir):
    number, url = F.col("page_id").cast("string"), F.col("url")
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        url = F.replace(url, F.lit(raw), F.lit(escaped))
    kind = F.when(F.col("page_id") % 3 == 0, "pkg_ps4_app").otherwise("pkg_ps4_patch")
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<title>"), url, F.lit("</title>"))).otherwise("")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><psproject><volume><volume_type>'), kind, F.lit('</volume_type><package content_id="ID'), number, F.lit('">'), own, F.lit('</package></volume><files><file targ_path="data/'), number,
        F.lit('" orig_path="'), url, F.lit('" pfs_compression="enable"/><file orig_path=""><entry path="sce_sys/p.bin"/></file></files></psproject>'),
    )
    parsed = documents.projects(table(spark, sf_dir, "pages").select(number.alias("file"), xml.alias("xml")))
    return documents.project_files(parsed).join(parsed.select("file", "project.volume_type", "project.content_id", "project.title"), "file")


@query("""
SELECT count(*)::BIGINT AS files, count(DISTINCT nullif(regexp_extract(url, '^(.*)/[^/]*$', 1), ''))::BIGINT AS directories FROM pages
""")
def dir_rollup(spark, sf_dir):
    return aggregate.directory_totals(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query("""
WITH i AS (SELECT coalesce(sum((n_chars + 65535) // 65536 * 65536), 0)::BIGINT AS inner_bytes FROM documents), c AS (SELECT inner_bytes, least(inner_bytes, 5500000)::BIGINT AS compressed_bytes FROM i)
SELECT inner_bytes, compressed_bytes, ((inner_bytes + 2 * compressed_bytes) * 115 // 100 + 268435456)::BIGINT AS temporary_bytes, (compressed_bytes + inner_bytes // 4 + 268435456)::BIGINT AS output_bytes FROM c
""")
def space_estimate(spark, sf_dir):
    return aggregate.space_estimate(table(spark, sf_dir, "documents"), "n_chars", expected=5_000_000)


@query(f"""
WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'sce_sys/icon0.dds' WHEN 1 THEN 'SCE_SYS/About/right.sprx' WHEN 2 THEN 'sce_discmap' || page_id || '.plt' WHEN 3 THEN 'sce_sys\\param.sfo' WHEN 4 THEN 'sce_sys\\License.dat' ELSE url END AS path FROM pages)
SELECT page_id, path, lower(replace(path, chr(92), '/')) IN ({", ".join(f"'{m}'" for m in MANAGED_FILES)}) OR starts_with(lower(replace(path, chr(92), '/')), 'sce_sys/about/')
  OR (starts_with(lower(path), 'sce_discmap') AND ends_with(lower(path), '.plt')) AS managed FROM f
""".replace("\\\\", "\\"))
def managed_files(spark, sf_dir):
    k = F.col("page_id") % 6
    path = F.when(k == 0, "sce_sys/icon0.dds").when(k == 1, "SCE_SYS/About/right.sprx").when(k == 2, F.concat(F.lit("sce_discmap"), "page_id", F.lit(".plt"))).when(k == 3, "sce_sys\\param.sfo").when(k == 4, "sce_sys\\License.dat").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), classify.is_managed_file(path).alias("managed"))


KNOWN_SQL = " ".join(f"WHEN '{name}' THEN {number}" for number, name in ENTRY_NAMES.items())


@query(f"""
WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'param.sfo' WHEN 1 THEN 'changeinfo/changeinfo_' || lpad((p_size)::VARCHAR, 2, '0') || '.xml' WHEN 2 THEN 'entry_' || printf('%04X', p_partkey % 60000) || '.bin' WHEN 3 THEN 'icon0.png' ELSE p_name END AS name FROM part),
g AS (SELECT *, try_cast(nullif(regexp_extract(name, '^changeinfo/changeinfo_(\\d+)\\.xml$', 1), '') AS BIGINT) AS n, regexp_extract(name, '^entry_([0-9A-Fa-f]{{4}})\\.bin$', 1) AS hx FROM f)
SELECT p_partkey, name, (CASE name {KNOWN_SQL} ELSE CASE WHEN n BETWEEN 1 AND 30 THEN 4704 + n + 1 WHEN hx <> '' THEN ('0x' || hx)::BIGINT ELSE 0 END END)::BIGINT AS entry_id FROM g
""")
def entry_ids(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, "param.sfo")
        .when(k == 1, F.concat(F.lit("changeinfo/changeinfo_"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".xml")))
        .when(k == 2, F.format_string("entry_%04X.bin", F.col("p_partkey") % 60000))
        .when(k == 3, "icon0.png")
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), classify.entry_id_of(name).alias("entry_id"))


@query(rf"""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '../x' WHEN 1 THEN 'a/../../b' WHEN 2 THEN 'C:' || chr(92) || 'x' WHEN 3 THEN 'a/b/../../c' WHEN 4 THEN '/etc' ELSE 'data/' || page_id END AS path FROM pages)
SELECT page_id, page_id % 6 IN (0, 1, 2, 4) AS traversal FROM p
""")
def path_traversal(spark, sf_dir):
    k = F.col("page_id") % 6
    path = F.when(k == 0, "../x").when(k == 1, "a/../../b").when(k == 2, "C:\\x").when(k == 3, "a/b/../../c").when(k == 4, "/etc").otherwise(F.concat(F.lit("data/"), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", paths.is_traversal(path).alias("traversal"))


@query("""
SELECT conv_id, turn, coalesce(sum(strlen(role) + 1) OVER w, 0)::BIGINT AS key_offset, coalesce(sum(strlen(text)) OVER w, 0)::BIGINT AS data_offset
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY role || lpad(turn::VARCHAR, 6, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""".replace("strlen(role) + 1", "strlen(role) + 7"))
def sfo_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("key"), F.octet_length("text").alias("max_length"))
    return windows.sfo_offsets(rows, "conv_id").select("conv_id", "turn", "key_offset", "data_offset")


@query("""
SELECT o_orderkey, (o_orderkey // 390 + 1) * 65536 + (o_orderkey % 390) * 168 AS inode_at, (strlen(o_orderpriority) + 17 + 7) // 8 * 8 AS record_size, printf('%08X', o_orderkey) AS hex, printf('0x%08X', o_custkey) AS version FROM orders
""")
def layout_arithmetic(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", windows.inode_position(F.col("o_orderkey"), 168).alias("inode_at"), scalars.dirent_size(F.octet_length("o_orderpriority").cast("long")).alias("record_size"),
        scalars.hex8(F.col("o_orderkey")).alias("hex"), scalars.version_text(F.col("o_custkey")).alias("version"),
    )


@query("""
SELECT o_orderkey, regexp_replace(o_orderpriority, '[<>:"/\\\\|?*]', '_', 'g')[1:40] AS safe, translate(o_orderpriority || chr(9) || o_orderstatus || chr(10), chr(9) || chr(13) || chr(10), '   ') AS clean,
  strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS long_form, CASE WHEN o_custkey % 3 = 0 THEN 100.0::DOUBLE * (o_orderkey % 100) / 100 WHEN o_custkey % 3 = 1 THEN 100.0::DOUBLE * (o_custkey % 50) / 50 END AS progress FROM orders
""".replace("\\\\\\\\", "\\\\"))
def text_functions(spark, sf_dir):
    orders, k = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    noisy = F.concat("o_orderpriority", F.lit("\t"), "o_orderstatus", F.lit("\n"))
    part = scalars.progress(F.col("o_orderkey") % 100, F.when(k == 0, 100).otherwise(0), F.col("o_custkey") % 50, F.when(k == 1, 50).otherwise(0))
    return orders.select(
        "o_orderkey", scalars.safe_filename(F.col("o_orderpriority")).alias("safe"), scalars.scrub(noisy).alias("clean"), scalars.compact_date(F.col("o_orderdate")).alias("compact"),
        scalars.long_date(F.col("o_orderdate")).alias("long_form"), part.alias("progress"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
