"""Queries that apply joins, orders, layouts, overlays and scalar rules to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithospark.constants import ENTRY_NAMES
from lithospark.functions import hashes, scalars
from lithospark.operators import aggregate, classify, joins, ordering, overlay, trees, windows
from lithospark.plans.registry import query, table

KNOWN_SQL = " ".join(f"WHEN {number} THEN '{name}'" for number, name in ENTRY_NAMES.items())


def text(name: str):
    return F.col(name).cast("string")


# Names by offset in the file's table, else by id.
@query(f"""
WITH e AS (SELECT o_orderkey, o_custkey % 50 AS file, o_orderkey % 60 AS name_offset, CASE o_orderkey % 3 WHEN 0 THEN 4096 WHEN 1 THEN 4608 ELSE o_custkey END AS id FROM orders),
n AS (SELECT s_suppkey % 50 AS file, s_suppkey % 60 AS name_offset, min(CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE '' END) AS name FROM supplier GROUP BY 1, 2)
SELECT o_orderkey, id, coalesce(nullif(name, ''), CASE id {KNOWN_SQL} END) AS name FROM e LEFT JOIN n USING (file, name_offset)
""")
def entry_join(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("file"), (k % 60).alias("name_offset"), F.when(k % 3 == 0, F.lit(4096)).when(k % 3 == 1, F.lit(4608)).otherwise(F.col("o_custkey")).alias("id"))
    names = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("file"), (F.col("s_suppkey") % 60).alias("offset"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).otherwise("").alias("name"))
    return joins.named_entries(entries, names.groupBy("file", "offset").agg(F.min("name").alias("name"))).select("o_orderkey", "id", "name")


# Policies by normalised path, and how many files have each.
RULED_SQL = "r AS (SELECT 'c/' || c_custkey AS path, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'disable' ELSE 'enable' END AS policy FROM customer WHERE c_nationkey < 15), f AS (SELECT o_orderkey, 'c/' || o_custkey AS path FROM orders)"


def ruled(spark, sf_dir):
    k = F.col("c_custkey") % 4
    profile = table(spark, sf_dir, "customer").where("c_nationkey < 15").select(F.concat(F.lit("Image0/C/"), text("c_custkey"), F.lit("/")).alias("path"), F.when(k == 0, "none").when(k == 1, "disable").otherwise("enable").alias("policy"))
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c\\"), text("o_custkey")).alias("path"))
    return joins.with_policy(files, profile)


@query(f"WITH {RULED_SQL} SELECT o_orderkey, policy FROM f LEFT JOIN r USING (path)")
def policy_lookup(spark, sf_dir):
    return ruled(spark, sf_dir).select("o_orderkey", "policy")


@query(f"WITH {RULED_SQL} SELECT count(*) FILTER (policy = 'enable')::BIGINT AS enable, count(*) FILTER (policy = 'disable')::BIGINT AS disable, count(*) FILTER (policy = 'none')::BIGINT AS \"none\" FROM f LEFT JOIN r USING (path)")
def policy_totals(spark, sf_dir):
    return aggregate.policy_counts(ruled(spark, sf_dir))


# Whether any order of a customer is open.
@query("SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_open FROM orders GROUP BY o_custkey")
def any_match(spark, sf_dir):
    return aggregate.any_by(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O", "any_open")


# Records that name something, with the size that each style shows.
@query("""
WITH d AS (SELECT l_orderkey AS file, l_partkey AS inode, l_linenumber % 6 AS type, CASE WHEN l_suppkey % 9 = 0 THEN 'flat_path_table' ELSE 'n' || l_suppkey END AS name FROM lineitem),
i AS (SELECT l_orderkey AS file, l_partkey AS inode, sum(l_quantity)::BIGINT AS stored, max(l_linenumber % 4 * 10)::BIGINT AS whole FROM lineitem GROUP BY ALL)
SELECT file, inode, name, CASE WHEN whole > 0 AND whole <> stored THEN whole ELSE stored END AS size, stored AS packed_size FROM d JOIN i USING (file, inode) WHERE type NOT IN (4, 5) AND name <> 'flat_path_table' AND inode >= 0 AND inode < 1500
""")
def live_records(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    dirents = lines.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("inode"), (F.col("l_linenumber") % 6).alias("type"), F.when(F.col("l_suppkey") % 9 == 0, "flat_path_table").otherwise(F.concat(F.lit("n"), text("l_suppkey"))).alias("name"))
    inodes = lines.groupBy(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("inode")).agg(F.sum("l_quantity").cast("long").alias("stored"), F.max(F.col("l_linenumber") % 4 * 10).cast("long").alias("whole"))
    size, packed = classify.file_sizes(F.col("stored"), F.col("whole"))
    found = joins.dirent_inodes(classify.live_dirents(dirents, F.lit(1500)), inodes)
    return found.select("file", "inode", "name", classify.shown_size(size, packed, "size").alias("size"), classify.shown_size(size, packed, "packed_size").alias("packed_size"))


# Part names looked up by hash in a table of slots.
@query("""
WITH h AS (SELECT p_partkey, (p_partkey * 7919) % 64 AS hash, p_partkey % 1000 + (1 << 28) AS slot FROM part), f AS (SELECT hash, arg_min(slot, p_partkey) AS slot FROM h WHERE p_partkey % 3 = 0 GROUP BY hash)
SELECT h.p_partkey, h.hash, f.slot, f.slot & 268435455 AS inode FROM h LEFT JOIN f USING (hash)
""")
def hash_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7919) % 64).alias("key"), (F.col("p_partkey") % 1000 + F.lit(1 << 28)).alias("slot"))
    slots = part.where("p_partkey % 3 = 0").select(F.col("key").alias("hash"), "slot", F.col("p_partkey").alias("ordinal"))
    return joins.hash_probe(part.drop("slot"), slots, "p_partkey", hashed=F.col("key")).select("p_partkey", "hash", "slot", "inode")


# Nations without a customer in or below them, as directories.
@query("""
WITH d AS (SELECT 'R' || n_regionkey || '/N' || n_nationkey AS path FROM nation UNION SELECT 'R' || n_regionkey FROM nation UNION SELECT 'r9/empty'), f AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey AS dir, 'r' || n_regionkey AS top FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 3 = 0)
SELECT path FROM d WHERE lower(path) NOT IN (SELECT dir FROM f UNION SELECT top FROM f)
""")
def empty_folders(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    top, low = F.concat(F.lit("R"), text("n_regionkey")), F.concat(F.lit("R"), text("n_regionkey"), F.lit("/N"), text("n_nationkey"))
    extra = spark.createDataFrame([("r9/empty",)], "path string")
    directories = nation.select(low.alias("path")).unionByName(nation.select(top.alias("path"))).unionByName(extra).distinct()
    files = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower(low), F.lit("/"), "c_name").alias("path"))
    return overlay.empty_directories(directories, files)


# Where two records of equal place differ, word by word.
WORDS_SQL = """
l AS (SELECT p_brand AS file, p_partkey AS ordinal, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN p_name || 'x' WHEN 1 THEN upper(p_name) ELSE p_name END AS b FROM part),
w AS (SELECT file, ordinal, k * 8 AS pos FROM l, unnest(range((greatest(strlen(a), strlen(b)) + 7) // 8)) AS t(k) WHERE substr(a, k * 8 + 1, 8) <> substr(b, k * 8 + 1, 8))
"""


def words(spark, sf_dir):
    part, k = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ordinal"), "p_name"), F.col("ordinal") % 3
    changed = F.when(k == 0, F.concat("p_name", F.lit("x"))).when(k == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    side = lambda c: part.select("file", "ordinal", F.encode(c, "utf-8").alias("raw"))
    return joins.differing_words(side(F.col("p_name")), side(changed))


@query(f"WITH {WORDS_SQL} SELECT file, ordinal, pos::INT AS \"offset\" FROM w")
def word_diff(spark, sf_dir):
    return words(spark, sf_dir)


@query(f"WITH {WORDS_SQL} SELECT file, min(ordinal * 1000 + pos) AS first_offset FROM w GROUP BY file")
def first_difference(spark, sf_dir):
    return aggregate.first_divergence(words(spark, sf_dir).withColumn("offset", F.col("ordinal") * 1000 + F.col("offset")))


# Owners of blocks on two sides.
@query("""
WITH a AS (SELECT c_custkey AS block_no, c_name AS left_owner FROM customer WHERE c_nationkey < 20), b AS (SELECT o_custkey AS block_no, max(o_orderpriority) AS right_owner FROM orders GROUP BY o_custkey)
SELECT block_no, left_owner, right_owner FROM a FULL JOIN b USING (block_no)
""")
def block_owners(spark, sf_dir):
    left = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("block_no"), F.col("c_name").alias("owner"))
    return joins.block_use(left, table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("block_no")).agg(F.max("o_orderpriority").alias("owner")))


# Totals of a listing, and digests of regions made of pieces.
@query("SELECT count(*)::BIGINT AS entries, count(*) FILTER (p_size % 7 = 0)::BIGINT AS directories, count(*) FILTER (p_size % 7 <> 0)::BIGINT AS files, coalesce(sum(p_size), 0)::BIGINT AS bytes FROM part")
def listing_sums(spark, sf_dir):
    return aggregate.listing_totals(table(spark, sf_dir, "part").select((F.col("p_size") % 7 == 0).alias("is_directory"), F.col("p_size").alias("size")))


@query("SELECT p_brand AS key, sha256(string_agg(p_name, '' ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand")
def region_digests(spark, sf_dir):
    return aggregate.region_digest(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("offset"), F.encode("p_name", "utf-8").alias("data")))


# Entries laid out at multiples of 16; pinned ones keep their place and take no room.
@query("""
WITH e AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_partkey * 1000000 END AS pinned, (p_size + 15) // 16 * 16 AS room FROM part)
SELECT p_brand, p_partkey, coalesce(pinned, 4096 + coalesce(sum(CASE WHEN pinned IS NULL THEN room ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM e
""")
def pinned_offsets(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("size"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") * 1000000).alias("pinned"))
    return windows.aligned_offsets(part, "size", ["p_partkey"], ["p_brand"], base=4096, pinned="pinned").select("p_brand", "p_partkey", "offset")


# A conversation's messages as records that cross no block's end; here each fits, so they follow each other by blocks of 64 bytes.
@query("""
WITH RECURSIVE m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (strlen(role) + 24) // 8 * 8 AS size FROM conversations),
p AS (SELECT conv_id, turn, k, 0::BIGINT AS pos, size AS stop FROM m WHERE k = 1
  UNION ALL SELECT m.conv_id, m.turn, m.k, CASE WHEN m.size > 64 - stop % 64 THEN stop + 64 - stop % 64 ELSE stop END, CASE WHEN m.size > 64 - stop % 64 THEN stop + 64 - stop % 64 ELSE stop END + m.size FROM p JOIN m ON m.conv_id = p.conv_id AND m.k = p.k + 1)
SELECT conv_id, turn, pos AS "offset" FROM p
""")
def record_offsets(spark, sf_dir):
    names = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"))
    placed = names.select("conv_id", "m", windows.packed_dirents(F.col("m.role"), 64).alias("pos"))
    return placed.select("conv_id", F.explode(F.arrays_zip(F.col("m.turn").alias("turn"), F.col("pos").alias("offset"))).alias("x")).select("conv_id", "x.turn", "x.offset")


# Nodes numbered, directories first.
@query("""
SELECT p_partkey, (row_number() OVER (ORDER BY p_size % 4 <> 0, string_split('d' || p_size || '/' || p_name || '/' || p_partkey, '/')) + 2)::BIGINT AS ordinal FROM part
""")
def node_ordinals(spark, sf_dir):
    path = F.concat(F.lit("d"), text("p_size"), F.lit("/"), "p_name", F.lit("/"), text("p_partkey"))
    return windows.ordinals(table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), (F.col("p_size") % 4 == 0).alias("is_directory")), start=3).select("p_partkey", "ordinal")


# The orders of listings, with each row's place.
@query(r"""
WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'TROP_' || p_size || '.SFM' WHEN 1 THEN upper(p_name) ELSE p_name END || p_partkey AS path, (p_partkey * 7919) % 1000 AS h FROM part)
SELECT k, row_number() OVER (ORDER BY lower(path), path)::BIGINT AS by_path, row_number() OVER (ORDER BY h, k)::BIGINT AS by_hash, row_number() OVER (ORDER BY length(path), k)::BIGINT AS by_length,
  row_number() OVER (ORDER BY CASE WHEN regexp_matches(path, '^TROP_\d+\.(E?SFM)$', 'i') THEN 2 ELSE 8 END, lower(path), path)::BIGINT AS by_class, row_number() OVER (ORDER BY k % 100, k)::BIGINT AS by_id FROM n
""")
def listing_orders(spark, sf_dir):
    k = F.col("p_partkey") % 5
    path = F.concat(F.when(k == 0, F.concat(F.lit("TROP_"), text("p_size"), F.lit(".SFM"))).when(k == 1, F.upper("p_name")).otherwise(F.col("p_name")), text("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), path.alias("path"), ((F.col("p_partkey") * 7919) % 1000).alias("hash"), F.col("p_partkey").alias("inode"), F.col("p_partkey").alias("ordinal"), (F.col("p_partkey") % 100).alias("id"))
    # A global sort makes partitions follow each other; a row's place is what lies before it.
    out = rows.select("k")
    for name, sorted_ in (("by_path", ordering.by_path(rows)), ("by_hash", ordering.by_hash(rows)), ("by_length", ordering.by_path_length(rows)), ("by_class", ordering.by_trophy_class(rows, "path")), ("by_id", ordering.by_id(rows))):
        placed = windows.running_before(sorted_.select("k", F.monotonically_increasing_id().alias("_at"), F.lit(1).alias("_one")), "_one", ["_at"], "_n")
        out = out.join(placed.select("k", (F.col("_n") + 1).alias(name)), "k")
    return out


# The first match.
@query("SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey")
def first_of_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("first_part"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"))
    return ordering.first_match(lines, ["l_orderkey"], "place", "first_part")


# Two layers as one listing.
@query("SELECT c_name AS path, c_custkey AS size, c_nationkey::BIGINT AS entry_id FROM customer UNION ALL SELECT p_name, p_size::BIGINT, NULL FROM part")
def layer_union(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey").alias("size"), F.col("c_nationkey").cast("long").alias("entry_id"))
    return overlay.union_listing(entries, table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("size")))


# The update's policies over the base's.
@query("""
WITH a AS (SELECT 'd/' || doc_id AS path, CASE lang WHEN 'en' THEN 'enable' ELSE 'disable' END AS policy FROM documents), b AS (SELECT 'd/' || doc_id AS path, CASE quality WHEN 1 THEN 'none' ELSE 'enable' END AS policy FROM labels)
SELECT path, coalesce(b.policy, a.policy) AS policy FROM a FULL JOIN b USING (path)
""")
def profile_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select(F.concat(F.lit("Image0/D/"), text("doc_id")).alias("path"), F.when(F.col("lang") == "en", "enable").otherwise("disable").alias("policy"))
    return overlay.overlay_profiles(base, table(spark, sf_dir, "labels").select(F.concat(F.lit("d\\"), text("doc_id")).alias("path"), F.when(F.col("quality") == 1, "none").otherwise("enable").alias("policy")))


# Edited values replace all of the same key.
@query("""
WITH v AS (SELECT conv_id AS file, role AS key, turn AS number FROM conversations), e AS (SELECT DISTINCT conv_id AS file, 'User' AS key, -1::BIGINT AS number FROM conversations WHERE conv_id % 2 = 0)
SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file = v.file AND lower(e.key) = lower(v.key)) UNION ALL SELECT * FROM e
""")
def value_upsert(spark, sf_dir):
    values = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("key"), F.col("turn").alias("number"))
    return overlay.sfo_upsert(values, values.where("file % 2 = 0").select("file", F.lit("User").alias("key"), F.lit(-1).cast("long").alias("number")).distinct())


# Given payloads in the place of those of the same id, others added.
@query("""
SELECT coalesce(c_custkey, o.id) AS id, CASE WHEN o.id IS NOT NULL THEN 'given' ELSE c_name END AS name, CASE WHEN o.id IS NOT NULL THEN n ELSE c_nationkey END AS data
FROM customer FULL JOIN (SELECT o_custkey * 2 AS id, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.id = c_custkey
""")
def placeholders(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("data"))
    given = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("id")).agg(F.count(F.lit(1)).alias("data")).withColumn("name", F.lit("given"))
    return overlay.replace_placeholders(entries, given)


# A node by its path, and the order of a tree's listing.
TREE_SQL = "t AS (SELECT 'R' || r_regionkey AS path, 3 AS type FROM region UNION ALL SELECT 'R' || n_regionkey || '/' || n_name, 2 FROM nation)"


def tree(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), text("r_regionkey")).alias("path"), F.lit(3).alias("type"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), text("n_regionkey"), F.lit("/"), "n_name").alias("path"), F.lit(2).alias("type"))
    return region.unionByName(nation).select(F.lit("world").alias("file"), "path", "type", F.xxhash64("path").alias("inode"))


@query(f"WITH {TREE_SQL} SELECT path, type::INT AS type FROM t WHERE lower(path) = (SELECT lower('r' || n_regionkey || '/' || n_name) FROM nation WHERE n_nationkey = 7)")
def path_resolved(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").where("n_nationkey = 7").select("n_regionkey", "n_name").first()
    return trees.resolve_path(tree(spark, sf_dir), f"/r{wanted.n_regionkey}/{wanted.n_name.lower()}/").select("path", "type")


@query(f"WITH {TREE_SQL} SELECT path, row_number() OVER (ORDER BY path)::BIGINT AS place FROM t")
def tree_order(spark, sf_dir):
    rows = trees.preorder(tree(spark, sf_dir)).select("path", F.monotonically_increasing_id().alias("_at"), F.lit(1).alias("_one"))
    return windows.running_before(rows, "_one", ["_at"], "_n").select("path", (F.col("_n") + 1).alias("place"))


# One tree moved below a folder of the other.
@query("""
WITH t AS (SELECT 'a/' || c_name AS path, c_custkey FROM customer), s AS (SELECT 'A/' || c_name AS path, c_custkey + 1000000 AS c_custkey FROM customer WHERE c_custkey % 4 = 0)
SELECT path, c_custkey FROM t WHERE lower(path) NOT IN (SELECT lower(path) FROM s) UNION ALL SELECT * FROM s
""")
def tree_move(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    base = customer.select(F.concat(F.lit("a/"), "c_name").alias("path"), "c_custkey")
    return overlay.moved_tree(base, customer.where("c_custkey % 4 = 0").select(F.col("c_name").alias("path"), (F.col("c_custkey") + 1000000).alias("c_custkey")), "A/").select("path", "c_custkey")


# Probes, digests, volume types and edited kinds.
VOLUMES = ["pkg_ps4_app", "pkg_ps4_patch", "pkg_ps4_remaster", "pkg_ps4_ac_data", "pkg_ps4_ac_nodata", "pkg_ps4_sf_theme", "pkg_ps4_theme", "else"]


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PFSC' ELSE '' END || p_name AS body, CASE WHEN p_partkey % 4 = 0 THEN '000000' ELSE p_partkey::VARCHAR END AS digits, p_partkey % 8 AS k, CASE p_partkey % 3 WHEN 0 THEN '0x1F' WHEN 1 THEN '12' ELSE 'text' END AS edit FROM part)
SELECT p_partkey, starts_with(body, 'PFSC') AS container, regexp_matches(digits, '^0+$') AS zero, sha1(body) AS digest, ['App', 'Patch', 'Remaster', 'AddonData', 'AddonNoData', 'SystemTheme', 'Theme', 'Theme'][k + 1] AS volume,
  ['pkg_ps4_app', 'pkg_ps4_patch', 'pkg_ps4_remaster', 'pkg_ps4_ac_data', 'pkg_ps4_ac_nodata', 'pkg_ps4_sf_theme', 'pkg_ps4_theme', 'pkg_ps4_theme'][k + 1] AS volume_back,
  CASE WHEN p_partkey % 2 = 0 AND edit <> 'text' THEN 'int32' ELSE 'utf8' END AS kind, CASE edit WHEN '0x1F' THEN 31 WHEN '12' THEN 12 END::BIGINT AS number FROM p
""")
def probes(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.concat(F.when(k % 3 == 0, "PFSC").otherwise(""), "p_name")
    digits = F.when(k % 4 == 0, "000000").otherwise(text("p_partkey"))
    edit = F.when(k % 3 == 0, "0x1F").when(k % 3 == 1, "12").otherwise("text")
    volume = scalars.volume_type(F.element_at(F.array(*map(F.lit, VOLUMES)), (k % 8 + 1).cast("int")))
    zero = hashes.is_all_zero(F.unhex(F.concat(F.when(F.length(digits) % 2 == 1, "0").otherwise(""), digits)))
    return table(spark, sf_dir, "part").select(
        "p_partkey", hashes.is_pfsc(F.encode(body, "utf-8")).alias("container"), zero.alias("zero"), hashes.sha1(F.encode(body, "utf-8")).alias("digest"), volume.alias("volume"), scalars.volume_text(volume).alias("volume_back"),
        classify.sfo_edited(F.when(k % 2 == 0, "int32").otherwise("utf8"), F.lit(""), edit).alias("kind"), scalars.parse_number(edit).alias("number"),
    )


# F6 beyond ASCII: the hash over UTF-16 units of page addresses; the SQL holds for their ASCII characters.
@query("SELECT page_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper(url), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS hash FROM pages")
def path_hash31_any(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashes.hash31_any()(F.col("url")).alias("hash"))


# What an overlay leaves alone, and where files go.
@query("""
WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Image0/sce_sys/icon0.png' WHEN 1 THEN 'sce_sys/Param.sfo' WHEN 2 THEN 'SCE_SYS/param.sfo' WHEN 3 THEN 'param.sfo' ELSE 'data/' || p_partkey END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'Sc0' ELSE 'Image0' END AS area FROM part),
u AS (SELECT *, CASE WHEN starts_with(lower(path), 'image0/') THEN path[8:] ELSE path END AS plain FROM f), n AS (SELECT *, CASE WHEN starts_with(lower(plain), 'sce_sys/') THEN CASE plain[9:] WHEN 'icon0.png' THEN 4608 WHEN 'param.sfo' THEN 4096 ELSE 0 END ELSE 0 END::BIGINT AS entry_id FROM u)
SELECT p_partkey, path, entry_id, CASE WHEN entry_id > 0 THEN 'entry' ELSE 'image' END AS layer, CASE WHEN entry_id > 0 THEN plain[9:] ELSE plain END AS target, (area = 'Sc0' AND lower(path) = 'param.sfo') OR (area = 'Image0' AND lower(path) = 'sce_sys/param.sfo') AS exempt FROM n
""")
def file_routes(spark, sf_dir):
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "Image0/sce_sys/icon0.png").when(k == 1, "sce_sys/Param.sfo").when(k == 2, "SCE_SYS/param.sfo").when(k == 3, "param.sfo").otherwise(F.concat(F.lit("data/"), text("p_partkey")))
    files = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.when(F.col("p_partkey") % 2 == 0, "Sc0").otherwise("Image0").alias("area"))
    return classify.routed(files).withColumn("exempt", classify.is_overlay_exempt(F.col("area"), F.col("path"))).drop("area")


# Pairs that can't be merged.
@query("""
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Patch' WHEN 1 THEN NULL ELSE 'Game' END AS base_type, CASE o_custkey % 4 WHEN 0 THEN 'Game' ELSE 'Patch' END AS update_type, 'CUSA' || o_custkey AS base_title_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'cusa' || (o_custkey - o_orderkey % 2) END AS update_title_id FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(base_type, '') <> 'Game' THEN 'base is not a game' WHEN coalesce(update_type, '') <> 'Patch' THEN 'update is not a patch' ELSE 'title ids differ' END AS problem FROM p
WHERE coalesce(base_type, '') <> 'Game' OR coalesce(update_type, '') <> 'Patch' OR lower(base_title_id) IS DISTINCT FROM lower(update_title_id)
""")
def merge_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "Patch").when(k % 5 > 1, "Game").alias("base_type"), F.when(F.col("o_custkey") % 4 == 0, "Game").otherwise("Patch").alias("update_type"),
        F.concat(F.lit("CUSA"), text("o_custkey")).alias("base_title_id"), F.when(k % 3 != 0, F.concat(F.lit("cusa"), (F.col("o_custkey") - k % 2).cast("string"))).alias("update_title_id"),
    )
    return classify.pair_problems(pairs).select("o_orderkey", "problem")
