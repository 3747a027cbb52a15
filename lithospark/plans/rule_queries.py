"""Queries that apply the integrity rules to the driver's tables, with SQL written from what the rules say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.operators import rules
from lithospark.plans.registry import query, table


def told(stage: int, ordinal: str, structure: str, offset: str, reason: str, source: str, severity: str = "failure", file: str = "file") -> str:
    """SQL for the violations that the rows of source are."""
    return f"SELECT {file} AS file, {stage} AS stage, ({ordinal})::BIGINT AS ordinal, '{structure}' AS structure, ({offset})::BIGINT AS \"offset\", '{reason}' AS reason, '{severity}' AS severity FROM {source}"


def text(name: str):
    return F.col(name).cast("string")


# V1 to V3: headers from orders.
@query("WITH h AS (SELECT o_orderkey::VARCHAR AS file, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 524288 ELSE o_custkey END AS pos, o_custkey * 100 AS size, 600000 AS whole FROM orders) " + " UNION ALL ".join([
    told(1, "0", "header", "pos", "image offset is zero", "h WHERE pos = 0"),
    told(1, "0", "header", "pos", "image offset is not aligned", "h WHERE pos % 524288 <> 0"),
    told(1, "0", "header", "pos", "image ends beyond the file", "h WHERE pos + size > whole"),
]))
def header_rules(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    pos = F.when(k == 0, F.lit(0)).when(k == 1, F.lit(524288)).otherwise(F.col("o_custkey"))
    return rules.header_violations(table(spark, sf_dir, "orders").select(text("o_orderkey").alias("file"), pos.cast("long").alias("pfs_image_offset"), (F.col("o_custkey") * 100).alias("pfs_image_size"), F.lit(600000).alias("file_size")))


# V4: line numbers as ids.
@query("WITH t AS (SELECT l_orderkey::VARCHAR AS file, max(l_partkey) AS o FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) " + told(1, "o", "entry", "0", "duplicate id", "t"))
def duplicate_rules(spark, sf_dir):
    return rules.duplicate_violations(table(spark, sf_dir, "lineitem").select(text("l_orderkey").alias("file"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("ordinal")))


# Customers as inodes, their orders as blocks.
@query("""WITH i AS (SELECT 'image' AS file, c_custkey AS inode, c_custkey % 50 AS mode FROM customer), p AS (SELECT 'image' AS file, o_custkey AS inode, o_orderkey % 1000 - 1 AS block FROM orders),
s AS (SELECT file, block, min(inode) AS inode FROM p WHERE block > 0 GROUP BY file, block HAVING count(DISTINCT inode) > 1) """ + " UNION ALL ".join([
    told(2, "inode", "inode", "0", "inode is not in use", "i WHERE mode = 0"),
    told(2, "inode", "inode", "block", "block lies beyond the image", "p WHERE block >= 900"),
    told(2, "inode", "block", "block", "block has several owners", "s"),
]))
def inode_rules(spark, sf_dir):
    inodes = table(spark, sf_dir, "customer").select(F.lit("image").alias("file"), F.col("c_custkey").alias("inode"), (F.col("c_custkey") % 50).alias("mode"))
    pointers = table(spark, sf_dir, "orders").select(F.lit("image").alias("file"), F.col("o_custkey").alias("inode"), (F.col("o_orderkey") % 1000 - 1).alias("block"))
    return rules.inode_violations(inodes, pointers, F.lit(900))


# A container header for each part.
CONTAINERS_SQL = """WITH h AS (SELECT p_partkey::VARCHAR AS file, CASE WHEN p_partkey % 7 = 0 THEN 'PFSX' ELSE 'PFSC' END AS magic, CASE p_partkey % 5 WHEN 0 THEN 1024 WHEN 1 THEN 70000 ELSE 65536 END AS data, CASE p_partkey % 3 WHEN 0 THEN 0 ELSE 1024 END AS pos,
  p_size * 32768 * CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE 1 END AS size, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 49152 ELSE 65536 END AS block, p_partkey * 30 AS whole FROM part),
e AS (SELECT *, trunc(size / greatest(block, 1))::BIGINT + 1 AS n FROM h) """


@query(CONTAINERS_SQL + " UNION ALL ".join([
    told(3, "0", "container", "0", "bad magic", "e WHERE magic <> 'PFSC'"),
    told(3, "0", "container", "data", "bad data offset", "e WHERE data < 65536 OR data % 65536 <> 0"),
    told(3, "0", "container", "pos", "bad table offset", "e WHERE pos <= 0 OR pos >= data"),
    told(3, "0", "container", "size", "bad size", "e WHERE size <= 0 OR block <= 0 OR size % nullif(block, 0) <> 0"),
    told(3, "0", "container", "pos", "table overlaps the data", "e WHERE pos + n * 8 > data OR pos + n * 8 > whole"),
    told(3, "0", "container", "block", "block size is no power of two", "e WHERE block <= 0 OR block & (block - 1) <> 0"),
]))
def container_rules(spark, sf_dir):
    k, number = F.col("p_partkey"), lambda c: c.cast("long")
    return rules.container_violations(table(spark, sf_dir, "part").select(
        text("p_partkey").alias("file"), F.when(k % 7 == 0, "PFSX").otherwise("PFSC").alias("magic"), number(F.when(k % 5 == 0, 1024).when(k % 5 == 1, 70000).otherwise(65536)).alias("data_offset"),
        number(F.when(k % 3 == 0, 0).otherwise(1024)).alias("table_offset"), number(F.col("p_size") * 32768 * F.when(k % 11 == 0, -1).otherwise(1)).alias("rounded_size"),
        number(F.when(k % 6 == 0, 0).when(k % 6 == 1, 49152).otherwise(65536)).alias("block_size"), (k * 30).alias("file_size"),
    ))


# A user's events as a table of offsets.
@query("""WITH b AS (SELECT user_id::VARCHAR AS file, event_id, round(value * 100)::BIGINT AS o FROM events), p AS (SELECT *, lag(o) OVER (PARTITION BY file ORDER BY event_id) AS before, lead(o) OVER (PARTITION BY file ORDER BY event_id) AS after FROM b),
l AS (SELECT file, arg_max(o, event_id) AS o, max(event_id) AS event_id FROM b GROUP BY file) """ + " UNION ALL ".join([
    told(3, "event_id", "table", "o", "offset falls", "p WHERE o < before"),
    told(3, "event_id", "table", "o", "table does not end with the file", "l WHERE o <> 100"),
    told(3, "event_id", "table", "o", "stored size exceeds the block size", "p WHERE after - o > 4000"),
]))
def table_rules(spark, sf_dir):
    blocks = table(spark, sf_dir, "events").select(text("user_id").alias("file"), F.col("event_id").alias("block_no"), F.round(F.col("value") * 100).cast("long").alias("offset"))
    headers = blocks.select("file").distinct().select("file", F.lit(100).cast("long").alias("file_size"), F.lit(4000).alias("block_size"))
    return rules.table_violations(blocks, headers)


# Documents as inflated blocks, null for some.
@query("""WITH b AS (SELECT source AS file, doc_id, CASE WHEN doc_id % 17 <> 0 THEN octet_length(encode(text)) END AS n FROM documents), h AS (SELECT source AS file, sum(octet_length(encode(text))) AS size FROM documents GROUP BY source),
t AS (SELECT file, coalesce(sum(n), 0) AS total, any_value(size) AS size FROM b JOIN h USING (file) GROUP BY file) """ + told(3, "doc_id", "block", "doc_id * 4096", "block does not inflate", "b WHERE n IS NULL") + " UNION ALL " + told(3, "0", "container", "0", "content has another size", "t WHERE total <> size"))
def content_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    blocks = docs.select(F.col("source").alias("file"), F.col("doc_id").alias("block_no"), (F.col("doc_id") * 4096).alias("offset"), F.when(F.col("doc_id") % 17 != 0, F.encode("text", "utf-8")).alias("content"))
    return rules.content_violations(blocks, docs.groupBy(F.col("source").alias("file")).agg(F.sum(F.octet_length("text")).alias("rounded_size")))


# Stored and computed digests, some stored ones empty.
@query("""WITH d AS (SELECT p_brand AS file, p_partkey, sha256(p_name) AS computed, CASE p_partkey % 5 WHEN 0 THEN repeat('00', 32) WHEN 1 THEN sha256(p_type) ELSE sha256(p_name) END AS stored FROM part)
SELECT file, 5 AS stage, p_partkey AS ordinal, 'entry' AS structure, 0::BIGINT AS "offset", 'digest differs' AS reason, CASE WHEN p_partkey % 5 = 0 THEN 'warning' ELSE 'failure' END AS severity FROM d WHERE stored <> computed""")
def digest_rules(spark, sf_dir):
    digest, k = lambda c: F.unhex(F.sha2(F.col(c), 256)), F.col("p_partkey") % 5
    stored = F.when(k == 0, F.unhex(F.lit("00" * 32))).when(k == 1, digest("p_type")).otherwise(digest("p_name"))
    return rules.digest_violations(table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ordinal"), F.lit("entry").alias("structure"), stored.alias("stored"), digest("p_name").alias("computed")), tolerant=True)


# Customers whose number is not twice that of one who ordered list nothing.
@query("WITH c AS (SELECT c_custkey::VARCHAR AS file FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)) " + told(7, "0", "listing", "0", "nothing is listed", "c"))
def listing_rules(spark, sf_dir):
    return rules.listing_violations(table(spark, sf_dir, "customer").select(text("c_custkey").alias("file")), table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).cast("string").alias("file")))


# Part names as payloads that reach to the next part of the brand pos most.
@query("""WITH e AS (SELECT p_brand AS file, p_partkey AS ordinal, p_partkey * 8 AS pos, strlen(p_name) + 1 AS size, p_name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE left(p_name, 8) END AS told, 8 * (SELECT max(p_partkey) FROM part) + 12 AS whole FROM part),
r AS (SELECT *, coalesce(min(pos) OVER (PARTITION BY file ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), whole) - pos AS room FROM e)
SELECT file, ordinal, ordinal AS id, CASE WHEN told IS NULL OR pos + size > whole THEN 'SKIPPED' WHEN left(p_name, least(size, room)::INT) = told THEN 'OK' ELSE 'FAIL' END AS status FROM r""")
def verify_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ordinal"), "p_name")
    whole = 8 * part.agg(F.max("ordinal")).first()[0] + 12
    entries = part.select("file", "ordinal", F.col("ordinal").alias("id"), (F.col("ordinal") * 8).alias("data_offset"), (F.octet_length("p_name") + 1).alias("data_size"), F.lit(whole).alias("file_size"))
    told_ = F.when(F.col("ordinal") % 4 == 1, F.col("p_name")).when(F.col("ordinal") % 4 > 1, F.substring("p_name", 1, 8))
    digests = part.select("file", "ordinal", F.unhex(F.sha2(told_, 256)).alias("stored"))
    return rules.verified_entries(entries, part.select("file", "ordinal", F.encode("p_name", "utf-8").alias("data")), digests)


# Customers as metadata files, their orders as values.
@query("WITH f AS (SELECT c_custkey, c_custkey::VARCHAR AS file FROM customer) " + told(1, "0", "sfo", "0", "bad magic", "f WHERE c_custkey % 9 = 0") + " UNION ALL " + told(1, "0", "sfo", "0", "no values", "f WHERE c_custkey % 9 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)"))
def sfo_rules(spark, sf_dir):
    return rules.sfo_violations(table(spark, sf_dir, "customer").select(text("c_custkey").alias("file"), (F.col("c_custkey") % 9 != 0).alias("magic_ok")), table(spark, sf_dir, "orders").select(text("o_custkey").alias("file")))


# Customers as dumps, their orders as files.
DUMP_NAMES = ["eboot.bin", "Sce_Sys/param.sfo", "sce_sys/keystone", "param.sfo", "data/x"]


@query("""WITH l AS (SELECT o_custkey::VARCHAR AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'Sc0' ELSE 'Image0' END AS area, lower(['eboot.bin', 'Sce_Sys/param.sfo', 'sce_sys/keystone', 'param.sfo', 'data/x'][1 + o_orderkey % 5]) AS path FROM orders), d AS (SELECT c_custkey::VARCHAR AS file FROM customer) """ + " UNION ALL ".join([
    told(1, "0", "dump", "0", "Image0 is missing", "d WHERE file NOT IN (SELECT file FROM l WHERE area = 'Image0')"),
    told(1, "0", "dump", "0", "Sc0/param.sfo is missing", "d WHERE file NOT IN (SELECT file FROM l WHERE area = 'Sc0' AND path = 'param.sfo')"),
    *(told(2, "0", "dump", "0", f"{name} is missing", f"d WHERE file NOT IN (SELECT file FROM l WHERE area = 'Image0' AND path = '{name}')", "warning") for name in ("eboot.bin", "sce_sys/param.sfo", "sce_sys/keystone")),
]))
def dump_rules(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, DUMP_NAMES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    listing = table(spark, sf_dir, "orders").select(text("o_custkey").alias("file"), F.when(F.col("o_orderkey") % 3 == 0, "Sc0").otherwise("Image0").alias("area"), name.alias("path"))
    return rules.dump_violations(table(spark, sf_dir, "customer").select(text("c_custkey").alias("file")), listing)


# Parts as audio files.
@query("WITH f AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS file, p_size, p_size * 3 AS s FROM part) " + " UNION ALL ".join([
    told(1, "0", "audio", "0", "form is not WAVE", "f WHERE k % 8 = 0"), told(1, "0", "audio", "0", "no format chunk", "f WHERE k % 9 = 0"), told(1, "0", "audio", "0", "no fact chunk", "f WHERE k % 10 = 0"),
    told(1, "0", "audio", "0", "no data chunk", "f WHERE k % 11 = 0"), told(1, "0", "audio", "0", "bad number of channels", "f WHERE k % 12 < 1 OR k % 12 > 8"), told(1, "0", "audio", "0", "loop lies beyond the samples", "f WHERE k % 40 > s OR s > 100"),
]))
def audio_rules(spark, sf_dir):
    k = F.col("p_partkey")
    return rules.audio_violations(table(spark, sf_dir, "part").select(
        text("p_partkey").alias("file"), F.when(k % 8 == 0, "AIFF").otherwise("WAVE").alias("form"), (k % 9 != 0).alias("has_fmt"), (k % 10 != 0).alias("has_fact"), (k % 11 != 0).alias("has_data"),
        (k % 12).alias("channels"), (k % 40).alias("loop_start"), (F.col("p_size") * 3).alias("loop_end"), F.lit(100).alias("sample_count"),
    ))


# Parts as files of block ranges, suppliers as inodes, events as the table.
def ranges(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("image").alias("file"), k.alias("ordinal"), F.when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("path"), (k % 15 - 1).alias("inode"), (k * 7 % 12000 - 3).alias("start_block"), (k % 6).alias("block_count"))


@query("""WITH t AS (SELECT event_id AS block_no, round(value * 100)::BIGINT AS o FROM events), m AS (SELECT max(block_no) AS blocks FROM t), i AS (SELECT max(s_suppkey) + 1 AS inodes FROM supplier),
r AS (SELECT 'image' AS file, p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS path, p_partkey % 15 - 1 AS inode, p_partkey * 7 % 12000 - 3 AS s, p_partkey % 6 AS n, inodes, blocks FROM part, m, i) """ + " UNION ALL ".join([
    told(8, "k", "file", "inode", "inode is out of range", "r WHERE inode < 0 OR inode >= inodes"), told(8, "k", "file", "0", "path is empty", "r WHERE path = ''"),
    told(8, "k", "file", "s", "block count is not positive", "r WHERE n <= 0"), told(8, "k", "file", "s", "range lies beyond the table", "r WHERE s < 0 OR s + n > blocks"),
    told(8, "k", "file", "s", "table falls within the range", "r JOIN t AS a ON a.block_no = s JOIN t AS b ON b.block_no = s + n WHERE b.o < a.o"),
]))
def consumer_rules(spark, sf_dir):
    blocks = table(spark, sf_dir, "events").select(F.lit("image").alias("file"), F.col("event_id").alias("block_no"), F.round(F.col("value") * 100).cast("long").alias("offset"))
    return rules.consumer_violations(table(spark, sf_dir, "supplier").select(F.lit("image").alias("file"), F.col("s_suppkey").alias("inode")), ranges(spark, sf_dir), blocks)


# Customers as images, orders as inodes, lines as records that name them.
@query("""WITH i AS (SELECT o_custkey % 20 AS file, o_orderkey AS inode FROM orders), d AS (SELECT o_custkey % 20 AS file, l_orderkey AS inode, l_linenumber - 2 AS name_length, l_quantity::BIGINT AS entry_size FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT file, count(DISTINCT inode) AS reached, count(*) FILTER (name_length <= 0 OR name_length > 255) AS bad_names, count(*) FILTER (entry_size < 17 OR entry_size % 8 <> 0) AS bad_sizes FROM d GROUP BY file),
u AS (SELECT file, count(*) AS unreferenced FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file = i.file AND d.inode = i.inode) GROUP BY file)
SELECT h.file, 500::BIGINT AS declared, coalesce(reached, 0)::BIGINT AS reached, coalesce(unreferenced, 0)::BIGINT AS unreferenced, coalesce(bad_names, 0)::BIGINT AS bad_names, coalesce(bad_sizes, 0)::BIGINT AS bad_sizes FROM (SELECT DISTINCT file FROM i) h LEFT JOIN r USING (file) LEFT JOIN u USING (file)""")
def scan_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("file"), F.col("o_orderkey").alias("inode"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inode"), (F.col("l_linenumber") - 2).alias("name_length"), F.col("l_quantity").cast("long").alias("entry_size"))
    headers = orders.select("file").distinct().withColumn("dinode_count", F.lit(500).cast("long"))
    return rules.scan_counters(headers, orders, orders.join(lines, "inode"))
