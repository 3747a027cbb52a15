"""Quotation linking: conversations without quotes, in the order of replies.

A line's quote level is the number of > marks before it. Lines of one level
form passages, blank lines part them. Passages and their lines are normalised
(lower case, single spaces) and hashed. The first message of a conversation
that holds a passage as its own words is its original; a message replies to the
earlier original of most of its quoted words at the lowest level that links.
Threads are followed up to their roots by pointer doubling, and messages are
placed by thread and turn. A conversation is never gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithospark.llm.columns import Passing
from lithospark.session import cut

MARKS = re.compile(r"\s{0,3}((?:>\s?)+)")
ATTRIBUTION = re.compile(r"^\s*(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)\b.{0,80}:\s*$", re.I)


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) for each line."""
    out = []
    for line in text.splitlines():
        m = MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The own words of a message, and (level, hash, words) of its passages and their lines."""
    lines = levels(text)
    own, quoted_after = [], False  # whether the next line that is not blank is quoted
    for level, line in reversed(lines):
        if level:
            quoted_after = True
        elif not line.strip():
            own.append("")
        else:
            if not (quoted_after and ATTRIBUTION.match(line)):
                own.append(line.rstrip())
            quoted_after = False
    own.reverse()
    found: dict[tuple[int, int], int] = {}

    def put(level: int, block: list[str]) -> None:
        for unit in {normalised(" ".join(block)), *map(normalised, block)}:
            if unit:
                found[level, xxhash.xxh64_intdigest(unit) - 2**63] = unit.count(" ") + 1

    level, block = 0, []
    for now, line in lines:
        if block and (now != level or not line.strip()):
            put(level, block)
            block = []
        if line.strip():
            level = now
            block.append(line)
    if block:
        put(level, block)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), [(a, h, n) for (a, h), n in found.items()]


def _parse(text: str):
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(x or "") for x in batch.column(text).to_pylist()]
            columns = {c: batch.column(c) for c in batch.schema.names if c != text}
            columns["own_text"] = pa.array([p[0] for p in parsed], pa.string())
            columns["passages"] = pa.array([[{"level": a, "hash": h, "words": n} for a, h, n in p[1]] for p in parsed], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages with own_text in place of the text, and parent_turn, root_turn, depth, n_passages, n_linked and position.

    n_passages counts quoted passages and lines, n_linked those with an earlier
    original in the conversation. Roots have no parent, depth 0 and themselves
    as root. position counts from 0 in each conversation, threads by their
    root's turn, then by turn; every reply comes after what it replies to.
    Null and empty texts have no words and no quotes. Rows with a null
    conversation or turn link with nothing and are placed first. Rows that
    share conversation and turn count as one message when linking and have
    places of their own. Other columns pass through; those that are named like
    the added ones are replaced.
    """
    passing = Passing(messages, ["own_text", "parent_turn", "root_turn", "depth", "n_passages", "n_linked", "position"], text)
    keys = [passing[conversation], passing[turn]]
    others = list(dict.fromkeys([*passing.inner, *keys]))
    rows = passing.df.select(*others, passing[text])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    parsed = cut(rows.mapInArrow(_parse(passing[text]), f"{kept}own_text string, passages array<struct<level: int, hash: long, words: int>>"))
    c, t = map(F.col, keys)
    units = parsed.where(c.isNotNull() & t.isNotNull()).select(c.alias("c"), t.alias("t"), F.explode("passages").alias("p")).select("c", "t", "p.*")
    # Only passages that some message quotes are looked for; copies within a message count once.
    quoted = units.where("level > 0").groupBy("c", "t", "level", "hash").agg(F.max("words").alias("words"))
    originals = units.where("level = 0").groupBy("c", "hash").agg(F.min("t").alias("origin"))
    linked = quoted.join(originals, ["c", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("t"), F.col("origin")))
    by_origin = linked.groupBy("c", "t", "level", "origin").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("k"))
    choice = F.min_by("origin", F.when(F.col("origin").isNotNull(), F.struct("level", -F.col("words"), -F.col("origin"))))
    replies = cut(by_origin.groupBy("c", "t").agg(choice.alias("parent"), F.sum("k").alias("n_passages"), F.sum(F.when(F.col("origin").isNotNull(), F.col("k")).otherwise(0)).alias("n_linked")))
    # Pointer doubling: jump leads 2^k steps up, or to the root.
    jumps = replies.where("parent is not null").select("c", "t", F.col("parent").alias("jump"), F.lit(1).alias("depth"))
    while True:
        up = jumps.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"))
        jumps = cut(
            jumps.join(up, (F.col("c") == F.col("c2")) & (F.col("jump") == F.col("t2")), "left").select(
                "c", "t", F.coalesce("jump2", "jump").alias("jump"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("jump2").isNotNull().alias("moved")
            )
        )
        if not jumps.where("moved").limit(1).count():
            break
        jumps = jumps.drop("moved")
    told = replies.join(jumps.select("c", "t", "jump", "depth"), ["c", "t"], "left")
    rows = parsed.drop("passages").join(told, (c == F.col("c")) & (t == F.col("t")), "left").select(
        *others, "own_text", F.col("parent").alias("parent_turn"), F.coalesce("jump", t).alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    # Ranges of the whole order; each knows how many rows of a conversation lie in ranges before it.
    order = [c, F.col("root_turn"), t, F.xxhash64("own_text")]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = ranged.groupBy(c.alias("_c"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before)
    return passing.restored(ranged.join(parts, c.eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p"))).withColumn("position", F.col("_at") - F.col("_first") + F.col("_before")))
