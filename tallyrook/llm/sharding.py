"""Shards of near equal bytes by histogram sort, with DataFrame operations only.

Rows are ordered by a key of 32 hexadecimal digits: a hash of the text, then a hash of the row's id, so that copies of a
text stand together and a large group of them can still be cut. Each round counts the exact bytes below candidate
boundaries (prefixes of the key) in one aggregation over all partitions and keeps refining those prefixes that a wanted
splitter falls into, until every splitter is within the tolerance or cannot be moved closer. The driver sees at most
4096 counts per open splitter and round. Rows are exchanged once, for their slots, over ranges that the counts have
sized; a text that fills a range of its own many times over is spread by the hash of the id.

A null text has no bytes; a null id is a value of its own. Rows equal in text and id cannot be told apart and stay in
one shard. An empty table gives an empty table; extra columns are ignored. Slots are numbered by key within ranges, whose width
follows from the size of the table.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.llm.shared import cut, small

#: Hexadecimal digits of the whole key, those of its first half (the text), and those refined per round.
DIGITS, HALF, STEP = 32, 16, 3
#: Sorts after every digit.
AFTER = "g"
ROW_BYTES = 16


def order_key(text: Column, doc_id: Column) -> Column:
    digits = lambda c: F.lpad(F.hex(F.xxhash64(c)), HALF, "0")
    return F.concat(digits(text), digits(doc_id))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def splitters(sized: DataFrame, shards: int, tolerance: float = 0.001) -> list[str]:
    """The shards - 1 boundaries of sized (key, size): a row lies in as many shards' right as boundaries are <= its key.

    tolerance: of a shard's fair share of bytes, how far the bytes below a boundary may be from the wanted sum.
    """
    found: dict[int, str] = {}
    open_, low = {"": list(range(1, shards))}, {"": 0}
    total, used = None, 0
    while open_:
        used = min(used + STEP, DIGITS)
        rows = sized if used == STEP else sized.filter(F.substring("key", 1, used - STEP).isin(list(open_)))
        counts: dict[str, list[tuple[str, int, int]]] = {}
        for r in rows.groupBy(F.substring("key", 1, used).alias("at")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            counts.setdefault(r["at"][: used - STEP if used < DIGITS or used % STEP == 0 else used - used % STEP], []).append((r["at"], r["bytes"], r["n"]))
        if total is None:
            total = sum(b for _, b, _ in counts.get("", []))
            slack = tolerance * total / shards
        still: dict[str, list[int]] = {}
        for node, wanted in open_.items():
            parts = sorted(counts.get(node, []))
            ends = list(accumulate((b for _, b, _ in parts), initial=low[node]))
            for i in wanted:
                goal = total * i / shards
                j = min(bisect_left(ends, goal), len(parts)) - 1  # parts[j] holds the goal
                if j < 0:
                    found[i] = parts[0][0] if parts else AFTER
                    continue
                before, after = goal - ends[j], ends[j + 1] - goal
                if min(before, after) <= slack or parts[j][2] == 1 or used == DIGITS:
                    found[i] = parts[j][0] if before < after else parts[j][0] + AFTER
                else:
                    still.setdefault(parts[j][0], []).append(i)
                    low[parts[j][0]] = ends[j]
        open_ = still
    return [found[i] for i in range(1, shards)]


def shard_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are <= key."""
    if not bounds:
        return F.lit(0)
    return sum(((key >= F.lit(b)).cast("int") for b in bounds[1:]), (key >= F.lit(bounds[0])).cast("int"))


def shard_by_bytes(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, range_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, text, size, shard and slot of every row; slots count from 0 in each shard, by key within ranges.

    range_bytes: about how much of the table one task numbers.
    """
    keyed = docs.select("doc_id", "text", row_size(F.col("text")).alias("size"), order_key(F.col("text"), F.col("doc_id")).alias("key"))
    sized = cut(keyed.select("key", "size"))
    bounds = splitters(sized, shards, tolerance)
    total, n = sized.agg(F.sum("size"), F.count("*")).first()
    digits = next((d for d in range(1, HALF) if 16**d * range_bytes >= (total or 0)), HALF)
    most = max(1000, 8 * (n or 0) // 16**digits)
    ranges = sized.groupBy(F.substring("key", 1, digits).alias("at")).count().filter(F.col("count") > most)
    crowded = [r["at"] for r in ranges.collect()]
    hot = sized.filter(F.substring("key", 1, digits).isin(crowded)).groupBy(F.substring("key", 1, HALF).alias("at")).count().filter(F.col("count") > most)
    texts = [r["at"] for r in hot.collect()] if crowded else []  # at most n / most
    key = F.col("key")
    part = F.when(F.substring(key, 1, HALF).isin(texts), F.substring(key, 1, HALF + 2)) if texts else F.when(F.lit(False), key)
    placed = lambda frame: frame.withColumns({"shard": shard_of(key, bounds), "part": part.otherwise(F.substring(key, 1, digits))})
    counts = placed(sized).groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("key", "doc_id")
    numbered = placed(keyed).withColumn("rank", F.row_number().over(within).cast("long") - 1)
    placed_rows = numbered.join(small(offsets), ["shard", "part"])
    return placed_rows.select("doc_id", "text", "size", "shard", (F.col("offset") + F.col("rank")).alias("slot"))


def shard_digests(docs: DataFrame, shards: int = 40) -> DataFrame:
    placed = shard_by_bytes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), shards)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
