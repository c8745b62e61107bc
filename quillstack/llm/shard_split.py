"""Sharding by sampled splitters, with DataFrame functions only.

Law ``bytes``: sizes near equal. The key of a row is the digest of its text, so equal texts lie together; rows of a group of equal
texts with more than ``1 / PER_SHARD`` of a shard's bytes are keyed by the digest of doc_id as well.
A size-weighted sample of keys, ``DRAWS`` expected for each range, gives quantile boundaries: the splitters. Ranges are ``PER_SHARD`` for a
shard, and more where they would exceed ``RANGE_BYTES``, up to ``MOST``; rows are dealt to them by binary search. A range
with over twice its share is subdivided evenly along the key. Ranges and their parts are what shards are made of: each goes whole
to the shard that holds the middle of its bytes in key order, so a shard's size differs from an equal share by no more than its parts
at either end, about 1 / ``PER_SHARD`` of it, unless a single row is larger. Slots count a shard's rows in key order.

Ranges are known by narrow rows: doc_id, size, checksum and key. Texts are read once and never move.

Defined cases: null text has size 1 and the digest of no text; a null doc_id is a key of its own; repeated rows are ordered by
their row number; very long texts count whole, and one that exceeds a shard makes its shard larger; fewer rows than shards leave
shards empty; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm._tables import drop_written, written

SHARDS, PER_SHARD = 8, 256
RANGE_BYTES, MOST, DRAWS = 1 << 28, 1 << 15, 16
_DIGITS = 13  # hex digits that are compared as a number


def _range_of(key: Column, bounds: Column, bits: int) -> Column:
    """How many of the 2 ** bits - 1 sorted bounds are at most ``key``: binary search, one step for each bit."""

    def step(at: Column, half: Column) -> Column:
        return F.when(F.get(bounds, at + half - 1) <= key, at + half).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), step)


def _place(key: Column) -> Column:
    """A key's first 13 hex digits as a number, for even subdivision; monotone in the key."""
    return F.conv(F.substring(key, 1, _DIGITS), 16, 10).cast("long")


def n_ranges(total: int, n_shards: int) -> int:
    """A power of two: ``PER_SHARD`` ranges for a shard at least, of ``RANGE_BYTES`` at most while there are fewer than ``MOST``."""
    wanted = max(n_shards * PER_SHARD, min(MOST, -(-total // RANGE_BYTES)))
    return 1 << (wanted - 1).bit_length()


def splitters(rows: DataFrame, total: int, n: int) -> list[str]:
    """Up to ``n`` - 1 boundaries: quantiles of a size-weighted sample of ``rows`` (key, doc_id, size) whose sizes add up to ``total``.

    Bounded by ``n``: some ``DRAWS`` keys for each range come to the driver."""
    chance = F.col("size") * F.lit(n * DRAWS / total)
    draw = _place(F.md5(F.concat_ws("|", "key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))) / F.lit(float(1 << 4 * _DIGITS))
    drawn = rows.where(draw < chance).select("key", F.least(F.ceil(chance), F.lit(n * DRAWS)).cast("int").alias("times"))
    drawn = drawn.withColumn("key", F.explode(F.array_repeat("key", F.col("times"))))
    keys = drawn.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    at = f"transform(sequence(1, {n} - 1), i -> get(keys, CAST(CAST(i AS bigint) * size(keys) div {n} AS int)))"
    return keys.select(F.when(F.size("keys") > 0, F.expr(at)).alias("bounds")).first()[0] or []


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("")).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = sizes = written(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # at most n_shards * PER_SHARD groups can be that large
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (n_shards * PER_SHARD) > total)
    rows = rows.join(F.broadcast(large.select("group", F.lit(True).alias("large"))), "group", "left")
    inner = F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lpad(F.hex("row"), 16, "0"))
    rows = rows.select("doc_id", "size", "text_crc32", F.when(F.col("large"), F.concat("group", inner)).otherwise(F.col("group")).alias("key"))

    n = n_ranges(total, n_shards)
    # one literal, made an array when the query is planned
    bounds = F.split(F.lit(",".join(splitters(rows, total, n))), ",")
    rows = written(rows.withColumn("range", _range_of(F.col("key"), bounds, n.bit_length() - 1)), "ranged")
    drop_written(sizes)

    # subdivide overfull ranges; one row for each range
    sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    over = sums.where(F.col("bytes") * n > 2 * total)
    shift = F.when(F.substring("low", 1, 32) == F.substring("high", 1, 32), 32).otherwise(0)
    over = over.select("range", shift.alias("shift"), F.ceil(F.col("bytes") * n / total).cast("long").alias("parts"), "low", "high")
    over = over.withColumn("from", _place(F.substr("low", F.col("shift") + 1))).withColumn("to", _place(F.substr("high", F.col("shift") + 1)))
    rows = rows.join(F.broadcast(over.select("range", "shift", "parts", "from", "to")), "range", "left")
    along = (_place(F.substr("key", F.col("shift") + 1)) - F.col("from")) / (F.col("to") - F.col("from") + 1)
    rows = rows.withColumn("part", F.coalesce(F.floor(along * F.col("parts")).cast("long"), F.lit(0).cast("long"))).drop("shift", "parts", "from", "to")

    # one row for each part, three times the ranges at most
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.withColumn("bytes_before", ahead("bytes")).withColumn("rows_before", ahead("n"))
    parts = parts.withColumn("shard", F.expr(f"CAST((2 * bytes_before + bytes) * {n_shards} div {2 * total} AS int)"))
    first = F.min("rows_before").over(Window.partitionBy("shard"))
    parts = parts.select("range", "part", "shard", (F.col("rows_before") - first).alias("ahead"))

    nth = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id"))
    placed = rows.withColumn("nth", nth).join(F.broadcast(parts), ["range", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("nth") - 1).alias("slot"))
