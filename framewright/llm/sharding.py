"""Operator 1, sharding: a permutation-filled lookup table gives every key a shard.

Each shard has its own order of preference over a prime number of slots: an offset and a step that follow from its
name. Shards take turns, and in its turn a shard claims the first slot of its order that is free. The table has a
fixed size, so it is broadcast, and placing a key is one hash and one lookup. When a shard joins or leaves, few other
keys move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime over 100 times the shards keeps the shards' shares within about 1 %.
SLOTS = 2039


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's order; any step from 1 to slots - 1 visits every slot, as slots is prime."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. slots is prime and not below the number of shards; shards are distinct names."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be distinct and at least one")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    wishes = [(lambda o, s: (((o + j * s) % slots) for j in range(slots)))(*preference(x, slots)) for x in shards]
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        k = turn % len(shards)
        slot = next(x for x in wishes[k] if owner[x] is None)
        owner[slot] = shards[k]
    return owner  # type: ignore[return-value]


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds slot and shard to every row; rows with equal keys meet in one shard.

    Nulls count as a value of their own; an empty table stays empty; repeated rows go to the same shard. Columns of
    df named like the new ones are replaced. A key that may hold a large share of the rows (a source, say) must be
    given with a second column, such as the document's id, which spreads it over all shards.
    """
    table = lookup_table(shards, slots)
    spark = df.sparkSession
    owners = F.broadcast(spark.range(slots).select(F.col("id").alias("__slot"), F.get(F.lit(table), F.col("id").cast("int")).alias("__shard")))
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % slots
    placed = df.drop(slot_col, shard_col).withColumn("__slot", slot).join(owners, "__slot", "left")
    return placed.withColumnsRenamed({"__slot": slot_col, "__shard": shard_col})


def oracle_sql(shards: Sequence[str], slots: int = SLOTS) -> str:
    """The same placement of documents by doc_id in DuckDB: a recursive fill of the table, one turn a step."""
    names = ", ".join(f"({k}, '{x}')" for k, x in enumerate(shards))
    n = len(shards)
    return f"""
WITH RECURSIVE names(k, shard) AS (VALUES {names}),
wishes AS (
  SELECT list(CAST('0x' || substr(md5(shard), 1, 8) AS BIGINT) % {slots} ORDER BY k) AS offsets,
         list(CAST('0x' || substr(md5(shard), 9, 8) AS BIGINT) % {slots - 1} + 1 ORDER BY k) AS steps
  FROM names),
fill(turn, owner) AS (
  SELECT 0, list_transform(range({slots}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_transform(range({slots}), lambda x: CASE WHEN x = pick THEN turn % {n} ELSE owner[x + 1] END)
  FROM (
    SELECT turn, owner,
      (offsets[turn % {n} + 1] + list_filter(range({slots}), lambda j: owner[(offsets[turn % {n} + 1] + j * steps[turn % {n} + 1]) % {slots} + 1] = -1)[1] * steps[turn % {n} + 1]) % {slots} AS pick
    FROM fill, wishes WHERE turn < {slots})),
slots AS (SELECT unnest(range({slots})) AS slot, unnest(owner) AS k FROM fill WHERE turn = {slots})
SELECT d.doc_id, s.slot, names.shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 8) AS BIGINT) % {slots} AS slot FROM documents) d
JOIN slots s USING (slot) JOIN names USING (k)"""
