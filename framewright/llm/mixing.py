"""Operator 2, mixing sources to target weights by Pfair scheduling.

A source of weight w (of a total of D) needs its block j (0, 1, ...) within the window from slot floor(j D / w), its
release, to slot ceil((j + 1) D / w), its deadline. Earliest deadline first over the released blocks meets all
windows, so that after any number of slots every source has had its exact share, to less than one block. The schedule
repeats every D slots, so that one period, bounded by the weights given, is computed once and broadcast; every row
then finds its own slot from its block's number alone, in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: All sources without a weight of their own share the weight of this name.
REST = "*"


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """For each source, the slots of its blocks in one period of sum(weights) slots; weights are positive integers."""
    total = sum(weights.values())
    if not weights or min(weights.values()) < 1 or total > 100_000:
        raise ValueError("weights must be positive integers with a sum of 100,000 at most")
    slots: dict[str, list[int]] = {k: [] for k in weights}
    order = sorted(weights)
    waiting = [(0, k) for k in order]
    ready: list[tuple[int, str]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * total // weights[k]), k))
        _, k = heapq.heappop(ready)
        slots[k].append(slot)
        if len(slots[k]) < weights[k]:
            heapq.heappush(waiting, (len(slots[k]) * total // weights[k], k))
    return slots


def mix(df: DataFrame, source: str, key: str, weights: Mapping[str, int], block_rows: int = 16) -> DataFrame:
    """Adds mix_source, mix_row, mix_block, mix_slot, mix_release and mix_deadline to every row; no row goes.

    A source's rows are ordered by md5 of the key, then the key, which shuffles them for good; mix_row counts them
    from 0, and block_rows of them make a block. Reading the rows by (mix_slot, mix_row) gives the mix: as long as
    no source has run out, each has its share to less than a block after any slot; then its slots stay empty and
    the others keep their proportions.

    Null sources and those without a weight count as REST, which has weight 1 unless given. A null key sorts as the
    text 'null'. Repeated rows take successive places. An empty table stays empty. Columns of df named like the new
    ones are replaced.

    A hot source is not one task's work: rows are numbered within 4,096 hash ranges of a source, and each range
    begins where the counts of the ranges before it end. That table of counts has 4,096 rows a weight at most.
    """
    weights = dict(weights)
    weights.setdefault(REST, 1)
    slots = period(weights)
    total = sum(weights.values())
    new = ["mix_source", "mix_row", "mix_block", "mix_slot", "mix_release", "mix_deadline"]
    known = F.lit([k for k in weights if k != REST]) if len(weights) > 1 else F.array().cast("array<string>")
    name = F.col(source).cast("string")
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    rows = df.drop(*new).withColumns(
        {"mix_source": F.when(F.array_contains(known, name), name).otherwise(F.lit(REST)), "__hash": hashed, "__range": F.substring(hashed, 1, 3)}
    )
    counts = rows.groupBy("mix_source", "__range").count()
    before = F.sum("count").over(Window.partitionBy("mix_source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("mix_source", "__range", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("mix_source", "__range").orderBy("__hash", key))
    plan = F.create_map(*[x for k, own in slots.items() for x in (F.lit(k), F.lit(own))])
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w).cast("bigint"))])
    block, w = F.col("mix_block"), F.col("__weight")
    return (
        rows.withColumn("__within", within)
        .join(F.broadcast(starts), ["mix_source", "__range"])
        .withColumn("mix_row", F.col("__start") + F.col("__within") - 1)
        .withColumns({"mix_block": F.floor(F.col("mix_row") / block_rows).cast("bigint"), "__weight": weight[F.col("mix_source")]})
        .withColumns(
            {
                "mix_slot": whole(block, w) * total + F.get(plan[F.col("mix_source")], (block % w).cast("int")),
                "mix_release": whole(block * total, w),
                "mix_deadline": whole((block + 1) * total + w - 1, w),
            }
        )
        .drop("__hash", "__range", "__within", "__start", "__weight")
    )


def whole(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return ((a - a % b) / b).cast("bigint")


def oracle_sql(weights: Mapping[str, int], block_rows: int = 16) -> str:
    """The same over documents in DuckDB, with earliest deadline first as a recursion over the slots of a period."""
    weights = {REST: 1} | dict(weights)
    total = sum(weights.values())
    rows = ", ".join(f"('{k}', {w})" for k, w in weights.items())
    return f"""
WITH RECURSIVE w(name, weight) AS (VALUES {rows}),
lists AS (SELECT list(name ORDER BY name) AS names, list(weight ORDER BY name) AS weights FROM w),
edf(slot, done, pick) AS (
  SELECT 0, list_transform(range({len(weights)}), lambda x: 0), -1
  UNION ALL
  SELECT slot + 1, list_transform(range({len(weights)}), lambda x: done[x + 1] + CASE WHEN x = best THEN 1 ELSE 0 END), best
  FROM (
    SELECT slot, done, list_sort(list_transform(
        list_filter(range({len(weights)}), lambda x: done[x + 1] < weights[x + 1] AND done[x + 1] * {total} // weights[x + 1] <= slot),
        lambda x: ((done[x + 1] + 1) * {total} + weights[x + 1] - 1) // weights[x + 1] * 1000 + x))[1] % 1000 AS best
    FROM edf, lists WHERE slot < {total})),
plan AS (
  SELECT names[pick + 1] AS name, slot - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth
  FROM edf, lists WHERE slot > 0),
ranked AS (
  SELECT doc_id, name AS mix_source, weight,
    row_number() OVER (PARTITION BY name ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id) - 1 AS mix_row
  FROM (SELECT doc_id, CASE WHEN source IN (SELECT name FROM w WHERE name <> '{REST}') THEN source ELSE '{REST}' END AS name FROM documents) JOIN w USING (name))
SELECT doc_id, mix_source, mix_row, mix_row // {block_rows} AS mix_block,
  (mix_row // {block_rows}) // weight * {total} + place AS mix_slot,
  (mix_row // {block_rows}) * {total} // weight AS mix_release,
  ((mix_row // {block_rows} + 1) * {total} + weight - 1) // weight AS mix_deadline
FROM ranked JOIN plan ON plan.name = mix_source AND plan.nth = (mix_row // {block_rows}) % weight"""
