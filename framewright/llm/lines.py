"""Operator 5, line dedup: hashed lines are range-partitioned, streamed in (document, position) order, and answered by
run-length compressed keep bitmaps instead of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut, hot_from

#: Ranges that a line found in many documents is spread over.
SALTS = 64


def line_rows(docs: DataFrame, text: str, doc: Column, min_chars: int) -> DataFrame:
    """(doc, pos, h1, h2) of every line whose key has min_chars code points at least; the key is hashed to 96 bits."""
    lines = docs.select(doc.alias("doc"), F.posexplode(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(WHITE))
    return (
        lines.select("doc", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    )


def drop_bitmaps(docs: DataFrame, text: str, doc: Column, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, runs, n_dropped) of every document that loses a line; runs is array<struct<gap int, len int>>.

    A run is gap kept lines followed by len dropped ones; lines after the last run stay. Keys in min_docs documents
    or more lose all lines, or with keep_first all but their first in (doc, pos) order. doc identifies a document:
    rows with equal doc count as one.

    The line rows are partitioned by ranges of (hash, salt), where the salt follows from the document, and sorted by
    document and position, so that one pass over a range sees each document of a key once, next to each other; a key
    with many documents is spread over SALTS ranges and the partial counts are added up afterwards. They are written once,
    so that no line is split or hashed twice.
    """
    rows = cut(line_rows(docs, text, doc, min_chars).withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos")
    again = F.lag("doc").over(stream).eqNullSafe(F.col("doc")) & F.lag("pos").over(stream).isNotNull()
    keys = cut(
        ranged.withColumn("again", F.coalesce(again, F.lit(False)))
        .where("not again")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct("doc", "pos")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "n_docs", *(["first"] if keep_first else []))
    )
    # Rows of hot keys, whose number hot_from bounds, are found where they are; only those of other keys are dealt by key.
    hot = F.col("n_docs") >= hot_from(rows.count())
    often, seldom = F.broadcast(keys.where(hot).drop("n_docs")), keys.where(~hot).drop("n_docs")
    key = ["h1", "h2"]
    gone = rows.join(often, key).unionByName(rows.join(often.select(*key), key, "left_anti").join(seldom, key))
    if keep_first:
        gone = gone.where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    gone = gone.select("doc", "pos").distinct()
    order = Window.partitionBy("doc").orderBy("pos")
    return (
        gone.withColumn("island", F.col("pos") - F.row_number().over(order))
        .groupBy("doc", "island")
        .agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
        .withColumn("gap", F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("len")).over(Window.partitionBy("doc").orderBy("start")), F.lit(0)))
        .groupBy("doc")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "gap", "len"))), lambda r: F.struct(r["gap"].alias("gap"), r["len"].alias("len"))).alias("runs"), F.sum("len").alias("n_dropped"))
    )


def apply_bitmap(text: Column, runs: Column) -> Column:
    """The text without the lines that the runs drop; null runs keep all."""
    keep = F.flatten(F.transform(runs, lambda r: F.concat(F.array_repeat(F.lit(True), r["gap"]), F.array_repeat(F.lit(False), r["len"]))))
    lines = F.split(text, "\n")
    return F.when(runs.isNull(), text).otherwise(
        F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("l"), keep.alias("k")), lambda x: F.coalesce(x["k"], F.lit(True))), lambda x: x["l"]), "\n")
    )


def dedup_lines(docs: DataFrame, key: str, text: str, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Adds runs (null: nothing dropped), n_lines, n_dropped and kept_text to every row of docs.

    A null or empty text is one empty line. A document is a (key, text) pair: repeated rows count once and lose the
    same lines; rows that share a key but not the text, or have a null key, are told apart by the text's hash. Lines
    of any length count whole. An empty table stays empty. Columns of docs named like the new ones are replaced.
    """
    new = ["runs", "n_lines", "n_dropped", "kept_text"]
    doc = F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    maps = drop_bitmaps(docs, text, doc, min_docs, min_chars, keep_first).select(F.coalesce(F.col("doc.key").cast("string"), F.lit("")).alias("__k"), F.col("doc.text").alias("__t"), F.col("doc.key").isNull().alias("__n"), "runs", "n_dropped")
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.drop(*new)
        .withColumns({"__k": F.coalesce(F.col(key).cast("string"), F.lit("")), "__t": F.xxhash64(whole), "__n": F.col(key).isNull()})
        .join(maps, ["__k", "__t", "__n"], "left")
        .withColumns(
            {
                "n_lines": F.size(F.split(whole, "\n")).cast("bigint"),
                "n_dropped": F.coalesce(F.col("n_dropped"), F.lit(0)).cast("bigint"),
                "kept_text": apply_bitmap(whole, F.col("runs")),
            }
        )
        .drop("__k", "__t", "__n")
    )


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY doc_id"""
