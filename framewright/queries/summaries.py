"""Rates, blends, rules on sequences and mask rows, over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators import summaries as S
from ..registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("SELECT * FROM (SELECT l_orderkey, round(count_if(l_returnflag = 'N' AND l_linestatus = 'O') / nullif(count_if(l_returnflag = 'N'), 0), 9) AS rate FROM lineitem GROUP BY 1) WHERE rate IS NOT NULL")
def e11_success_where_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return S.success_where_seen(_lines(spark, sf_dir), "l_orderkey", c("l_returnflag") == "N", c("l_linestatus") == "O").withColumn("rate", F.round("rate", 9))


@query("SELECT l_returnflag AS label, round(avg(l_tax), 9) AS mean, count(l_tax) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'total', round(avg(l_tax), 9), count(l_tax) FROM lineitem")
def e16_means_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_returnflag").alias("label"), "l_tax")
    return S.means_with_total(rows, "label", "l_tax").withColumn("mean", F.round("mean", 9))


@query("SELECT l_suppkey, round((avg(l_tax) FILTER (WHERE l_returnflag = 'A') * 2 + avg(l_tax) FILTER (WHERE l_returnflag = 'N') * 1 + avg(l_tax) FILTER (WHERE l_returnflag = 'R') * 0.5) / 3.5, 9) AS score FROM lineitem GROUP BY 1")
def e25_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.blend(_lines(spark, sf_dir), "l_suppkey", "l_returnflag", "l_tax", {"A": 2, "N": 1, "R": 0.5})
    return found.withColumn("score", F.round("score", 9))


@query("""WITH g AS (SELECT CASE WHEN l_linenumber IN (6, 7) THEN 'late' ELSE CAST(l_linenumber AS VARCHAR) END AS place, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS a FROM lineitem GROUP BY 1)
SELECT place, round(a, 9) AS accuracy, round((SELECT avg(a) FROM g), 9) AS macro FROM g""")
def e30_macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.macro_accuracy(_lines(spark, sf_dir).withColumn("place", F.col("l_linenumber").cast("string")), "place", F.col("l_linestatus") == "O", {"6": "late", "7": "late"})
    return found.withColumns({"accuracy": F.round("accuracy", 9), "macro": F.round("macro", 9)})


@query("""WITH r AS (SELECT l_orderkey // 3 AS clip, l_discount * 20 * (l_orderkey % 5) / 4 AS s, row_number() OVER (PARTITION BY l_orderkey // 3 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) <= 2 AS w FROM lineitem),
k AS (SELECT *, round_even(2 * ((count(*) OVER (PARTITION BY clip) - 1) / 16), 0) AS k, 3.0 * (80 / 256.0) AS t FROM r QUALIFY count(*) OVER (PARTITION BY clip) > 2)
SELECT clip, count_if(NOT w AND s > t) <= max(k) AND NOT bool_or(w AND s > t * k * 2) AS static FROM k GROUP BY clip""")
def c20_static_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders are a clip, whose first two rows stand for the pairs that wrap around."""
    c = F.col
    w = Window.partitionBy("clip").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = _lines(spark, sf_dir).withColumn("clip", F.floor(c("l_orderkey") / 3)).withColumns({"at": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("clip"))})
    rows = rows.where("n > 2").select("clip", (c("l_discount") * 20 * (c("l_orderkey") % 5) / 4).alias("s"), (c("at") <= 2).alias("wraps"))
    return S.static_clips(rows, "clip", "s", c("wraps"), F.lit(80.0))


@query("""WITH p AS (SELECT l_orderkey, l_returnflag AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'N' ELSE l_returnflag END AS p FROM lineitem WHERE l_linestatus <> 'F' OR l_returnflag <> 'R'),
c AS (SELECT unnest(['A', 'N']) AS class),
e AS (SELECT class, l_orderkey, coalesce(count_if(t = class AND p = class) / nullif(count_if(t = class OR p = class), 0), 1.0) AS iou FROM p, c WHERE t <> 'R' GROUP BY 1, 2)
SELECT class, round(avg(iou), 9) AS iou FROM e GROUP BY 1""")
def e56_image_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _lines(spark, sf_dir).where((c("l_linestatus") != "F") | (c("l_returnflag") != "R"))
    rows = rows.select("l_orderkey", c("l_returnflag").alias("t"), F.when(c("l_linenumber") % 2 == 0, "N").otherwise(c("l_returnflag")).alias("p"))
    return S.image_iou(rows, "l_orderkey", ["A", "N"], "t", "p", ignored="R").withColumn("iou", F.round("iou", 9))


@query("SELECT l_orderkey, round(avg(abs(l_quantity - l_partkey % 50)), 9) AS error FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1")
def f3_odd_frame_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.odd_frame_error(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", F.col("l_quantity"), F.col("l_partkey") % 50)
    return found.withColumn("error", F.round("error", 9))


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT o_custkey, o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS place FROM r WHERE r = 1)
SELECT o_custkey, o_orderpriority, o_orderkey, place FROM f WHERE n > 1""")
def f19_first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return S.first_frames(rows, "o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS r FROM lineitem)
SELECT l_suppkey, round(median(l_quantity) * (10000000 - max(l_orderkey * 10 + l_linenumber)), 6) AS eta FROM r WHERE r <= 25 GROUP BY 1""")
def f22_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_quantity")
    return S.remaining(rows, "l_suppkey", "at", "l_quantity", 10_000_000, last=25).withColumn("eta", F.round("eta", 6))


@query("SELECT l_linenumber, CAST(sum(l_suppkey) AS BIGINT) AS total, count(*) AS modules, round(sum(l_suppkey) / (SELECT sum(l_suppkey) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1")
def e45_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shares(_lines(spark, sf_dir), "l_linenumber", "l_suppkey").withColumn("share", F.round("share", 9))


@query("SELECT l_partkey % 500 AS x, l_suppkey AS y, round(avg(l_quantity), 9) AS mean, min(l_quantity) AS least FROM lineitem GROUP BY 1, 2")
def e49_merged_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select((F.col("l_partkey") % 500).alias("x"), F.col("l_suppkey").alias("y"), "l_quantity")
    return S.merged_patches(rows, ["x", "y"], "l_quantity").withColumn("mean", F.round("mean", 9))


_PIXELS = "WITH p AS (SELECT l_suppkey AS image, l_partkey % 12 AS x, l_linenumber AS y, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)\n"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _lines(spark, sf_dir).groupBy(c("l_suppkey").alias("image"), (c("l_partkey") % 12).alias("x"), c("l_linenumber").alias("y")).agg(F.max("l_quantity").alias("v"))


@query(_PIXELS + "SELECT a.image, a.x, a.y, max(b.v) AS v FROM p a JOIN p b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3")
def j31_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbourhood(_pixels(spark, sf_dir), ["image"], "x", "y", "v")


@query(_PIXELS + "SELECT a.image, a.x, a.y, min(b.v) AS v FROM p a JOIN p b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3")
def j31_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbourhood(_pixels(spark, sf_dir), ["image"], "x", "y", "v", grow=False)


@query(_PIXELS + "SELECT image, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM p WHERE v > 45 GROUP BY 1")
def j21_tight_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tight_boxes(_pixels(spark, sf_dir), ["image"], "x", "y", F.col("v") > 45)


@query("SELECT l_suppkey, round(median(l_quantity) * 0.299 + median(l_partkey % 256) * 0.587 + median(l_linenumber) * 0.114, 6) AS luma FROM lineitem GROUP BY 1")
def j36_grey_of_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("g", F.col("l_partkey") % 256)
    return S.grey_of_median(rows, ["l_suppkey"], "l_quantity", "g", "l_linenumber").withColumn("luma", F.round("luma", 6))


@query("SELECT o_orderkey, split_part(n, ' and ', 1) AS first, CASE WHEN contains(n, ' and ') THEN split_part(n, ' and ', 2) END AS second FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderpriority || ' and ' || o_orderstatus END AS n FROM orders)")
def j12_two_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")).otherwise(F.concat_ws(" and ", "o_orderpriority", "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.two_names(name).alias("n")).select("o_orderkey", "n.first", "n.second")


@query("SELECT o_orderkey FROM orders WHERE NOT (starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '5'))")
def c25_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(S.outside(F.col("o_orderpriority"), ["1-", "5"])).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS n, o_orderkey % 2 = 0 AS lost FROM orders")
def c16_present_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    scores = F.create_map(F.lit("a"), c("o_custkey"), F.lit("b"), F.when(c("o_orderkey") % 2 == 1, c("o_orderkey")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", S.present_scores(scores).alias("m"))
    return found.select("o_orderkey", F.size("m").alias("n"), (~F.map_contains_key("m", "b")).alias("lost"))


@query("""WITH r AS (SELECT o_orderkey, try_cast(substr(o_orderpriority, 1 + o_orderkey % 2, 1) AS BIGINT) AS value FROM orders)
SELECT o_orderkey, value, CASE WHEN value IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN value IS NULL THEN 'order ' || o_orderkey || ' has no digit there' END AS error FROM r""")
def l9_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.expr("try_cast(substring(o_orderpriority, 1 + cast(o_orderkey % 2 as int), 1) as bigint)")
    said = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" has no digit there"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.or_error(read, said).alias("r")).select("o_orderkey", "r.*")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, chr(CAST(65 + l_linenumber % 3 AS INTEGER)) || (l_partkey % 120) || 'b' || (l_suppkey % 30) AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY lower(left(name, 1)), CAST(regexp_extract(name, '^.([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(name, 'b([0-9]+)$', 1) AS BIGINT), l_linenumber) AS place FROM n""")
def g9_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = F.col
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (c("l_linenumber") % 3 + 1).cast("int"))
    name = F.concat(letter, (c("l_partkey") % 120).cast("string"), F.lit("b"), (c("l_suppkey") % 30).cast("string"))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", name.alias("name"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(natural_key(c("name")), "l_linenumber"))
    return rows.withColumn("place", place)
