"""Splits and samples, exact in SQL because draws are md5 digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as S
from ..registry import query, table

_DRAW = "md5(concat('42:', CAST({} AS VARCHAR)))"


@query(f"SELECT doc_id FROM documents ORDER BY {_DRAW.format('doc_id')} LIMIT 50")
def g1_top_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of drawn rows: the limit is the feature."""
    return S.top_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_DRAW.format('doc_id')}) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'val' ELSE 'train' END AS side FROM documents")
def f12_split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_random(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format('doc_id')}) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.1)) THEN 'val' ELSE 'train' END AS side FROM documents")
def f11_split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1).drop("lang")


_GROUPS = f"""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY {_DRAW.format('o_custkey')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT greatest(1, floor(count(*) * 0.1)) FROM orders) AS val FROM g)
"""


@query(_GROUPS + "SELECT o_orderkey, CASE WHEN val THEN 'val' ELSE 'train' END AS side FROM orders JOIN s USING (o_custkey)")
def f10_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_groups(table(spark, sf_dir, "orders"), F.col("o_custkey"), 0.1).select("o_orderkey", "side")


@query(_GROUPS + f""", r AS (SELECT o_custkey, row_number() OVER (ORDER BY {_DRAW.format('o_orderkey')}) <= greatest(1, floor(count(*) OVER () * 0.1)) AS val FROM orders),
l AS (SELECT o_custkey FROM r GROUP BY 1 HAVING bool_or(val) AND bool_or(NOT val))
SELECT 'by group' AS split, CAST(0 AS BIGINT) AS leaks, count(*) FILTER (WHERE val) AS val, count(*) FILTER (WHERE NOT val) AS train FROM s
UNION ALL SELECT 'by row', (SELECT count(*) FROM l), count(DISTINCT o_custkey) FILTER (WHERE val), count(DISTINCT o_custkey) FILTER (WHERE NOT val) FROM r""")
def e4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on both sides of a split by customer, and of one by order, with the customers of each side."""
    orders = table(spark, sf_dir, "orders")
    out = None
    for name, rows in (("by group", S.split_groups(orders, F.col("o_custkey"), 0.1)), ("by row", S.split_random(orders, "o_orderkey", 0.1))):
        sides = rows.agg(*[F.count_distinct(F.when(F.col("side") == s, F.col("o_custkey"))).alias(s) for s in ("val", "train")])
        one = S.leaks(rows, F.col("o_custkey")).crossJoin(F.broadcast(sides)).withColumn("split", F.lit(name))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("split", "leaks", "val", "train")


_RANKED = f"SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_DRAW.format('c_custkey')}) AS r FROM customer"


@query(f"""WITH x AS ({_RANKED}), f AS (SELECT * FROM x WHERE r <= 20), s AS (SELECT *, row_number() OVER (ORDER BY {_DRAW.format('c_custkey')}) AS k FROM x WHERE r > 20)
SELECT c_custkey, c_mktsegment FROM f UNION ALL SELECT c_custkey, c_mktsegment FROM s WHERE k <= 104 - (SELECT count(*) FROM f)""")
def i1_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal numbers of each bucket, filled up from the rest: the size is the feature."""
    return S.balanced(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 104, 5)


@query("""WITH l AS (SELECT doc_id, unnest([CASE WHEN doc_id % 2 = 0 THEN 'even' END, CASE WHEN doc_id % 3 = 0 THEN 'three' END, CASE WHEN doc_id % 7 = 0 THEN 'seven' END]) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM l WHERE w IS NOT NULL GROUP BY 1)
SELECT d.doc_id, coalesce(b.w, 'other') AS bucket FROM documents d LEFT JOIN (SELECT doc_id, arg_min(w, n) AS w FROM l JOIN c USING (w) GROUP BY 1) b USING (doc_id)""")
def i2_rarest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    labels = F.array(F.when(d % 2 == 0, "even"), F.when(d % 3 == 0, "three"), F.when(d % 7 == 0, "seven"))
    return S.rarest_bucket(table(spark, sf_dir, "documents").select("doc_id", F.explode(labels).alias("w")), "doc_id", "w")


@query(f"""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY {_DRAW.format('s_suppkey')}) - 1 AS k FROM supplier), n AS (SELECT count(*) AS n FROM supplier),
a AS (SELECT CAST('0x' || substr(md5(concat('42:again:', CAST(i AS VARCHAR))), 1, 12) AS BIGINT) % n AS k FROM n, range(0, 25) t(i))
SELECT s_suppkey, 0 AS pass FROM r UNION ALL SELECT s_suppkey, 1 FROM a JOIN r USING (k)""")
def i3_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows more than there are: all once, then drawn again."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = rows.count()
    return S.quota(rows, "s_suppkey", n, n + 25)


@query("""SELECT c_custkey, pos FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) WHERE pos < n - n % 7 AND pos % 7 = 2""")
def i4_rank_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return S.rank_slice(rows, ["c_custkey"], 7, 2, rows.count())


@query(f"""WITH x AS (SELECT o_custkey, o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders), y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, label ORDER BY {_DRAW.format('o_orderkey')}) AS r, least(count(*) FILTER (WHERE label = 1) OVER (PARTITION BY o_custkey), 2) AS p FROM x)
SELECT o_custkey, o_orderkey, label FROM y WHERE CASE WHEN label = 1 THEN r <= 2 ELSE r <= 6 - p END""")
def i6_signed_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return S.signed_subsample(rows, ["o_custkey"], "label", "o_orderkey", 6, 0.4)


@query("""WITH x AS (SELECT user_id, event_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, sum(CAST(value > 50 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id FROM x WHERE t <= 8 AND ok AND n <= 3""")
def i7_accept_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return S.accept_up_to(rows, ["user_id"], [F.col("event_id")], F.col("value") > 50, 8, 3).drop("value")


@query(f"""SELECT doc_id, CASE WHEN u < 0.2 THEN 'mask' WHEN u < 0.2 + 0.5 THEN 'swap' ELSE 'keep' END AS branch FROM (SELECT doc_id, CAST('0x' || substr({_DRAW.format('doc_id')}, 1, 8) AS BIGINT) / 4294967296 AS u FROM documents)""")
def i8_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.branch("doc_id", {"mask": 0.2, "swap": 0.5, "keep": 0.3}).alias("branch"))
