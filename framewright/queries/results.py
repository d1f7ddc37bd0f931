"""Aggregation of scores, histories and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedules
from ..functions import vectors as V
from ..operators import partials as M
from ..operators import statistics as A
from ..plans import scores as P
from ..registry import query, table


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def e1_count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT w AS label, count(*) AS n FROM (SELECT unnest([lang, source, CASE WHEN n_chars > 1000 THEN 'long' END]) AS w FROM documents) WHERE w IS NOT NULL GROUP BY 1""")
def e2_label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long"))
    return table(spark, sf_dir, "documents").select(F.explode(labels).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) FILTER (WHERE doc_id % 9 = 0) AS val, count(*) FILTER (WHERE doc_id % 9 <> 0) AS train, round(coalesce(count(*) FILTER (WHERE doc_id % 9 = 0) / nullif(count(*), 0), 0), 6) AS ratio FROM documents GROUP BY 1""")
def e3_part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = F.col("doc_id") % 9 == 0
    ratio = F.coalesce(F.try_divide(F.count_if(val), F.count("*")), F.lit(0.0))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(val).alias("val"), F.count_if(~val).alias("train"), F.round(ratio, 6).alias("ratio"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE n_chars > 500) AS passed, round(count(*) FILTER (WHERE n_chars > 500) / greatest(count(*), 1), 6) AS rate FROM documents""")
def e5_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if(F.col("n_chars") > 500)
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), ok.alias("passed"), F.round(ok / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


@query("""SELECT l_returnflag AS dimension, round(sum(l_quantity) / sum(l_linenumber), 6) AS micro, round(avg(l_quantity / l_linenumber), 6) AS macro, round(avg(CASE WHEN l_quantity <> 1 THEN l_quantity END), 6) AS without_missing FROM lineitem GROUP BY 1""")
def e13_micro_macro_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over frames (E10), means over videos (E13), and means without a sentinel."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dimension"), F.col("l_quantity").alias("num"), F.col("l_linenumber").alias("den"))
    a = P.micro(rows).withColumnRenamed("score", "micro")
    b = P.macro(rows.withColumn("score", F.col("num") / F.col("den"))).withColumnRenamed("score", "macro")
    c = P.macro(rows.withColumn("score", F.col("num")), 1.0).withColumnRenamed("score", "without_missing")
    return a.join(b, "dimension").join(c, "dimension").select("dimension", *[F.round(x, 6).alias(x) for x in ("micro", "macro", "without_missing")])


@query("""SELECT p_brand AS dimension, string_split(p_type, ' ')[1] AS video, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1, 2""")
def e21_by_long_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dimension"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("clip"), F.col("p_retailprice").alias("score"))
    return P.by_long_video(clips).select("dimension", "video", F.round("score", 6).alias("score"))


def _dimension_scores(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """One score for each dimension: the mean of part sizes over 50 of the parts with its number; the last has none."""
    numbers = spark.createDataFrame(list(enumerate(names[:-1])), "k int, dimension string")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % len(names)).cast("int").alias("k"), (F.col("p_size") / 50).alias("s"))
    return rows.join(F.broadcast(numbers), "k").groupBy("dimension").agg(F.avg("s").alias("score"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _family_sql(rows, blend) -> str:
    n = len(rows)
    return f"""WITH d(k, dimension, family, weight, low, high) AS (VALUES {_values([(k, *r) for k, r in enumerate(rows)])}),
s AS (SELECT p_partkey % {n} AS k, avg(p_size / 50) AS score FROM part GROUP BY 1 HAVING p_partkey % {n} < {n - 1}),
f AS (SELECT family, sum((coalesce(score, 0) - low) / (high - low) * weight) / sum(weight) AS score FROM d LEFT JOIN s USING (k) GROUP BY family)
SELECT round(CAST(sum(score * w) / sum(w) AS DOUBLE), 6) AS total FROM f JOIN (VALUES {_values(blend.items())}) b(family, w) USING (family)"""


@query(_family_sql(P.VIDEO_DIMENSIONS, P.VIDEO_BLEND))
def e22_final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _dimension_scores(spark, sf_dir, [d[0] for d in P.VIDEO_DIMENSIONS])
    total = P.final_score(P.family_scores(scores, P.dimension_table(spark, P.VIDEO_DIMENSIONS)), P.VIDEO_BLEND)
    return total.select(F.round("total", 6).alias("total"))


@query(_family_sql(P.IMAGE_DIMENSIONS, P.IMAGE_BLEND))
def e23_image_final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _dimension_scores(spark, sf_dir, [d[0] for d in P.IMAGE_DIMENSIONS])
    total = P.final_score(P.family_scores(scores, P.dimension_table(spark, P.IMAGE_DIMENSIONS)), P.IMAGE_BLEND)
    return total.select(F.round("total", 6).alias("total"))


_SECOND = [(d, f) for f, ds in P.SECOND_FAMILIES.items() for d in ds]


@query(f"""WITH d(k, dimension, family) AS (VALUES {_values([(k, *r) for k, r in enumerate(_SECOND)])}), s AS (SELECT p_partkey % {len(_SECOND)} AS k, avg(p_size / 50) AS score FROM part GROUP BY 1 HAVING p_partkey % {len(_SECOND)} < {len(_SECOND) - 1}),
f AS (SELECT family, avg(coalesce(score, 0)) AS score FROM d LEFT JOIN s USING (k) GROUP BY family)
SELECT family, round(score, 6) AS score FROM f UNION ALL SELECT 'total', round(avg(score), 6) FROM f""")
def e24_mean_of_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _dimension_scores(spark, sf_dir, [d for d, _ in _SECOND])
    return P.mean_of_families(scores, P.SECOND_FAMILIES).select("family", F.round("score", 6).alias("score"))


@query("""SELECT c_mktsegment, round(1 - abs(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) - 0.5) * 2, 6) AS two, round(1 - sqrt(pow(avg(CASE WHEN c_nationkey % 3 = 0 THEN 1.0 ELSE 0 END) - 1 / 3, 2) + pow(avg(CASE WHEN c_nationkey % 3 = 1 THEN 1.0 ELSE 0 END) - 1 / 3, 2) + pow(avg(CASE WHEN c_nationkey % 3 = 2 THEN 1.0 ELSE 0 END) - 1 / 3, 2)) / (sqrt(6) / 3), 6) AS three FROM customer GROUP BY 1""")
def e26_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two-class (E26) and three-bin (E27) shares from even ones."""
    rows = table(spark, sf_dir, "customer")
    two = A.two_class_gap(rows, ["c_mktsegment"], F.col("c_acctbal") > 0).withColumnRenamed("score", "two")
    three = A.three_bin_gap(rows, ["c_mktsegment"], F.col("c_nationkey") % 3).withColumnRenamed("score", "three")
    return two.join(three, "c_mktsegment").select("c_mktsegment", F.round("two", 6).alias("two"), F.round("three", 6).alias("three"))


@query("""SELECT label, arg_max(k - 1, m) AS winner FROM (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(k) GROUP BY 1, 2) GROUP BY label""")
def e28_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    return A.vote(rows, ["label"], "e").select("label", F.col("winner").cast("bigint").alias("winner"))


@query("""WITH v AS (SELECT user_id, count(*) FILTER (WHERE value < 10) >= floor(0.5 * count(*)) AS unsafe FROM events GROUP BY 1) SELECT round(count(*) FILTER (WHERE NOT unsafe) / (count(*) * 10), 6) AS score FROM v""")
def e29_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video is unsafe from int(n / 2) unsafe frames on; the divisor is fixed at ten samples a prompt."""
    v = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("value") < 10) >= F.floor(F.count("*") * 0.5)).alias("unsafe"))
    return v.agg(F.round(F.count_if(~F.col("unsafe")) / (F.count("*") * 10), 6).alias("score"))


@query("""SELECT event_type, least(CAST(floor((value - lo) / nullif(hi - lo, 0) * 10) AS INTEGER), 9) AS bin, count(*) AS n FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2""")
def e43_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 10)


@query("""SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) FILTER (WHERE isnan(value)) AS n_nan, count(*) FILTER (WHERE isinf(value)) AS n_inf FROM events GROUP BY 1""")
def e44_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""SELECT o_orderpriority, round(sum(o_totalprice * n) / sum(n), 4) AS loss FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def e46_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").join(n, "o_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.round(A.weighted_mean(F.col("o_totalprice"), F.col("n")), 4).alias("loss"))


@query("""WITH c AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)
SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, count(*) AS n, round(avg(a.x), 6) + 0.0 AS mean_i, round(avg(b.x), 6) + 0.0 AS mean_j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov
FROM c a JOIN c b ON a.label = b.label AND a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def e41_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and covariances of all pairs of components of whole vectors, from blocks of products; no zero is negative."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    return M.moments(rows, ["label"], "e").select("label", "i", "j", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_i", "mean_j", "cov")])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("kind"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")


@query()
def e41_frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fréchet distance between odd and even vectors of each kind; tests hold it against another way to take the root."""
    found = M.frechet_distances(*_halves(spark, sf_dir), ["kind"], "e")
    return found.select("kind", F.round("distance", 6).alias("distance"))


@query()
def e42_heavy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances by name; one has too few vectors and another no features, and both are left out."""
    a, b = _halves(spark, sf_dir)
    short = lambda df: df.select(F.slice("e", 1, 8).alias("e"))
    found = M.heavy_metrics({"fid": (a, b, "e"), "fvd": (short(a), short(b), "e"), "few": (a, b.where("vec_id = 1"), "e"), "none": None})
    return found.select("metric", F.round("value", 6).alias("value"))


@query("""WITH r AS (SELECT l_linenumber % 4 AS t, CAST(l_partkey % 5 AS INTEGER) % 4 AS f, l_returnflag = 'N' AS y, l_discount * 9 + l_tax AS s, l_quantity AS q FROM lineitem),
k AS (SELECT c.k, count(*) FILTER (WHERE t = c.k AND f = c.k) AS hit, count(*) FILTER (WHERE t = c.k OR f = c.k) AS any FROM r, range(4) c(k) GROUP BY 1),
b AS (SELECT CAST(least(greatest(floor(s * 4096), 0), 4095) AS INTEGER) AS bin, count(*) FILTER (WHERE y) AS one, count(*) FILTER (WHERE NOT y) AS zero FROM r GROUP BY 1),
u AS (SELECT one * (coalesce(sum(zero) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + zero / 2) AS w, one, zero FROM b)
SELECT 'size' AS evaluator, 'quantity' AS metric, round(avg(q), 6) AS value FROM r
UNION ALL SELECT 'classes', 'line_accuracy', round(avg(CAST(t = f AS INTEGER)), 6) FROM r
UNION ALL SELECT 'classes', 'line_iou', round(avg(hit / "any") FILTER (WHERE "any" > 0), 6) FROM k
UNION ALL SELECT 'ranking', 'auc', round(sum(w) / (sum(one) * sum(zero)), 6) FROM u
UNION ALL SELECT 'shape', 'pair_norm', round(sqrt(avg(q) * avg(q) + avg(s) * avg(s)), 6) FROM r
UNION ALL SELECT 'shape', 'pair_trace', round(var_samp(q) + var_samp(s), 6) FROM r""")
def l2_evaluators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evaluators over one scan of lineitem."""
    return M.evaluate_all(evaluated_rows(spark, sf_dir), EVALUATORS).withColumn("value", F.round("value", 6))


EVALUATORS = {"size": M.Mean("quantity", "q"), "classes": M.Classes("line", "t", "f", 4), "ranking": M.Ranking("auc", "y", "s"), "shape": M.Gaussian("pair", "pair")}


def evaluated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_linenumber") % 4).alias("t"), (c("l_partkey") % 5 % 4).alias("f"), (c("l_returnflag") == "N").cast("int").alias("y"), (c("l_discount") * 9 + c("l_tax")).alias("s"), c("l_quantity").alias("q"))
    return rows.withColumn("pair", F.array("q", "s"))


@query("""SELECT event_type, round(avg(m), 6) AS score FROM (SELECT event_type, user_id, sum(value * (user_id % 2)) / nullif(sum(user_id % 2), 0) AS m FROM events GROUP BY 1, 2) GROUP BY 1""")
def e40_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("t"), "value", (F.col("user_id") % 2).alias("w"))
    return A.region_mean(rows, ["event_type"], "value", "w").select("event_type", F.round("score", 6).alias("score"))


@query("""SELECT event_type, round(avg(CASE WHEN value > 0 THEN 10 * log10(1 / (value / 1000)) END), 6) AS psnr, round(0.4 * max(value) + 0.3 * avg(value) + 0.3 * min(value), 6) AS blend FROM events GROUP BY 1""")
def e39_psnr_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR (E39) and the blend of maximum, mean and minimum."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(A.psnr(v / 1000), 6).alias("psnr"), F.round(A.blend(F.max(v), F.avg(v), F.min(v)), 6).alias("blend"))


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r <= 3""")
def g2_best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k best checkpoints of each run: the limit is the feature."""
    return P.best_runs(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id", 3, True).select("event_type", "event_id", "value")


@query("""SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100 ELSE 1 END * pow(0.1, CASE WHEN event_id >= 300 THEN 1 ELSE 0 END + CASE WHEN event_id >= 600 THEN 1 ELSE 0 END), 9) AS steps, round((1 + cos(least(event_id / 1000, 1) * pi())) / 2, 9) AS cosine FROM events""")
def j41_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(schedules.warmup(s, 100) * schedules.multi_step(s, [300, 600]), 9).alias("steps"), F.round(schedules.cosine(s, 1000), 9).alias("cosine"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS size FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def j25_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding").cast("array<double>")), 6).alias("size"))
