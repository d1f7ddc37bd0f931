"""Sequences: features of frames (embeddings by label and vec_id), scalar histories (events), answers (conversations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import sequences as S
from ..registry import query, table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("emb"))


_CONSISTENCY = """WITH f AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT label, e, lag(e) OVER s AS p, first_value(e) OVER s AS q FROM f WINDOW s AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT label, count(*) AS n, sum((greatest(list_cosine_similarity(e, p), 0) + greatest(list_cosine_similarity(e, q), 0)) / 2) AS total FROM w WHERE p IS NOT NULL GROUP BY label)
"""


@query(_CONSISTENCY + "SELECT label AS clip_id, n, round(total, 6) AS total FROM c")
def f1_frame_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_consistency(frames(spark, sf_dir)).select("clip_id", "n", F.round("total", 6).alias("total"))


@query(_CONSISTENCY + "SELECT round(sum(total) / sum(n), 6) AS micro, round(avg(total / n), 6) AS macro FROM c")
def e8_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over frames (E8) and over videos."""
    both = S.micro_macro(S.frame_consistency(frames(spark, sf_dir)))
    return both.select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("""SELECT event_type, round((255 - avg(d)) / 255, 6) AS score FROM (SELECT event_type, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS d FROM events) GROUP BY event_type""")
def f2_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flicker(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_type", F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT label, vec_id, CAST(embedding[1] > 0 AS INTEGER) AS bit, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT b.vec_id, CASE WHEN 2 * sum(o.bit) > 5 THEN 1 ELSE 0 END AS voted
FROM b, (VALUES (-2), (-1), (0), (1), (2)) d(d), b o WHERE o.label = b.label AND o.at = least(greatest(b.at + d.d, 0), b.n - 1) GROUP BY b.vec_id""")
def f4_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("embedding")[0] > 0).cast("int").alias("bit"))
    return S.majority(bits, "label", "vec_id", "bit", 5).select("vec_id", "voted")


@query("""SELECT event_id, round(median(value) OVER w, 6) AS median, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def f14_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.smoothed(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", 20)
    return rows.select("event_id", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, n, least(n, 4) AS c, unnest(range(4)) AS k FROM p),
b AS (SELECT *, floor(least(k, c - 1) * (n / c)) AS low, CASE WHEN least(k, c - 1) + 1 = c THEN n ELSE floor((least(k, c - 1) + 1) * (n / c)) END AS high FROM k)
SELECT b.user_id, b.k, p.event_id FROM b JOIN p ON p.user_id = b.user_id AND p.at = floor((b.low + b.high - 1) / 2)""")
def f16_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subsample_middle(table(spark, sf_dir, "events"), "user_id", "event_id", 4)


@query("""WITH p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
c AS (SELECT label, n, unnest(range(greatest(n // 16, 1) + CASE WHEN n > 16 * greatest(n // 16, 1) THEN 1 ELSE 0 END)) AS clip FROM (SELECT DISTINCT label, n FROM p))
SELECT c.label, c.clip, p.vec_id FROM c JOIN p USING (label) WHERE p.at >= greatest(least(c.clip * 16, c.n - 16), 0) AND p.at < greatest(least(c.clip * 16, c.n - 16), 0) + 16""")
def f17_clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clip_windows(table(spark, sf_dir, "embeddings"), "label", "vec_id", 16)


@query("""SELECT user_id, segment, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS segment FROM events) GROUP BY 1, 2""")
def f18_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return rows.groupBy("user_id", "segment").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH f AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), w AS (SELECT label, list_cosine_similarity(e, first_value(e) OVER (PARTITION BY label ORDER BY vec_id)) >= 0.4 AS near FROM f)
SELECT label AS clip_id, CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (WHERE near) / count(*), 6) END AS share FROM w GROUP BY label""")
def f20_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.identity_share(frames(spark, sf_dir), "clip_id", "t", "emb").select("clip_id", F.round("share", 6).alias("share"))


@query("""WITH p AS (SELECT event_type AS c, event_id, value, lead(value) OVER (PARTITION BY event_type ORDER BY event_id) AS b, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS nx FROM events),
e AS (SELECT event_type AS c, max(event_id) AS event_id, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM events GROUP BY 1)
SELECT c AS event_type, count(*) AS pairs, round(sum(d), 4) AS moved FROM (SELECT c, abs(value - b) AS d FROM p WHERE nx IS NOT NULL UNION ALL SELECT c, abs(f - l) FROM e UNION ALL SELECT c, abs(l - f) FROM e) GROUP BY c""")
def f15_pairs_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.pairs_in_order(table(spark, sf_dir, "events"), "event_type", "event_id", "value", wrap=True)
    return pairs.groupBy("event_type").agg(F.count("*").alias("pairs"), F.round(F.sum(F.abs(F.col("a") - F.col("b"))), 4).alias("moved"))


@query("""SELECT user_id, count(*) FILTER (WHERE abs(value - b) > 30) >= round_even((count(*) + 1) * 4 / 16, 0) AS moving FROM (SELECT user_id, value, lead(value) OVER w AS b, lead(event_id) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE nx IS NOT NULL GROUP BY 1""")
def c19_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.pairs_in_order(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return S.moves(pairs, "user_id", F.abs(F.col("a") - F.col("b")), 30)


@query("""SELECT conv_id, round(coalesce(min(CASE WHEN NOT yes THEN k END), count(*)) / count(*), 6) AS score FROM (SELECT conv_id, contains(text, 'th') AS yes, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY conv_id""")
def e20_prefix_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("yes", F.contains("text", F.lit("th")))
    return S.prefix_success(rows, ["conv_id"], "turn", "yes").select("conv_id", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, CASE WHEN bool_or(yes) FILTER (WHERE k = 1) THEN CASE WHEN coalesce(bool_and(yes) FILTER (WHERE k > 1), true) THEN 1.0 ELSE 0.0 END END AS score, bool_and(yes) AS all_yes FROM (SELECT conv_id, contains(text, 'th') AS yes, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id""")
def e19_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate question first (E19), and all questions alike."""
    rows = table(spark, sf_dir, "conversations").withColumn("yes", F.contains("text", F.lit("th")))
    return S.gated(rows, ["conv_id"], "turn", "yes").join(rows.groupBy("conv_id").agg(F.bool_and("yes").alias("all_yes")), "conv_id")


@query("""SELECT event_type, round(avg(value) FILTER (WHERE r <= floor(n * 0.05)), 6) AS score FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def e14_top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_fraction_mean(table(spark, sf_dir, "events"), ["event_type"], "value", 0.05).select("event_type", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(row_number() OVER (ORDER BY x) / (count(*) OVER () + 1), 9) AS q FROM (SELECT vec_id, CAST(vec_id AS DOUBLE) * 7 % 501 + vec_id / 10000.0 AS x FROM embeddings)""")
def f9_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id").cast("double") * 7) % 501 + F.col("vec_id") / 10000.0).alias("x"))
    return S.quantile_map(rows, "x").join(rows, "x").select("vec_id", F.round("q", 9).alias("q"))


@query("""WITH b AS (SELECT label, vec_id, CAST(embedding[1] > 0 AS INTEGER) AS bit, lag(CAST(embedding[1] > 0 AS INTEGER)) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
r AS (SELECT label, bit, sum(CASE WHEN bit <> p THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS run FROM b), c AS (SELECT label, run, min(bit) AS bit, count(*) AS n FROM r GROUP BY 1, 2)
SELECT label, array_to_string(CASE WHEN arg_min(bit, run) = 1 THEN list_prepend(0, list(n ORDER BY run)) ELSE list(n ORDER BY run) END, ',') AS counts FROM c GROUP BY label""")
def j32_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("embedding")[0] > 0).cast("int").alias("bit"))
    return S.run_lengths(bits, "label", "vec_id", "bit").select("label", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r <= 5""")
def f13_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit per group is the feature."""
    return S.first_n(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey")


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w), 9) AS p, CAST(arg_max(i, x) OVER w AS INTEGER) AS best FROM v WINDOW w AS (PARTITION BY vec_id)""")
def j26_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of whole vectors, and the place of the largest."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.softmax(v)).alias("i", "p"), V.argmax(v).cast("int").alias("best"))
    return rows.withColumn("p", F.round("p", 9))
