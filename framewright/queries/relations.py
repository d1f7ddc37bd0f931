"""Joins, ledgers and set operations over documents, labels, benchmark and TPC-H tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import relate as R
from ..operators import sequences as S
from ..registry import query, table
from ..sources import readers, writers


@query("""SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source""")
def a1_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant reading of JSON lines, last row of each id (A1, F8)."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.to_json(F.struct("source", "doc_id", "n_chars")).alias("value"), "doc_id")
    broken = docs.select(F.lit("{broken").alias("value"), "doc_id").union(docs.select(F.lit("  ").alias("value"), "doc_id")).union(docs.select(F.lit('{"n_chars": 1}').alias("value"), "doc_id"))
    return readers.parse_lines(lines.union(broken), "source string, doc_id bigint, n_chars bigint", ["source"], "doc_id")


@query("""SELECT item_id AS prompt, v AS video, CASE WHEN item_id % 2 = 0 THEN concat('obj', CAST(item_id % 5 AS VARCHAR)) END AS auxiliary
FROM benchmark, (VALUES (0), (1), (2)) t(v) WHERE item_id % 3 <> 1""")
def a15_dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    catalogue = table(spark, sf_dir, "benchmark").select(
        item.alias("prompt_en"), F.when(item % 3 != 1, F.array(F.lit("color"), F.lit("scene"))).otherwise(F.array(F.lit("scene"))).alias("dimension"),
        F.array(*map(F.lit, range(3))).alias("video_list"), F.when(item % 2 == 0, F.create_map(F.lit("color"), F.concat(F.lit("obj"), (item % 5).cast("string")))).otherwise(F.create_map().cast("map<string,string>")).alias("auxiliary_info"),
    )
    return readers.dimension_rows(catalogue, "color")


@query("""SELECT s.r_name AS task, coalesce(max(c.c_acctbal), 0) AS score FROM region s LEFT JOIN nation n ON n.n_regionkey = s.r_regionkey AND n.n_nationkey % 2 = 0 LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY 1""")
def a17_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("task"), F.col("c_acctbal").alias("score"))
    return readers.submission_scores(rows, table(spark, sf_dir, "region").select(F.col("r_name").alias("task")))


@query("""SELECT l_orderkey AS image_id, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_suppkey) - 1 AS INTEGER) AS place, l_discount AS score, l_partkey, l_suppkey FROM lineitem""")
def a22_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole list of each image, in its order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_discount").alias("score"), "l_partkey", "l_suppkey")
    return readers.by_image(rows).select("image_id", "n", F.posexplode("predictions").alias("place", "p")).select("image_id", "n", "place", "p.score", "p.l_partkey", "p.l_suppkey")


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), n_name) AS colour FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 <> 0""")
def d1_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("colour"))
    more = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("colour"))
    return R.enrich(own, more, "key", "colour").select("c_custkey", "colour")


@query("""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND doc_id % 10 <> 3""")
def d2_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return R.pending(docs, "doc_id", table(spark, sf_dir, "labels"), docs.where("doc_id % 10 = 3")).select("doc_id", "lang")


@query("""SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def d3_left_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return readers.with_defaults(both, {"quality": -1})


@query("""SELECT b.item_id, i.i, concat(CAST(b.item_id AS VARCHAR), '-', CAST(i.i AS VARCHAR), '.mp4') AS name, i.i < b.item_id % 6 AS there FROM benchmark b, (VALUES (0), (1), (2), (3), (4)) i(i)""")
def d4_expected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected sample files of prompts, and which of them a listing has."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("prompt"), "item_id")
    want = R.expected_samples(items, "prompt", 5).withColumn("item_id", F.col("prompt").cast("bigint"))
    files = want.where("i < item_id % 6").select("name").withColumn("there", F.lit(True))
    return want.join(files, "name", "left").select("item_id", "i", "name", F.coalesce("there", F.lit(False)).alias("there"))


@query("""SELECT d.doc_id, p.prompt FROM documents d JOIN (SELECT DISTINCT left(text, 3) AS prompt FROM documents WHERE doc_id % 20 = 0 UNION SELECT DISTINCT left(text, 5) FROM documents WHERE doc_id % 20 = 1) p ON starts_with(d.text, p.prompt) WHERE p.prompt <> ''""")
def d6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prompts = docs.where("doc_id % 20 = 0").select(F.expr("left(text, 3)").alias("prompt")).union(docs.where("doc_id % 20 = 1").select(F.expr("left(text, 5)").alias("prompt"))).where("prompt <> ''")
    return R.prefix_join(docs, "text", prompts, "prompt").select("doc_id", "prompt")


@query("""SELECT a.k, a.item_id, b.page_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) a JOIN (SELECT page_id, row_number() OVER (ORDER BY page_id) AS k FROM pages) b USING (k)""")
def d7_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "benchmark").select("item_id"), table(spark, sf_dir, "pages").select("page_id")
    return R.zip_in_order(left, ["item_id"], right, ["page_id"]).select("k", "item_id", "page_id")


@query("""SELECT label, round(avg(d), 6) AS distance, count(*) AS pairs FROM (
  SELECT a.label, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS d
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) GROUP BY label""")
def d12_pair_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean L1 distance of all pairs of a prompt's samples, from sorted components."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    n = F.col("n")
    return R.pair_distance(rows, ["label"], "e").select("label", F.round("distance", 6).alias("distance"), (n * (n - 1) / 2).cast("bigint").alias("pairs"))


@query("""WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT label, vec_id, k, list_transform(range(9), lambda i: list_dot_product(e[12 * k + 4 * (i // 3) + 1 : 12 * k + 4 * (i // 3) + 4], e[12 * k + 4 * (i % 3) + 1 : 12 * k + 4 * (i % 3) + 4]) / 12) AS g FROM v, range(5) t(k)),
c AS (SELECT a.label, avg(list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))) / 64) AS content FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
s AS (SELECT a.label, 1000 * avg(list_sum(list_transform(range(1, 10), lambda i: abs(a.g[i] - b.g[i]))) / 9) AS style FROM g a JOIN g b ON a.label = b.label AND a.k = b.k AND a.vec_id < b.vec_id GROUP BY 1)
SELECT label, round(content, 6) AS content, round(style, 6) AS style, round(least(greatest((content + style) / 2 / 17.712, 0), 1), 6) AS score FROM c JOIN s USING (label)""")
def e50_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content is the whole vector; a style layer the Gram matrix of three channels of four places of it."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    channels = lambda k: F.array(*[F.slice("e", 12 * k + 4 * i + 1, 4) for i in range(3)])
    layers = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), V.gram(channels(k)).alias("e")) for k in range(5)])).alias("x")
    out = R.diversity(rows, rows.select("label", layers).select("label", "x.layer", "x.e"), ["label"], "layer", "e")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("content", "style", "score")])


@query("""SELECT event_id, round(CASE WHEN value <= 0 THEN 0 WHEN value >= 100 THEN 1 WHEN value < 10 THEN value / 10 * 0.5 WHEN value < 50 THEN 0.5 + (value - 10) / 40 * 0.3 ELSE 0.8 + (value - 50) / 50 * 0.2 END, 6) AS y FROM events""")
def d14_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(0.0, 0.0), (10.0, 0.5), (50.0, 0.8), (100.0, 1.0)], "key double, mapped double")
    return R.interpolate(table(spark, sf_dir, "events").select("event_id", "value"), "value", mapping).select("event_id", F.round("y", 6).alias("y"))


@query("""SELECT i.source, round(CASE WHEN coalesce(a.score, 0) = 0 THEN i.score ELSE 0.7 * i.score + 0.3 * a.score END, 6) AS score
FROM (SELECT source, avg(n_chars) AS score FROM documents GROUP BY 1) i LEFT JOIN (SELECT source, avg(n_chars) AS score FROM documents WHERE lang = 'de' AND source <> 'src1' GROUP BY 1) a USING (source)""")
def d15_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    inner = docs.groupBy("source").agg(F.avg("n_chars").alias("score"))
    across = docs.where("lang = 'de' and source <> 'src1'").groupBy("source").agg(F.avg("n_chars").alias("score"))
    return R.fuse(inner, across, "source", 0.7).select("source", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(c.centre AS DOUBLE[])), 6) AS similarity FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS centre FROM embeddings GROUP BY label) c USING (label)""")
def d20_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    texts = rows.groupBy("label").agg(F.min_by("e", "vec_id").alias("c"))
    return rows.join(texts, "label").select("vec_id", F.round(V.dot(F.col("e"), F.col("c")), 6).alias("similarity"))


@query("""SELECT doc_id, arg_max(h, s) AS best FROM (SELECT doc_id, h, length(text) - length(replace(text, h, '')) + CASE h WHEN 'on' THEN 0.2 WHEN 'er' THEN 0.1 ELSE 0 END AS s FROM documents, (VALUES ('th'), ('er'), ('on')) t(h)) GROUP BY doc_id""")
def d21_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every caption with a small fixed table of hypotheses, the best of each."""
    words = spark.createDataFrame([("th", 0.0), ("er", 0.1), ("on", 0.2)], "h string, tie double")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(words))
    hits = F.length("text") - F.length(F.replace("text", F.col("h"), F.lit(""))) + F.col("tie")
    return rows.groupBy("doc_id").agg(F.max_by("h", hits).alias("best"))


@query("""SELECT p_brand, p_type, i, concat(left(p_name, 10), '-', CAST(i AS VARCHAR)) AS file FROM part, (VALUES (0), (1), (2)) t(i) WHERE p_partkey % 10 = 0 OR i = 0""")
def d25_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return rows.where("p_partkey % 10 = 0 or i = 0").select("p_brand", "p_type", "i", F.concat(F.expr("left(p_name, 10)"), F.lit("-"), F.col("i").cast("string")).alias("file"))


@query("""SELECT n_nationkey AS id FROM nation UNION SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer""")
def h1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("nation", "n_nationkey"), ("supplier", "s_nationkey"), ("customer", "c_nationkey"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query("""SELECT 'a' AS dataset, CAST(0 AS BIGINT) AS "offset", count(*) AS n FROM region UNION ALL SELECT 'b', 5, count(*) FROM nation UNION ALL SELECT 'c', 30, count(*) FROM supplier""")
def h2_union_all_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {k: table(spark, sf_dir, t).select(F.col(c).alias("id")) for k, t, c in (("a", "region", "r_regionkey"), ("b", "nation", "n_nationkey"), ("c", "supplier", "s_suppkey"))}
    return R.union_all(parts).groupBy("dataset", "offset").agg(F.count("*").alias("n"))


@query("""SELECT s_nationkey AS id FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0""")
def h3_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")).intersect(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def h4_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("""SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source""")
def h5_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_distinct(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""SELECT count(*) FILTER (WHERE d.source IS NOT NULL AND e.source IS NOT NULL) AS "both", count(*) FILTER (WHERE e.source IS NULL) AS left_only, count(*) FILTER (WHERE d.source IS NULL) AS right_only
FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0) d FULL JOIN (SELECT DISTINCT source FROM documents WHERE source < 'src5') e USING (source)""")
def e4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return R.coverage(docs.where("doc_id % 3 = 0"), docs.where("source < 'src5'"), "source")


@query("""SELECT run, sum(best) AS best FROM (SELECT o_custkey AS run, max(o_totalprice) AS best FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, -1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 1)) GROUP BY run""")
def b8_manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_totalprice")
    old = orders.select("run").distinct().withColumn("best", F.lit(-1.0))
    return writers.upsert(old, orders.where("run % 2 = 0").groupBy("run").agg(F.max("o_totalprice").alias("best")), "run")


@query("""SELECT l_returnflag AS class, printf('%s %.3f %.1f %.1f %.1f %.1f', CAST(l_orderkey AS VARCHAR), l_discount, CAST(l_partkey % 50 + 1 AS DOUBLE), CAST(l_suppkey % 50 + 1 AS DOUBLE), l_partkey % 50 + l_quantity, CAST(l_suppkey % 50 + 1 + l_linenumber * 5 AS DOUBLE)) AS value FROM lineitem""")
def b12_detection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boxes import detections

    return writers.detection_lines(detections(spark, sf_dir).select(F.col("image"), F.col("class"), F.col("l_discount").alias("score"), "box"))


@query("""SELECT url AS path, concat(host, '-', CAST(row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS VARCHAR), '.mp4') AS target FROM (SELECT DISTINCT url, string_split(url, '/')[3] AS host FROM pages)""")
def b15_renamed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("url", F.split("url", "/")[2].alias("host")).distinct()
    return writers.renamed_samples(files, "host", "url")


@query("""SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS k FROM documents""")
def g9_dense_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dense_number(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], "k").select("doc_id", "k")
