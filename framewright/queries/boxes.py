"""Detection and segmentation over boxes derived from lineitem, and classes from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection as D
from ..operators import tracking as K
from ..registry import query, table


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, id, class, score, box of every line item."""
    c = F.col
    b = G.from_xywh(c("l_partkey") % 50, c("l_suppkey") % 50, c("l_quantity"), c("l_linenumber") * 5 + 1)
    rank = F.row_number().over(Window.partitionBy("image").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"))
    score = F.round(c("l_discount") * 10 + c("l_tax"), 6)
    # Numbered by image before all else, so that Spark knows that the boxes of an image are together, and moves no more than it must.
    numbered = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image").withColumn("id", rank)
    return numbered.select("image", "id", c("l_returnflag").alias("class"), score.alias("score"), b.struct().alias("box"), "l_discount")


_BOXES = """WITH b AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag) AS id, l_returnflag AS class, round(l_discount * 10 + l_tax, 6) AS score,
  CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(l_suppkey % 50 AS DOUBLE) AS y0, l_partkey % 50 + l_quantity AS x1, CAST(l_suppkey % 50 + l_linenumber * 5 + 1 AS DOUBLE) AS y1 FROM lineitem),
p AS (SELECT *, i / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - i) AS iou FROM (
  SELECT a.image, a.id AS l, b.id AS r, a.class AS ca, b.class AS cb, a.score AS score, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i
  FROM b a JOIN b b ON a.image = b.image AND a.id % 2 = 1 AND b.id % 2 = 0))
"""


@query(_BOXES + "SELECT image, l, r, round(iou, 6) AS iou FROM p")
def d10_pairwise_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of odd ids with those of even ids of the same image."""
    d = detections(spark, sf_dir)
    return D.iou_pairs(d.where("id % 2 = 1"), d.where("id % 2 = 0"), ["image"], "id").select("image", "l", "r", F.round("iou", 6).alias("iou"))


@query(_BOXES + """, best AS (SELECT *, row_number() OVER (PARTITION BY image, l ORDER BY iou DESC, r) AS k, max(iou) OVER (PARTITION BY image, r) AS most FROM p),
s AS (SELECT DISTINCT image, l FROM best WHERE iou = most AND iou > 0)
SELECT best.image, best.l, best.r, CASE WHEN s.l IS NOT NULL THEN 1 WHEN iou >= 0.5 THEN 1 WHEN iou < 0.3 THEN 0 ELSE -1 END AS label FROM best LEFT JOIN s ON s.image = best.image AND s.l = best.l WHERE k = 1""")
def d16_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    pairs = D.iou_pairs(d.where("id % 2 = 1"), d.where("id % 2 = 0"), ["image"], "id")
    return D.assign(pairs, ["image"], 0.3, 0.5).select("image", "l", "r", "label")


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Odd ids are detections, even ids objects, of which every seventh is difficult; matched at 0.3 within a class."""
    d = detections(spark, sf_dir)
    truth = d.where("id % 2 = 0").select("image", "id", "box", "class", (F.col("id") % 7 == 0).alias("difficult"))
    found = D.match_greedy(d.where("id % 2 = 1").select("image", "id", "box", "class", "score"), truth, ["image", "class"], 0.3, [F.desc("score"), F.col("id")])
    return found, truth


#: Overlaps within a class, of boxes that hold the pixels of both their corners.
_SAME = """, u AS (SELECT image, l, r, j / ((ax1 - ax0 + 1) * (ay1 - ay0 + 1) + (bx1 - bx0 + 1) * (by1 - by0 + 1) - j) AS iou FROM (
  SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0) + 1, 0) * greatest(least(ay1, by1) - greatest(ay0, by0) + 1, 0) AS j FROM p WHERE ca = cb)),
best AS (SELECT image, l, r, iou FROM (SELECT *, row_number() OVER (PARTITION BY image, l ORDER BY iou DESC, r) AS k FROM u) WHERE k = 1)"""
_MATCH = _BOXES + _SAME + """,
d AS (SELECT b.image, b.id, b.class, b.score, best.r, coalesce(best.iou > 0.3, false) AS near, coalesce(best.r % 7 = 0, false) AS hard FROM b LEFT JOIN best ON best.image = b.image AND best.l = b.id WHERE b.id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY image, CASE WHEN near THEN r END ORDER BY score DESC, id) AS k FROM d),
m AS (SELECT image, id, class, score, CASE WHEN near AND NOT hard AND k = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN NOT near OR (NOT hard AND k > 1) THEN 1 ELSE 0 END AS fp FROM k)
"""


@query(_MATCH + "SELECT image, id, tp, fp FROM m")
def d17_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)[0].select("image", "id", "tp", "fp")


@query(_MATCH + """, n AS (SELECT class, count(*) AS n FROM b WHERE id % 2 = 0 AND id % 7 <> 0 GROUP BY 1),
c AS (SELECT m.class, row_number() OVER w AS k, sum(tp) OVER w / n.n AS recall, coalesce(sum(tp) OVER w / nullif(sum(tp) OVER w + sum(fp) OVER w, 0), 0) AS prec FROM m JOIN n USING (class) WINDOW w AS (PARTITION BY m.class ORDER BY score DESC, image, id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT class, k, recall, max(prec) OVER (PARTITION BY class ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS env, coalesce(lag(recall) OVER (PARTITION BY class ORDER BY k), 0) AS bef FROM c)
SELECT class, round(sum((recall - bef) * env), 6) AS ap FROM e GROUP BY class""")
def e35_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running precision and recall (F5), envelope and area."""
    found, truth = matched(spark, sf_dir)
    positives = truth.where("not difficult").groupBy("class").agg(F.count("*").alias("n"))
    rows = found.select("class", "score", "image", "id", "tp", "fp").join(F.broadcast(positives), "class")
    curve = D.precision_recall(rows, ["class"], [F.desc("score"), F.col("image"), F.col("id")], F.col("n"))
    return D.average_precision(curve, ["class"]).select("class", F.round("ap", 6).alias("ap"))


@query(_BOXES + ", best AS (SELECT image, r, max(iou) AS iou FROM p GROUP BY 1, 2) SELECT t AS threshold, round(count(*) FILTER (WHERE iou >= t) / (SELECT count(*) FROM b WHERE id % 2 = 0), 6) AS recall FROM best, (VALUES (0.1), (0.3), (0.5), (0.7)) v(t) GROUP BY t")
def e37_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    best = D.iou_pairs(d.where("id % 2 = 1"), d.where("id % 2 = 0"), ["image"], "id").groupBy("image", "r").agg(F.max("iou").alias("iou"))
    total = d.where("id % 2 = 0").count()
    return D.recall_at(best, F.lit(total), [0.1, 0.3, 0.5, 0.7]).select(F.col("threshold").cast("decimal(2,1)").alias("threshold"), F.round("recall", 6).alias("recall"))


@query("SELECT l.quality AS gt, l.toxic AS pred, count(*) AS n FROM labels l GROUP BY 1, 2")
def e31_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH m AS (SELECT quality AS g, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), c AS (SELECT k AS class, coalesce((SELECT sum(n) FROM m WHERE g = k AND p = k), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE g = k), 0) AS gt, coalesce((SELECT sum(n) FROM m WHERE p = k), 0) AS pred FROM (VALUES (0), (1), (2)) t(k))
SELECT class, CAST(tp AS BIGINT) AS tp, CAST(gt AS BIGINT) AS gt, CAST(pred AS BIGINT) AS pred, round(tp / nullif(gt + pred - tp, 0), 6) AS iou, round(tp / nullif(gt, 0), 6) AS acc FROM c""")
def e32_class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = D.class_scores(D.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"), 3)
    return scores.withColumns({"iou": F.round("iou", 6), "acc": F.round("acc", 6)})


@query("""WITH m AS (SELECT quality AS g, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), c AS (SELECT k AS class, coalesce((SELECT sum(n) FROM m WHERE g = k AND p = k), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE g = k), 0) AS gt, coalesce((SELECT sum(n) FROM m WHERE p = k), 0) AS pred FROM (VALUES (0), (1), (2)) t(k))
SELECT round(sum(tp) / sum(gt), 6) AS pixel_acc, round(avg(coalesce(tp / nullif(gt, 0), 0)), 6) AS mean_acc_all, round(avg(coalesce(tp / nullif(gt + pred - tp, 0), 0)), 6) AS miou_all, round(avg(tp / nullif(gt, 0)) FILTER (WHERE gt > 0), 6) AS mean_acc_present,
  round(sum(tp / nullif(gt + pred - tp, 0)) FILTER (WHERE gt > 0) / count(*) FILTER (WHERE gt + pred > 0), 6) AS miou_present, round(sum(coalesce(tp / nullif(gt + pred - tp, 0), 0) * gt) / sum(gt), 6) AS fwiou FROM c""")
def e33_segmentation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conventions for absent classes."""
    scores = D.segmentation_scores(D.class_scores(D.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"), 3))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query("""WITH s AS (SELECT l_returnflag AS class, CASE l_linenumber % 4 WHEN 0 THEN 'fp' WHEN 1 THEN 'fn' ELSE 'tp' END AS kind, l_quantity / 50 AS iou FROM lineitem)
SELECT class, round(sum(iou) FILTER (WHERE kind = 'tp') / (count(*) FILTER (WHERE kind = 'tp') + count(*) FILTER (WHERE kind <> 'tp') / 2), 6) AS pq, round(avg(iou) FILTER (WHERE kind = 'tp'), 6) AS sq, round(count(*) FILTER (WHERE kind = 'tp') / (count(*) FILTER (WHERE kind = 'tp') + count(*) FILTER (WHERE kind <> 'tp') / 2), 6) AS rq FROM s GROUP BY class""")
def e38_panoptic(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 4 == 0, "fp").when(F.col("l_linenumber") % 4 == 1, "fn").otherwise("tp")
    out = D.panoptic_quality(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("class"), kind.alias("kind"), (F.col("l_quantity") / 50).alias("iou")))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")])


@query("""WITH e AS (SELECT event_type AS c, event_id, value / 100 AS err, CAST(user_id % 3 = 0 AS INTEGER) AS gt FROM events),
w AS (SELECT c, err, gt, sum(gt) OVER (PARTITION BY c) AS t, sum(gt) OVER s AS h, row_number() OVER s AS k FROM e WINDOW s AS (PARTITION BY c ORDER BY err DESC, gt DESC ROWS UNBOUNDED PRECEDING)),
j AS (SELECT c, err, k, 1 - (t - h) / (t + k - h) AS j FROM w WHERE t > 0)
SELECT c AS event_type, round(sum(err * d), 6) AS loss FROM (SELECT c, err, j - coalesce(lag(j) OVER (PARTITION BY c ORDER BY k), 0) AS d FROM j) GROUP BY c""")
def f24_lovasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("err"), (F.col("user_id") % 3 == 0).cast("int").alias("gt"))
    return D.lovasz(rows, ["event_type"], "err", "gt").select("event_type", F.round("loss", 6).alias("loss"))


@query()
def g6_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-maximum suppression by image and class; greedy, so tests hold it against a plain loop."""
    return D.suppress(detections(spark, sf_dir), ["image", "class"], "id", 0.3)


@query()
def g7_suppress_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    b = G.box("box")
    x, y = b.centre
    turned = F.struct(x.alias("x0"), y.alias("y0"), b.width.alias("x1"), b.height.alias("y1"), (F.col("id") * 15 % 90).cast("double").alias("angle"))
    return D.suppress(d.withColumn("box", turned), ["image", "class"], "id", 0.3, overlap=D.rotated_iou)


@query()
def g10_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top boxes of a level, clipped, suppressed, and the top of an image: the limits are the feature."""
    kept = D.propose(detections(spark, sf_dir), "image", "class", "id", 3, 0.5, 4, 80.0, 60.0, 2.0)
    return kept.select("image", "class", "id", "score")


@query()
def d18_match_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    truth = d.where("id % 2 = 0").select("image", "id", (F.col("id") % 8 == 0).alias("ignore"), (F.col("id") % 16 == 0).alias("crowd"), "box")
    mine = d.where("id % 2 = 1")
    return D.match_at_thresholds(D.iou_pairs(mine, truth, ["image"], "id"), mine, truth, ["image"], [0.1, 0.3, 0.5])


@query()
def d19_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    out = D.cover_greedily(D.iou_pairs(d.where("id % 2 = 1"), d.where("id % 2 = 0"), ["image"], "id", overlapping=True), ["image"])
    return out.withColumn("iou", F.round("iou", 6))


@query()
def d26_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a supplier as a video, orders as its frames."""
    d = detections(spark, sf_dir).withColumn("video", F.col("image") % 101)
    return K.track(d, "video", "image", "id", "class")


@query()
def d26_track_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for masks, the cells of a grid that a box touches, in one long video for each class."""
    grid = lambda lo, hi: F.sequence(F.floor(lo / 8).cast("int"), F.floor(hi / 8).cast("int"))
    b = G.box("box")
    pixels = F.flatten(F.transform(grid(b.x0, b.x1), lambda x: F.transform(grid(b.y0, b.y1), lambda y: x * 100 + y)))
    d = detections(spark, sf_dir).select(F.col("class").alias("video"), "image", "id", F.lit(1).alias("label"), pixels.alias("mask"))
    return K.track(d, "video", "image", "id", "label", shape="mask")


@query()
def g8_suppress_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("image"), (F.col("l_partkey") % 20).alias("mask"), (F.col("l_partkey") % 20 / 20).alias("score"), (F.col("l_suppkey") % 60).alias("pixel")).distinct()
    return D.suppress_masks(rows, "image", "mask", "score", "pixel", 0.6)


@query(_BOXES + """SELECT image, id, round((x1 - x0) * (y1 - y0), 4) AS area, least(greatest(CAST(floor(4 + log2(sqrt((x1 - x0) * (y1 - y0)) / 10 + 1e-8)) AS INTEGER), 2), 5) - 2 AS level,
  x1 - x0 > 10 AND y1 - y0 > 10 AS large, x0 >= 0 AND y0 >= 0 AND x1 < 60 AND y1 < 60 AS inside, round(least(x1, 60) - least(x0, 60), 4) AS cut_width FROM b""")
def j23_box_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, clipping, predicates and pyramid level."""
    b = G.box("box")
    cut = G.clip(b, F.lit(60.0), F.lit(60.0))
    return detections(spark, sf_dir).select("image", "id", F.round(b.area, 4).alias("area"), G.pyramid_level(b, 2, 5, 10.0).alias("level"), G.nonempty(b, 10).alias("large"), G.inside(b, F.lit(60), F.lit(60)).alias("inside"), F.round(cut.width, 4).alias("cut_width"))


@query(_BOXES + """SELECT image, max(CASE WHEN abs(bx0 + bx1 - ax0 - ax1) > abs(by0 + by1 - ay0 - ay1) THEN CASE WHEN iou < 0.1 THEN 1 ELSE round(0.1 / iou, 6) END ELSE 0 END) AS score FROM p GROUP BY image""")
def d13_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best spatial relation of a frame's objects."""
    d = detections(spark, sf_dir)
    both = d.where("id % 2 = 1").select("image", F.col("box").alias("a")).join(d.where("id % 2 = 0").select("image", F.col("box").alias("b")), "image")
    return both.groupBy("image").agg(F.max(F.round(G.relation_score(G.box("a"), G.box("b"), F.lit(True)), 6)).alias("score"))
