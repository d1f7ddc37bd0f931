"""Reports of detection by area bands, panoptic merges and their quality, over boxes and pixels derived from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection as D
from ..operators import panoptic as N
from ..operators import precision as P
from ..registry import query, table
from .boxes import detections


def sized_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections are all boxes but every third, shifted by their discount; objects are all boxes. Images are enlarged by
    one to five, so that all area bands occur; every eleventh object is a crowd."""
    grow = F.col("image") % 5 + 1
    b = G.box("box")
    scaled = lambda shift: F.struct(*[((c + shift) * grow).cast("double").alias(n) for n, c in (("x0", b.x0), ("y0", b.y0), ("x1", b.x1), ("y1", b.y1))])
    area = (b.width * b.height * grow * grow).alias("area")
    truth = F.struct("id", scaled(F.lit(0.0)).alias("box"), area, (F.col("id") % 11 == 0).alias("crowd"))
    found = F.struct("id", "score", scaled(F.col("l_discount") * 100 * (F.col("id") % 2)).alias("box"), area)
    return detections(spark, sf_dir).select("image", "class", F.when(F.col("id") % 3 != 0, found).alias("det"), truth.alias("object"))


def sized_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = sized_sides(spark, sf_dir)
    return both.where("det is not null").select("image", "class", "det.*"), both.select("image", "class", "object.*")


@query()
def e36_twelve_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall by bands, overlaps and limits; greedy, so tests hold it against a plain loop."""
    scores = P.band_precision(sized_sides(spark, sf_dir), "image", "class")
    return P.twelve_numbers(scores).withColumn("value", F.round("value", 6))


@query()
def e36_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.band_precision(sized_sides(spark, sf_dir), "image", "class", limits=(1, 2, 3))
    return P.by_class(scores, "class").withColumn("ap", F.round("ap", 6))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of twenty masks in images of sixty pixels; a mask's class is its number modulo three, from 1."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 500).alias("image"), (c("l_partkey") % 20).alias("mask"), (c("l_suppkey") * 7 % 60).cast("int").alias("pixel"))
    return rows.distinct().withColumns({"score": c("mask") * 7 % 20 / 20, "class": (c("mask") % 3 + 1).cast("int")})


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label from 0 to 5 for each pixel of the same images."""
    images = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("image")).distinct()
    pixel = F.explode(F.sequence(F.lit(0), F.lit(59))).alias("pixel")
    label = lambda: ((F.col("image") + F.floor(F.col("pixel") / 7) * 5) % 11 % 6).cast("int").alias("label")
    return images.select("image", pixel).select("image", "pixel", label())


@query()
def g12_panoptic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks in order of score, then stuff; greedy, so tests hold it against a plain loop."""
    return N.merge(masks(spark, sf_dir), semantic(spark, sf_dir), "image", ["pixel"], 0.5, 4, 0.1)


def label_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth: line items as pixels of segments with classes by their number, of which some are crowds. Found: the same
    segments with some pixels lost, some moved to the next segment, and one more segment each on void pixels."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 500).alias("image"), (c("l_suppkey") * 7 % 60 + 60 * c("l_linenumber")).alias("pixel"), c("l_linenumber").alias("line"), (c("l_partkey") % 10).alias("part"))
    rows = rows.groupBy("image", "pixel").agg(F.min("line").alias("segment"), F.min("part").alias("part"))
    truth = rows.where("part <> 9").select("image", "pixel", "segment", (c("segment") % 4).alias("class"), (c("segment") % 4 == 3).alias("crowd"))
    found = rows.where("part <> 8").select("image", "pixel", F.when(c("part") < 7 - c("image") % 6, c("segment")).otherwise(c("segment") + 1 + c("image") % 2).alias("segment"))
    return truth, found.withColumn("class", c("segment") % 4)


@query("""WITH r AS (SELECT l_orderkey % 500 AS image, l_suppkey * 7 % 60 + 60 * l_linenumber AS pixel, min(l_linenumber) AS segment, min(l_partkey % 10) AS part FROM lineitem GROUP BY 1, 2),
t AS (SELECT image, pixel, segment AS t, segment % 4 AS ct, segment % 4 = 3 AS crowd FROM r WHERE part <> 9),
p AS (SELECT image, pixel, CASE WHEN part < 7 - image % 6 THEN segment ELSE segment + 1 + image % 2 END AS p FROM r WHERE part <> 8),
ta AS (SELECT image, t, ct, crowd, count(*) AS a FROM t GROUP BY ALL), pa AS (SELECT image, p, p % 4 AS cp, count(*) AS a FROM p GROUP BY ALL),
x AS (SELECT image, t, p, count(*) AS n FROM t JOIN p USING (image, pixel) GROUP BY ALL),
v AS (SELECT image, p, count(*) AS n FROM p ANTI JOIN t USING (image, pixel) GROUP BY ALL),
h AS (SELECT image, t, p, ct AS class, x.n / (ta.a + pa.a - x.n - coalesce(v.n, 0)) AS iou FROM x JOIN ta USING (image, t) JOIN pa USING (image, p) LEFT JOIN v USING (image, p)
  WHERE ct = cp AND NOT crowd AND x.n / (ta.a + pa.a - x.n - coalesce(v.n, 0)) > 0.5),
c AS (SELECT image, ct AS cp, max(t) AS t FROM ta WHERE crowd GROUP BY ALL),
k AS (SELECT class, 'tp' AS kind, iou FROM h
  UNION ALL SELECT ct, 'fn', NULL FROM ta ANTI JOIN h USING (image, t) WHERE NOT crowd
  UNION ALL SELECT cp, 'fp', NULL FROM pa LEFT JOIN v USING (image, p) LEFT JOIN c USING (image, cp) LEFT JOIN x ON x.image = pa.image AND x.p = pa.p AND x.t = c.t ANTI JOIN h ON h.image = pa.image AND h.p = pa.p
    WHERE (coalesce(v.n, 0) + coalesce(x.n, 0)) / pa.a <= 0.5),
q AS (SELECT class, coalesce(sum(iou), 0) / (count(*) FILTER (WHERE kind = 'tp') + count(*) FILTER (WHERE kind <> 'tp') / 2) AS pq, coalesce(avg(iou), 0) AS sq,
  count(*) FILTER (WHERE kind = 'tp') / (count(*) FILTER (WHERE kind = 'tp') + count(*) FILTER (WHERE kind <> 'tp') / 2) AS rq FROM k GROUP BY class),
s AS (SELECT unnest(['all', CASE WHEN class > 1 THEN 'things' ELSE 'stuff' END]) AS kind, pq, sq, rq FROM q)
SELECT kind, round(avg(pq) * 100, 6) AS pq, round(avg(sq) * 100, 6) AS sq, round(avg(rq) * 100, 6) AS rq, count(*) AS n FROM s GROUP BY kind""")
def e38_panoptic_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are matched from two label maps; quality of all classes, things and stuff."""
    each = D.panoptic_quality(N.match_segments(*label_maps(spark, sf_dir), "image", ["pixel"]))
    out = N.quality_by_kind(each, F.col("class") > 1)
    return out.select("kind", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")], "n")


@query()
def e38_quality_of_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged map against the map that a stricter merge gives."""
    m, s = masks(spark, sf_dir), semantic(spark, sf_dir)
    truth = N.merge(m, s, "image", ["pixel"], 0.3, 2, 0.3).withColumn("crowd", F.lit(False))
    each = D.panoptic_quality(N.match_segments(truth, N.merge(m, s, "image", ["pixel"], 0.5, 4, 0.1), "image", ["pixel"]))
    return each.select("class", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")])
