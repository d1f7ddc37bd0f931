"""Detection summaries, clips and their frames, masks on grids, and small steps of preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clips as C
from ..operators import detection as D
from ..operators import evaluation as E
from ..operators import grids as M
from ..operators import precision as P
from ..operators import sequences as S
from ..plans.scorers import scorer
from ..registry import query, table
from .boxes import _BOXES, _MATCH, _SAME, detections, matched


def _curve_sql(matches: str) -> str:
    return matches + """, n AS (SELECT class, count(*) AS n FROM b WHERE id % 2 = 0 AND id % 7 <> 0 GROUP BY 1),
c AS (SELECT t, m.class, row_number() OVER w AS k, sum(tp) OVER w / n.n AS recall, coalesce(sum(tp) OVER w / nullif(sum(tp) OVER w + sum(fp) OVER w, 0), 0) AS prec
  FROM m JOIN n USING (class) WINDOW w AS (PARTITION BY t, m.class ORDER BY score DESC, image, id ROWS UNBOUNDED PRECEDING))
"""  # fmt: skip


_LEVELS = _BOXES + _SAME + """,
t AS (SELECT i / 20 AS t FROM range(10, 20) x(i)),
d AS (SELECT b.image, b.id, b.class, b.score, best.r, t.t, coalesce(best.iou > t.t, false) AS near, coalesce(best.r % 7 = 0, false) AS hard FROM b CROSS JOIN t LEFT JOIN best ON best.image = b.image AND best.l = b.id WHERE b.id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY t, image, CASE WHEN near THEN r END ORDER BY score DESC, id) AS k FROM d),
m AS (SELECT t, image, id, class, score, CASE WHEN near AND NOT hard AND k = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN NOT near OR (NOT hard AND k > 1) THEN 1 ELSE 0 END AS fp FROM k)
"""  # fmt: skip


@query(_curve_sql(_LEVELS) + """, e AS (SELECT t, class, k, recall, max(prec) OVER (PARTITION BY t, class ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS env, coalesce(lag(recall) OVER (PARTITION BY t, class ORDER BY k), 0) AS bef FROM c),
a AS (SELECT class, t, sum((recall - bef) * env) AS ap FROM e GROUP BY 1, 2)
SELECT class, round(avg(ap) * 100, 6) AS ap, round(avg(ap) FILTER (WHERE t = 0.5) * 100, 6) AS ap50, round(avg(ap) FILTER (WHERE t = 0.75) * 100, 6) AS ap75 FROM a GROUP BY 1""")
def e35_ten_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision by class over overlaps from 0.5 to 0.95, at 0.5 and at 0.75."""
    side = lambda odd, *fields: F.when(F.col("id") % 2 == odd, F.struct("id", "box", *fields))
    both = detections(spark, sf_dir).select("image", "class", side(1, "score").alias("det"), side(0, (F.col("id") % 7 == 0).alias("difficult")).alias("object"))
    out = E.precision_summary(P.area_precision(both, "image", "class", E.LEVELS), ["class"])
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75")])


@query(_curve_sql(_MATCH.replace("m AS (SELECT image", "m AS (SELECT 0.3 AS t, image")) + """, g AS (SELECT class, i, coalesce(max(prec) FILTER (WHERE recall >= i / 10), 0) AS p FROM c CROSS JOIN range(11) x(i) GROUP BY 1, 2)
SELECT class, round(avg(p), 6) AS ap FROM g GROUP BY 1""")
def f6_eleven_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = matched(spark, sf_dir)
    positives = truth.where("not difficult").groupBy("class").agg(F.count("*").alias("n"))
    order = [F.desc("score"), F.col("image"), F.col("id")]
    curve = D.precision_recall(found.select("class", "score", "image", "id", "tp", "fp").join(positives, "class"), ["class"], order, F.col("n"))
    return D.interpolated_precision(curve, ["class"], 11).select("class", F.round("ap", 6).alias("ap"))


@query("""WITH a AS (SELECT l_suppkey, (9 + l_linenumber) / 20 AS t, CASE WHEN l_suppkey % 5 > 0 THEN avg(l_discount) END AS ap FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, coalesce(round(avg(ap) * 100, 6), 'nan') AS ap, coalesce(round(avg(ap) FILTER (WHERE t = 0.5) * 100, 6), 'nan') AS ap50, coalesce(round(avg(ap) FILTER (WHERE t = 0.75) * 100, 6), 'nan') AS ap75 FROM a GROUP BY 1""")
def e36_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth supplier has no value (-1), which comes out as NaN."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", ((9 + c("l_linenumber")) / 20).alias("threshold"))
    scores = rows.agg(F.avg("l_discount").alias("ap")).withColumn("ap", F.when(c("l_suppkey") % 5 > 0, c("ap")).otherwise(-1.0))
    return E.precision_summary(scores, ["l_suppkey"]).select("l_suppkey", *[F.round(n, 6).alias(n) for n in ("ap", "ap50", "ap75")])


@query()
def e37_average_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy, so that tests hold it against a plain loop: small objects, the best three proposals of an image."""
    d = detections(spark, sf_dir)
    truth = d.where("id % 2 = 0").select("image", "id", "box", G.box("box").area.alias("area"), (F.col("id") % 6 == 0).alias("crowd"))
    return E.proposal_recall(d.where("id % 2 = 1"), truth, ["image"], "small", 3, [0.1, 0.3, *E.LEVELS])


_SOURCE = "s AS (SELECT vec_id, x, row_number() OVER (ORDER BY x) / (count(*) OVER () + 1) AS q FROM (SELECT vec_id, CAST(vec_id AS DOUBLE) * 7 % 501 + vec_id / 10000.0 AS x FROM embeddings))"
_MAPPED = f"""WITH {_SOURCE}, t AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS m, coalesce(lead(value) OVER (ORDER BY value), value) AS nx FROM events),
y AS (SELECT vec_id, q, v + (q * m - i) * (nx - v) AS mapped FROM s JOIN t ON i = least(floor(q * m), m - 1))
"""  # fmt: skip


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    rows = table(spark, sf_dir, "embeddings").select("vec_id", ((c("vec_id").cast("double") * 7) % 501 + c("vec_id") / 10000.0).alias("x"))
    return rows, S.inverse_map(rows, "x", table(spark, sf_dir, "events"), "value")


@query(_MAPPED + "SELECT vec_id, round(mapped, 9) AS mapped FROM y")
def f9_inverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mapped = _mapped(spark, sf_dir)
    return mapped.join(rows, "x").select("vec_id", F.round("mapped", 9).alias("mapped"))


@query(_MAPPED + "SELECT k / 100 AS score, round(min_by(mapped, struct_pack(g := abs(q - k / 100), q := q)), 9) AS mapped FROM y CROSS JOIN range(100) r(k) GROUP BY k")
def f9_mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mapping_table(_mapped(spark, sf_dir)[1]).select("score", F.round("mapped", 9).alias("mapped"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_custkey % 97 + 1 AS BIGINT) AS n FROM orders)
SELECT o_orderkey, array_to_string([f FOR f IN [CAST(round_even((0.2 + i * 0.4) * 8.0, 0) AS BIGINT) FOR i IN range(CAST(ceil(((n / 8.0 + 0.2) - 0.2) / 0.4) AS BIGINT))] IF f < n][1:7], ',') AS at_rate,
  array_to_string(range(0, n, 9), ',') AS every, array_to_string([CASE WHEN i = 4 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 4)) AS BIGINT) END FOR i IN range(5)], ',') AS even,
  array_to_string([CAST(floor(least(i, least(n, 6) - 1) * (n / least(n, 6))) AS BIGINT) + 1 FOR i IN range(6)], ',') AS fixed FROM o""")
def f16_frame_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by rate, every ninth, at equal steps and at fixed places, as lists."""
    n = (F.col("o_custkey") % 97 + 1).cast("bigint")
    text = lambda c, to: F.array_join(c.cast("array<string>"), ",").alias(to)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text(C.frames_at_rate(n, 8.0, 2.5, 7), "at_rate"), text(C.every_frame(n, 9), "every"),
        text(C.even_frames(n, 5), "even"), text(C.fixed_frames(n, 6, 1), "fixed"),
    )


@query("""WITH m AS (SELECT l_suppkey AS v, (l_linenumber - 1) % 4 + 1 AS e, avg(l_partkey % 41 - 20) AS dx, avg(l_orderkey * 7 % 41 - 20) AS dy FROM lineitem GROUP BY 1, 2),
w AS (SELECT v, e, CASE WHEN dx > 1 THEN 'right' WHEN dx < -1 THEN 'left' END AS way FROM m UNION ALL SELECT v, e, CASE WHEN dy > 1 THEN 'down' WHEN dy < -1 THEN 'up' END FROM m),
d AS (SELECT v, e, way FROM w WHERE way IS NOT NULL UNION ALL SELECT v, e, 'static' FROM w GROUP BY 1, 2 HAVING count(way) = 0),
means AS (SELECT * FROM (VALUES (1, 'left_left', 'pan_right'), (1, 'right_right', 'pan_left'), (1, 'down_down', 'tilt_up'), (1, 'up_up', 'tilt_down'), (1, 'up_down', 'zoom_in'), (1, 'down_up', 'zoom_out'), (1, 'static_static', 'static'),
  (3, 'left_left', 'pan_right'), (3, 'right_right', 'pan_left'), (3, 'down_down', 'tilt_up'), (3, 'up_up', 'tilt_down'), (3, 'left_right', 'zoom_in'), (3, 'right_left', 'zoom_out'), (3, 'static_static', 'static')) x(e, c, label)),
p AS (SELECT a.v, a.e, label FROM d a JOIN d b ON a.v = b.v AND b.e = a.e + 1 AND a.e IN (1, 3) LEFT JOIN means ON means.e = a.e AND c = a.way || '_' || b.way),
s AS (SELECT v, label FROM p WHERE label IS NOT NULL UNION SELECT v, 'None' FROM p GROUP BY v, e HAVING count(label) = 0),
u AS (SELECT v, list(DISTINCT label) AS ls FROM s WHERE v IN (SELECT v FROM m GROUP BY 1 HAVING count(*) = 4) GROUP BY 1),
z AS (SELECT v, [x FOR x IN ls IF x <> 'static' OR len(ls) = 1] AS ls FROM u)
SELECT v AS l_suppkey, array_to_string(list_sort([x FOR x IN ls IF x <> 'None' OR len(ls) = 1]), ',') AS labels FROM z""")
def f21_camera_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as videos, the lines of orders in turn as points of the top, lower, left and right edges."""
    c = F.col
    edge = F.get(F.array(*[F.lit(e) for e in ("top", "down", "left", "right")]), (c("l_linenumber") - 1) % 4)
    moved = F.struct(F.lit(1).alias("t"), (c("l_partkey") % 41 - 20).alias("x"), (c("l_orderkey") * 7 % 41 - 20).alias("y"))
    began = F.struct(F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))
    point = F.concat_ws(":", "l_orderkey", "l_partkey", "l_linenumber")
    tracks = table(spark, sf_dir, "lineitem").select("l_suppkey", edge.alias("edge"), point.alias("point"), F.explode(F.array(began, moved)).alias("p"))
    ways = C.edge_directions(tracks.select("l_suppkey", "edge", "point", "p.*"), "l_suppkey", "edge", "point", "t", 1.0)
    return C.camera_labels(ways, "l_suppkey").select("l_suppkey", F.array_join("labels", ",").alias("labels"))


@query("SELECT o_orderkey, (['pan_left', 'pan_right', 'tilt_up', 'tilt_down', 'zoom_in', 'zoom_out', 'static'])[o_orderkey % 7 + 1] AS camera FROM orders")
def j14_camera_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, C.CAMERA_PHRASES)), (F.col("o_orderkey") % 7).cast("int"))
    name = F.concat(F.lit("a street at night, "), phrase, F.lit(".mp4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.camera_type(name).alias("camera"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE left(o_orderpriority, 1) WHEN '1' THEN 5.0 WHEN '3' THEN 9.0 WHEN '4' THEN NULL WHEN '5' THEN NULL ELSE 5.0 END END::DOUBLE AS duration FROM orders")
def j19_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files named after their priority, of which two thirds have a number."""
    c = F.col
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("videos/"), "o_orderpriority", F.when(c("o_orderkey") % 3 > 0, F.concat(F.lit("-"), "o_orderkey")).otherwise(""), F.lit(".mp4"))
    digit = F.left("o_orderpriority", F.lit(1))
    prompts = orders.select("o_orderpriority").distinct()
    prompts = prompts.withColumn("dims", F.when(digit < "4", F.array(digit, F.lit("2"))).otherwise(F.array(digit)))
    named = orders.select("o_orderkey", path.alias("path"))
    return C.clip_duration(named, "path", prompts, "o_orderpriority", "dims", {"1": 2, "2": 5, "3": 9}).select("o_orderkey", "duration")


@query("""WITH p AS (SELECT user_id, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS t FROM events),
n AS (SELECT user_id, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM p GROUP BY 1 HAVING a > 0 AND b > 0)
SELECT user_id, side, count(*) AS frames FROM p WHERE user_id IN (SELECT user_id FROM n) AND t < (SELECT min(least(a, b)) FROM n) GROUP BY 1, 2""")
def e42_common_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as frames of a clip found, odd ones as those of truth, cut to a common number."""
    side = (F.col("event_id") % 2).alias("side")
    t = F.row_number().over(Window.partitionBy("user_id", side).orderBy("event_id")) - 1
    frames = table(spark, sf_dir, "events").select("user_id", side, t.alias("t"))
    a, b = C.common_frames(frames.where("side = 0"), frames.where("side = 1"), "user_id", "t")
    return a.unionByName(b).groupBy("user_id", "side").agg(F.count("*").alias("frames"))


@query("SELECT o_orderkey // 2 AS pair, min(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS pred, min(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS truth FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1 HAVING count(*) = 2")
def d9_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    end = F.when(c("o_orderkey") % 2 == 0, "_pred.mp4").otherwise("_gt.mp4")
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.floor(c("o_orderkey") / 2).cast("string"), end).alias("name"), F.when(c("o_orderkey") % 5 > 0, c("o_totalprice")).alias("price")
    )
    both = C.paired(files, files, "name", "_pred.mp4", "_gt.mp4", "price")
    return both.select(c("name").cast("bigint").alias("pair"), "pred", "truth")


@query("""SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) USING (k)""")
def d23_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return E.by_position(orders, "o_orderkey", customers, "c_custkey")


@query("SELECT o_orderkey, 'Videos_part_' || CASE WHEN o_orderkey < 100 THEN right('00' || o_orderkey, 3) ELSE CAST(o_orderkey AS VARCHAR) END || '.single.csv' AS file FROM orders")
def a6_part_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.part_file("raw/Videos_part_*.csv", F.col("o_orderkey")).alias("file"))


@query("SELECT c_custkey, o.n AS orders, o.n IS NOT NULL AS cached FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def a14_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return C.probed(table(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey", ["orders"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%m%d') || '_s' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]', '_', 'g') END AS name FROM orders")
def j37_run_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("o_orderkey") % 4 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.run_name(F.col("o_orderdate"), F.col("o_custkey"), suffix).alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 5 IN (1, 3) AS INTEGER) AS chosen, CAST(l_tax > 0.05 AS INTEGER) AS taxed FROM lineitem")
def j27_mask_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    chosen = M.of_classes(c("l_suppkey") % 5, [1, 3])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", chosen.alias("chosen"), M.binary(c("l_tax"), 0.05).alias("taxed"))


_GRID = "WITH p AS (SELECT l_suppkey AS image, l_partkey % 12 AS x, l_linenumber - 1 AS y, max(l_quantity) AS v, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2, 3)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("image"), (c("l_partkey") % 12).alias("x"), (c("l_linenumber") - 1).alias("y"))
    return rows.agg(F.max("l_quantity").alias("v"), F.min("l_orderkey").alias("o"))


@query(_GRID + """, b AS (SELECT image, i, j, v FROM p JOIN range(4) a(i) ON x >= floor(i * 12 / 4) AND x < ceil((i + 1) * 12 / 4) JOIN range(3) c(j) ON y >= floor(j * 7 / 3) AND y < ceil((j + 1) * 7 / 3))
SELECT image, i AS x, j AS y, round(avg(v), 6) AS v FROM b GROUP BY 1, 2, 3""")
def j30_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve columns to four and seven rows to three, whose cells overlap."""
    out = M.coverage(_grid(spark, sf_dir), ["image"], {"x": (12, 4), "y": (7, 3)}, "v")
    return out.withColumn("v", F.round("v", 6))


@query(_GRID + " SELECT image, i AS x, j AS y, v FROM p JOIN range(5) a(i) ON x = floor((i + 0.5) * 12 / 5) JOIN range(3) c(j) ON y = floor((j + 0.5) * 7 / 3)")
def j30_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(_grid(spark, sf_dir), ["image"], {"x": (12, 5), "y": (7, 3)}, "v", nearest=True)


@query(_BOXES + """, g AS (SELECT image, id, b.x0 AS p0, b.y0 AS q0, b.x1 AS p1, b.y1 AS q1, floor((b.y0 + b.y1) / 2 / 8) AS i, floor((b.x0 + b.x1) / 2 / 8) AS j FROM b),
r AS (SELECT * FROM (VALUES (0, 16.0, 0.5::DOUBLE), (1, 16.0, 1.0), (2, 16.0, 2.0), (3, 32.0, 0.5), (4, 32.0, 1.0), (5, 32.0, 2.0)) v(k, size, ratio)),
n AS (SELECT image, id, CAST((i * 16 + j) * 6 + k AS BIGINT) AS "anchor", p0, q0, p1, q1, (j + 0.5) * 8 - sqrt(size * size / ratio) / 2 AS x0, (i + 0.5) * 8 - ratio * sqrt(size * size / ratio) / 2 AS y0,
  (j + 0.5) * 8 + sqrt(size * size / ratio) / 2 AS x1, (i + 0.5) * 8 + ratio * sqrt(size * size / ratio) / 2 AS y1 FROM g, r),
u AS (SELECT *, greatest(least(p1, x1) - greatest(p0, x0), 0) * greatest(least(q1, y1) - greatest(q0, y0), 0) AS c FROM n)
SELECT image, id, "anchor", round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(c / ((p1 - p0) * (q1 - q0) + (x1 - x0) * (y1 - y0) - c), 6) AS iou FROM u""")
def j40_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all images beside the anchors of the cell that holds their middle."""
    b = G.box("box")
    x, y = b.centre
    boxes = detections(spark, sf_dir).select("image", "id", "box", (F.floor(y / 8) * 16 + F.floor(x / 8)).alias("cell"))
    grid = M.anchors(spark, [(16, 16, 8, [16.0, 32.0])], [0.5, 1.0, 2.0], 0.5)  # 1,536 rows
    near = boxes.join(F.broadcast(grid.withColumn("cell", F.floor(F.col("at") / 6))), "cell")
    a = G.Box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return near.select("image", "id", F.col("at").alias("anchor"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(G.iou(b, a), 6).alias("iou"))


@query()
def h6_grown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of pixels decides, so that tests hold it against regions found the other way round."""
    c = F.col
    seeds = F.when(c("o") % 9 == 0, c("o") % 3 + 1).otherwise(F.lit(0).cast("bigint"))
    rows = _grid(spark, sf_dir).select("image", "x", "y", seeds.alias("label"), (seeds * 10).alias("human"), (c("v") % 2).cast("int").alias("kind"))
    return M.grow_regions(rows, "image", "x", "y", "label", "human", "kind", {1: 0, 2: 1, 3: 1})


@query(_BOXES + """, o AS (SELECT x.image, x.id, y.id AS r, y.class, greatest(least(x.x1, y.x1) - greatest(x.x0, y.x0), 0) * greatest(least(x.y1, y.y1) - greatest(x.y0, y.y0), 0) AS i,
    (x.x1 - x.x0) * (x.y1 - x.y0) + (y.x1 - y.x0) * (y.y1 - y.y0) AS sizes FROM b x LEFT JOIN b y ON x.image = y.image AND y.id % 2 = 0),
f AS (SELECT image, id, r, class, CASE WHEN i / (sizes - i) >= 0.5 THEN 1 WHEN coalesce(i / (sizes - i), 0) < 0.3 THEN 0 ELSE -1 END AS label FROM o QUALIFY row_number() OVER (PARTITION BY image, id ORDER BY i / (sizes - i) DESC, r) = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY md5('42:' || id), id) AS k, least(count(*) FILTER (WHERE label = 1) OVER (PARTITION BY image), 2) AS ones FROM f WHERE label >= 0)
SELECT image, id, label, CASE WHEN label = 1 THEN class ELSE 'none' END AS class, CASE WHEN label = 1 THEN r END AS object FROM d WHERE CASE WHEN label = 1 THEN k <= 2 ELSE k <= 4 - ones END""")
def d28_label_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled proposals of each image, with what they are proposed for: four, half of them on objects at most."""
    d = detections(spark, sf_dir)
    return E.label_proposals(d.where("id % 2 = 1"), d.where("id % 2 = 0"), ["image"], 0.3, 0.5, "none", 4, 0.5)


@query(_GRID + """, a AS (SELECT DISTINCT image, o % 3 AS m, x, y FROM p WHERE v > 20), c AS (SELECT DISTINCT image, o % 2 AS m, x, y FROM p WHERE v < 45)
SELECT i.image, i.l, i.r, round(i.n / (s.n + t.n - i.n), 9) AS iou FROM (SELECT a.image, a.m AS l, c.m AS r, count(*) AS n FROM a JOIN c USING (image, x, y) GROUP BY 1, 2, 3) i
JOIN (SELECT image, m, count(*) AS n FROM a GROUP BY 1, 2) s ON s.image = i.image AND s.m = i.l JOIN (SELECT image, m, count(*) AS n FROM c GROUP BY 1, 2) t ON t.image = i.image AND t.m = i.r""")
def d27_mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _grid(spark, sf_dir)
    left = p.where("v > 20").withColumn("m", F.col("o") % 3)
    right = p.where("v < 45").withColumn("m", F.col("o") % 2)
    return E.mask_iou(left, right, ["image"], "m", ["x", "y"]).withColumn("iou", F.round("iou", 9))


@query("""WITH k AS (SELECT l_orderkey AS image, l_suppkey % 4 AS id, l_linenumber - 1 AS point, min(l_partkey % 50) AS x, min(l_quantity) AS y, CAST(min(l_tax) > 0.06 AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT *, max(v) OVER (PARTITION BY image, id) AS seen FROM k WHERE id % 2 = 1),
e AS (SELECT g.image, f.id AS l, g.id AS r, CASE WHEN seen > 0 THEN f.x - g.x ELSE greatest(0, 10 - 20 - f.x) + greatest(0, f.x - 30 - 20) END AS dx, CASE WHEN seen > 0 THEN f.y - g.y ELSE greatest(0, 10 - 5 - f.y) + greatest(0, f.y - 15 - 5) END AS dy, (2 * (point + 1) / 10) ** 2 AS s
  FROM g JOIN k f USING (image, point) WHERE f.id % 2 = 0 AND (seen = 0 OR g.v > 0))
SELECT image, l, r, round(avg(exp(-(dx * dx + dy * dy) / s / 400 / 2)), 9) AS similarity FROM e GROUP BY 1, 2, 3""")
def d27_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("image"), (c("l_suppkey") % 4).alias("id"), (c("l_linenumber") - 1).alias("point"))
    points = rows.agg(F.min(c("l_partkey") % 50).alias("x"), F.min("l_quantity").alias("y"), (F.min("l_tax") > 0.06).cast("int").alias("v"))
    size = G.Box(F.lit(10.0), F.lit(10.0), F.lit(30.0), F.lit(15.0)).struct()
    truth = points.where("id % 2 = 1").withColumns({"area": F.lit(400.0), "box": size})
    sigmas = F.array(*[F.lit((i + 1) / 10) for i in range(7)])
    out = E.keypoint_similarity(points.where("id % 2 = 0"), truth, ["image"], sigmas)
    return out.withColumn("similarity", F.round("similarity", 9))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS image, l_linenumber % 2 AS side, l_suppkey % 3 AS point, l_partkey % 10 AS place FROM lineitem)
SELECT a.image, round(avg(CASE WHEN abs(a.place - b.place) <= 6 THEN exp(-abs(a.place - b.place) * abs(a.place - b.place) / 18.0) ELSE 0 END), 9) AS similarity FROM k a JOIN k b USING (image, point) WHERE a.side = 0 AND b.side = 1 GROUP BY 1""")
def d27_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("image"), (c("l_linenumber") % 2).alias("id"), (c("l_suppkey") % 3).alias("point"), (c("l_partkey") % 10).alias("place")
    ).distinct()
    known = spark.range(100).select(F.floor(c("id") / 10).alias("a"), (c("id") % 10).alias("b"))
    known = known.withColumn("d", F.abs(c("a") - c("b"))).where("d <= 6")
    out = E.point_similarity(rows.where("id = 0"), rows.where("id = 1"), ["image"], known, 3.0)
    return out.select("image", F.round("similarity", 9).alias("similarity"))


@query("SELECT l_orderkey, round(sum(l_discount * l_tax) / count(*), 9) AS confidence FROM lineitem GROUP BY 1")
def e48_weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weighted_confidence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount", "l_tax").withColumn("confidence", F.round("confidence", 9))


@query("""WITH o AS (SELECT l_suppkey AS image, l_orderkey % 2 = 1 AS flipped, l_linenumber % 3 AS scale, CASE WHEN l_orderkey % 2 = 1 THEN 9 - l_partkey % 10 ELSE l_partkey % 10 END AS x,
  CASE WHEN l_orderkey % 2 = 1 THEN CASE l_partkey % 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE l_partkey % 4 END ELSE l_partkey % 4 END AS class, l_quantity / 50 AS p FROM lineitem),
s AS (SELECT image, x, class, scale, avg(p) AS p FROM o GROUP BY 1, 2, 3, 4), m AS (SELECT image, x, class, avg(p) AS p FROM s GROUP BY 1, 2, 3)
SELECT image, x, class, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY image, x ORDER BY round(p, 9) DESC, class) AS k FROM m) WHERE k = 1""")
def e57_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("image"), (c("l_orderkey") % 2 == 1).alias("flipped"), (c("l_linenumber") % 3).alias("scale"),
        (c("l_partkey") % 10).alias("x"), (c("l_partkey") % 4).alias("class"), (c("l_quantity") / 50).alias("p"),
    )
    return E.ensemble(rows, ["image"], "x", 10, {2: 3, 3: 2}).withColumn("p", F.round("p", 6))


@query("""SELECT round(count(*) FILTER (WHERE g = p) / count(*), 9) AS accuracy, round(count(*) FILTER (WHERE g BETWEEN 0 AND 3 AND g = p) / count(*) FILTER (WHERE g BETWEEN 0 AND 3), 9) AS foreground,
  round(count(*) FILTER (WHERE g BETWEEN 0 AND 3 AND p = 4) / count(*) FILTER (WHERE g BETWEEN 0 AND 3), 9) AS missed FROM (SELECT l_partkey % 6 - 1 AS g, l_suppkey % 5 AS p FROM lineitem)""")
def e58_training_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_partkey") % 6 - 1).alias("g"), (c("l_suppkey") % 5).alias("p"))
    out = E.training_accuracy(rows, "g", "p", 4)
    return out.select(*[F.round(n, 9).alias(n) for n in out.columns])


@query(_BOXES + "SELECT image, id, coalesce(score > 0.5, false) AS confident, id % 5 <> 3 AS object, (x0 + 5 <= x1 AND y0 + 9 <= y1 AND id % 2 = 1) OR (x0 + 30 <= x1 AND y0 + 2 <= y1) AS shown FROM b")
def c28_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident boxes, boxes on objects, boxes that show a keypoint."""
    c = F.col
    point = lambda x, y, v: F.struct((c("box.x0") + x).alias("x"), (c("box.y0") + y).alias("y"), v.alias("v"))
    points = F.array(point(5, 9, (c("id") % 2).cast("int")), point(30, 2, F.lit(2)))
    return detections(spark, sf_dir).select(
        "image", "id", E.confident(c("score"), 0.5).alias("confident"), E.is_object(c("id") % 5, 3).alias("object"),
        E.shows_keypoint(points, G.box("box")).alias("shown"),
    )


@query("SELECT doc_id, length(text) / 2.0 + 1 AS score FROM documents")
def l5_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that is loaded once for each task and sees batches."""
    score = scorer(lambda: 2.0, lambda halves, texts: texts.str.len().fillna(0) / halves + 1)
    return table(spark, sf_dir, "documents").select("doc_id", score("text").alias("score"))
