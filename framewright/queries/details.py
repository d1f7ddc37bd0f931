"""Final detections, ensembles of views, crops, weights of training steps, pending work, and ledgers that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import schedules
from ..operators import detection as D
from ..operators import predicates as P
from ..operators import relate as R
from ..operators import statistics as A
from ..operators.sampling import draw
from ..registry import query, table
from ..sources import staged
from ..storage import shared_folder
from .boxes import _BOXES, detections


@query()
def g11_final_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over a limit, suppressed by class, and the top of each image; greedy, so tests hold it against a plain loop."""
    out = D.final_detections(detections(spark, sf_dir), "image", "class", "id", 0.3, 0.4, 3, 70.0, 60.0)
    return out.select("image", "class", "id", "score")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box of three views of its image, shifted a little in each; the last view is flipped."""
    b = G.box("box")
    shift = F.col("view") * F.col("l_discount") * 10
    seen = F.when(F.col("view") == 2, G.Box(100.0 - b.x1 + shift, b.y0, 100.0 - b.x0 + shift, b.y1).struct()).otherwise(G.Box(b.x0 + shift, b.y0, b.x1 + shift, b.y1).struct())
    rows = detections(spark, sf_dir).withColumn("view", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    score = F.round(F.col("score") - F.col("view") * 0.01 * (F.col("id") % 3), 6)
    return rows.select("image", "class", (F.col("id") * 3 + F.col("view")).alias("id"), "view", (F.col("view") == 2).alias("flipped"), score.alias("score"), seen.alias("box"))


@query()
def e57_ensemble_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best boxes of three views with the means of those they stand for; greedy, so tests hold it against a plain loop."""
    best, _ = D.ensemble_detections(views(spark, sf_dir), "image", "class", "id", 100.0, 60.0, 0.5, 10)
    return best.select("image", "class", "id", "score", "members", *[F.round(f"mean_box.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT l_suppkey, l_partkey % 7 AS x, l_linenumber AS y, round(avg(v), 9) AS value FROM (
  SELECT l_suppkey, CASE WHEN l_orderkey % 2 = 1 THEN 6 - l_partkey % 7 ELSE l_partkey % 7 END AS l_partkey, l_linenumber, l_discount AS v FROM lineitem) GROUP BY 1, 2, 3""")
def e57_mean_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of masks of seven by seven, odd orders as flipped views."""
    c = F.col
    cells = table(spark, sf_dir, "lineitem").select("l_suppkey", (c("l_partkey") % 7).alias("x"), c("l_linenumber").alias("y"), c("l_discount").alias("value"), (c("l_orderkey") % 2 == 1).alias("flipped"))
    return D.mean_masks(cells, ["l_suppkey"], "x", "y", "value", 7, c("flipped")).withColumn("value", F.round("value", 9))


@query(_BOXES + """, s AS (SELECT image, id, least(greatest(x0 * 1.5, 0), 60) AS x0, least(greatest(y0 * 0.5, 0), 30) AS y0, least(greatest(x1 * 1.5, 0), 60) AS x1, least(greatest(y1 * 0.5, 0), 30) AS y1 FROM b)
SELECT image, id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(id * 1.5, 6) AS px, round(2 * 0.5, 6) AS py FROM s WHERE x1 > x0 AND y1 > y0""")
def j42_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of images of 40 by 60 as those of 60 by 30, with a keypoint each."""
    points = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(1).alias("v")))
    out = D.rescaled(detections(spark, sf_dir).withColumn("points", points), F.lit(40), F.lit(60), F.lit(60), F.lit(30), "points")
    b, p = G.box("box"), F.get("points", 0)
    return out.select("image", "id", *[F.round(v, 6).alias(n) for n, v in (("x0", b.x0), ("y0", b.y0), ("x1", b.x1), ("y1", b.y1), ("px", p["x"]), ("py", p["y"]))])


@query("""WITH f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 60) / 100.0 AS x0, (l_suppkey % 60) / 100.0 AS y0, (l_partkey % 60 + 1 + l_quantity) / 100.0 AS x1, (l_suppkey % 60 + 3 * l_linenumber) / 100.0 AS y1 FROM lineitem),
c AS (SELECT *, CAST(round_even(least(greatest(x0 - (x1 - x0) * 0.25, 0), 1) * 640, 0) AS INTEGER) AS a0, CAST(round_even(least(greatest(x1 + (x1 - x0) * 0.25, 0), 1) * 640, 0) AS INTEGER) AS a1,
  CAST(round_even(least(greatest(y0 - (y1 - y0) * (0.25 + 0.5), 0), 1) * 361, 0) AS INTEGER) AS b0, CAST(round_even(least(greatest(y1 + (y1 - y0) * 0.25, 0), 1) * 361, 0) AS INTEGER) AS b1 FROM f),
d AS (SELECT *, greatest(a1 - a0, 2) - greatest(a1 - a0, 2) % 2 AS w, greatest(b1 - b0, 2) - greatest(b1 - b0, 2) % 2 AS h FROM c)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(least(a0, 640 - w), 0) AS x, greatest(least(b0, 361 - h), 0) AS y, w, h,
  CAST(CASE WHEN 100 * x0 - (100 * x1 - 100 * x0) * 0.25 < 0 THEN 0 ELSE round_even(100 * x0 - (100 * x1 - 100 * x0) * 0.25, 0) END AS INTEGER) AS grown_x0,
  CAST(CASE WHEN 100 * y1 + (100 * y1 - 100 * y0) * 0.25 > 79 THEN 79 ELSE round_even(100 * y1 + (100 * y1 - 100 * y0) * 0.25, 0) END AS INTEGER) AS grown_y1 FROM d""")
def j22_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face's crop with room above it, and a box of pixels grown by a half."""
    c = F.col
    x0, y0 = (c("l_partkey") % 60) / 100, (c("l_suppkey") % 60) / 100
    face = G.Box(x0, y0, (c("l_partkey") % 60 + 1 + c("l_quantity")) / 100, (c("l_suppkey") % 60 + 3 * c("l_linenumber")) / 100)
    whole = G.Box(*[v * 100 for v in face])
    grown = G.expand_rounded(whole, 1.5, F.lit(100), F.lit(80))
    rows = table(spark, sf_dir, "lineitem").withColumn("crop", G.crop_of_face(face, F.lit(640), F.lit(361), 0.25, 0.5))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "crop.*", grown.x0.alias("grown_x0"), grown.y1.alias("grown_y1"))


@query("""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 900 ELSE 1600 END AS w, 900 AS h, CAST(('0x' || substr(md5('42:' || p_partkey), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM part),
b AS (SELECT *, CASE WHEN w = h THEN 0 ELSE p_size * 5 END AS cx, CASE WHEN w = h THEN p_size * 5 ELSE 0 END AS cy, CASE WHEN w = h THEN w // 8 ELSE h // 5 END AS step FROM p),
t AS (SELECT *, step * 8 AS tw, step * 5 AS th FROM b),
r AS (SELECT *, CASE WHEN w = h THEN greatest(cy - (th - 300), 0) ELSE greatest(cx - (tw - 300), 0) END AS low, CASE WHEN w = h THEN least(cy + th, h) - th ELSE least(cx + tw, w) - tw END AS high FROM t),
d AS (SELECT *, low + least(CAST(floor(u * (high - low + 1)) AS BIGINT), high - low) AS pos FROM r)
SELECT p_partkey, CAST(CASE WHEN w = h THEN 0 ELSE pos END AS INTEGER) AS x, CAST(CASE WHEN w = h THEN pos ELSE 0 END AS INTEGER) AS y, CAST(tw AS INTEGER) AS w, CAST(th AS INTEGER) AS h FROM d""")
def j22_crop_to_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of 8 to 5 of square and wide pictures around a crop that they hold."""
    c = F.col
    tall = c("p_partkey") % 2 == 0
    at = c("p_size") * 5
    inner = F.struct(F.when(tall, 0).otherwise(at).alias("x"), F.when(tall, at).otherwise(0).alias("y"), F.lit(300).alias("w"), F.lit(300).alias("h"))
    u = F.conv(F.substring(draw("p_partkey"), 1, 8), 16, 10).cast("bigint") / 2.0**32
    crop = G.crop_to_ratio(F.when(tall, 900).otherwise(1600), F.lit(900), inner, (8, 5), u)
    return table(spark, sf_dir, "part").select("p_partkey", crop.alias("c")).select("p_partkey", "c.*")


@query("""WITH g AS (SELECT exp(-2 * pow((3 * s / (1 + 2 * s) * 1000 - 500) / 1000, 2)) AS y FROM (SELECT 1 - i / 1000 AS s FROM range(1000) t(i))), k AS (SELECT min(y) AS low, 1000 / sum(y - (SELECT min(y) FROM g)) AS norm FROM g)
SELECT event_id, round(greatest(exp(-2 * pow((value * 10 - 500) / 1000, 2)) - low, 0) * norm, 6) AS weight FROM events, k""")
def j29_middle_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(schedules.middle_weight(F.col("value") * 10, 3.0), 6).alias("weight"))


@query("""SELECT * FROM (SELECT doc_id, true AS retried FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 10 <> 3 ORDER BY doc_id LIMIT 50)
UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 10 <> 3 AND doc_id % 4 <> 1""")
def c21_select_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without label and without file, failed ones again and the first fifty of them (the feature), or without those that failed."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    done, failed = [table(spark, sf_dir, "labels"), docs.where("doc_id % 10 = 3")], docs.where("doc_id % 4 = 1")
    again = R.select_pending(docs, "doc_id", done, failed, ["doc_id"], retry_failed=True, limit=50)
    new = R.select_pending(docs, "doc_id", done, failed, ["doc_id"])
    return again.withColumn("retried", F.lit(True)).unionByName(new.withColumn("retried", F.lit(False)))


@query("""WITH f AS (SELECT count(*) AS n FROM part WHERE p_partkey % 3 > 0)
SELECT CAST(1200 AS BIGINT) AS expected, n AS found, greatest(1200 - n, 0) AS missing, greatest(n - 1200, 0) AS extra, n = 1200 AS complete FROM f""")
def d8_count_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, ".txt").when(F.col("p_partkey") % 3 == 1, ".MP4").otherwise(".mp4"))
    return R.count_report(table(spark, sf_dir, "part").select(name.alias("name")), 1200)


@query("""WITH n AS (SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW')) v(place, name)),
s AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE o_orderpriority END AS own, n.place, n.name, md5('order ' || n.name || ' of ' || o_orderkey) AS score FROM orders, n),
b AS (SELECT o_orderkey, own, name FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, place) = 1),
e AS (SELECT own, CASE WHEN own = CASE WHEN name IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE name END THEN 1.0 ELSE 0.0 END AS value FROM b)
SELECT own, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY own""")
def d22_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority in a text is replaced by every other one; a digest of the text stands for its score. Two are one group."""
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    text = F.concat(F.lit("order "), F.col("o_orderpriority"), F.lit(" of "), F.col("o_orderkey").cast("string")).alias("text")
    rows = R.substitutions(table(spark, sf_dir, "orders").select("o_orderkey", text), "text", names).withColumn("score", F.md5("prompt"))
    each, means = R.counterfactual_scores(rows, "o_orderkey", names, merged={"1-URGENT": "urgent", "2-HIGH": "urgent"})
    return means.join(each.groupBy("own").agg(F.count("*").alias("n")), "own").select("own", F.round("mean", 6).alias("mean"), "n")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(lang, 'none') AS lang, n_chars, 1 AS tries FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, n_chars, 2 FROM documents WHERE doc_id % 2 = 1""")
def b3_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of lines and one that is a document, replaced as a whole and read back with defaults."""
    folder = f"{shared_folder(spark)}/ledgers-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "n_chars")
    even = F.col("id").cast("bigint") % 2 == 0
    staged.write_ledger(docs.limit(0), f"{folder}/lines", document=False)
    staged.write_ledger(docs.where(even), f"{folder}/lines")
    staged.write_ledger(docs.where(~even).withColumn("tries", F.lit(2)), f"{folder}/document", document=True)
    kind = "lang string, n_chars bigint, tries int"
    lines = staged.read_ledger(spark, f"{folder}/lines", kind, missing="error", corrupt="error", defaults={"lang": "none", "tries": 1})
    return lines.unionByName(staged.read_ledger(spark, f"{folder}/document", kind, missing="error", corrupt="error", document=True))


@query("""WITH c AS (SELECT p_name, p_partkey, [['Diversity'], ['Diversity', 'Motion', 'Scene'], ['Motion', 'Scene'], ['Scene']][p_partkey % 4 + 1] AS dims FROM part QUALIFY row_number() OVER (PARTITION BY left(p_name, 12) ORDER BY p_partkey) = 1),
f AS (SELECT p_name || '-' || i || '.mp4' AS file, i, p_name FROM part, range(5) t(i))
SELECT file, d.dimension FROM (SELECT DISTINCT file, i, p_name FROM f) x JOIN c ON left(c.p_name, 12) = left(x.p_name, 12), unnest(c.dims) d(dimension)
WHERE NOT (list_contains(dims, 'Diversity') AND len(dims) > 1) OR dimension = 'Diversity' OR file IN (left(c.p_name, 12) || '-0.mp4', left(c.p_name, 12) || '-1.mp4', left(c.p_name, 12) || '-2.mp4')""")
def d25_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five videos of each part, to the folders of the catalogue's entry for the first twelve characters of its name."""
    c = F.col
    part = table(spark, sf_dir, "part")
    dims = F.element_at(F.array(*[F.array(*map(F.lit, d)) for d in (["Diversity"], ["Diversity", "Motion", "Scene"], ["Motion", "Scene"], ["Scene"])]), (c("p_partkey") % 4 + 1).cast("int"))
    first = part.groupBy(F.substring("p_name", 1, 12).alias("key")).agg(F.min_by(F.struct("p_name", dims.alias("dims")), "p_partkey").alias("x"))
    five = F.array(*[F.concat("p_name", F.lit(f"-{i}.mp4")) for i in range(5)])
    files = part.select(F.explode(five).alias("file")).distinct()
    return R.routes(files, "file", first.select(c("x.p_name").alias("name"), c("x.dims").alias("dims")), "name", "name", "dims", "Diversity", cut=12)


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || CAST(round(o_totalprice) AS BIGINT), ',' ORDER BY o_orderkey % 3, o_orderkey) AS rows FROM orders GROUP BY 1")
def h7_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders from three ranks as one list."""
    c = F.col
    rows = table(spark, sf_dir, "orders").select("o_custkey", (c("o_orderkey") % 3).alias("rank"), "o_orderkey", F.round("o_totalprice").cast("bigint").alias("price"))
    found = R.gathered(rows, "o_custkey", "rank", "o_orderkey", ["o_orderkey", "price"])
    return found.select("o_custkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["price"].cast("string"))), ",").alias("rows"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'size' WHEN l_discount + l_tax > 0.12 THEN 'price' WHEN l_returnflag = 'R' THEN 'flag' END AS stage,
  CASE WHEN l_quantity > 40 THEN l_quantity END AS quantity, CASE WHEN l_quantity <= 40 AND l_discount + l_tax > 0.12 THEN l_discount END AS discount, l_partkey % 3 < 2 AS shared FROM lineitem""")
def c26_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage that a row fails with what it has measured, and whether an entry has a dimension that is asked for."""
    c = F.col
    stages = [("size", c("l_quantity") <= 40, ["l_quantity"]), ("price", c("l_discount") + c("l_tax") <= 0.12, ["l_discount", "l_tax"]), ("flag", c("l_returnflag") != "R", [])]
    dims = F.element_at(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")), F.array(F.lit("c"))), (c("l_partkey") % 3 + 1).cast("int"))
    rows = P.diagnosed(table(spark, sf_dir, "lineitem"), stages)
    at = lambda name: F.try_element_at("measured", F.lit(name))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "stage", at("l_quantity").alias("quantity"), at("l_discount").alias("discount"), P.shares_dimension(dims, ["b", "x"]).alias("shared"))


@query("""WITH v AS (SELECT a.label, list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(a.embedding[65 - i] AS DOUBLE), 2))) / 64 AS e, 1 + vec_id % 3 AS w FROM embeddings a)
SELECT label, round(avg(e), 9) AS error, round(avg(e * w), 9) AS weighted FROM v GROUP BY 1""")
def e47_weighted_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("label", v.alias("a"), F.reverse(v).alias("b"), (1 + F.col("vec_id") % 3).alias("w"))
    a, b = F.col("a"), F.col("b")
    out = rows.groupBy("label").agg(A.weighted_error(a, b).alias("error"), A.weighted_error(a, b, F.col("w")).alias("weighted"))
    return out.select("label", F.round("error", 9).alias("error"), F.round("weighted", 9).alias("weighted"))


@query("""SELECT * FROM (SELECT 'doc_id' AS path, 'bigint' AS type, count(*) AS n, count(*) - count(doc_id) AS nulls, CAST(min(doc_id) AS DOUBLE) AS least, CAST(max(doc_id) AS DOUBLE) AS greatest FROM documents
UNION ALL SELECT 'where', 'struct', count(*), 0, NULL, NULL FROM documents
UNION ALL SELECT 'where.lang', 'string', count(*), count(*) - count(lang), min(length(lang)), max(length(lang)) FROM documents
UNION ALL SELECT 'where.chars', 'bigint', count(*), count(*) - count(n_chars), min(n_chars), max(n_chars) FROM documents
UNION ALL SELECT 'sizes', 'array<bigint>', count(*), 0, 2, 2 FROM documents
UNION ALL SELECT 'sizes[]', 'bigint', count(*), count(*) - count(coalesce(n_chars, doc_id)), min(least(n_chars, doc_id)), max(greatest(n_chars, doc_id)) FROM documents)""")
def j35_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, fields of structs and elements of arrays."""
    c = F.col
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", c("n_chars").alias("chars")).alias("where"), F.array("n_chars", "doc_id").alias("sizes"))
    return A.described(rows)
