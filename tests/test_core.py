"""Hand-made cases and plain-loop comparisons of the core library."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import catalogue
from framewright.functions import geometry as G
from framewright.functions import text as T
from framewright.operators import detection as D
from framewright.operators import predicates as P
from framewright.operators import relate as R
from framewright.operators import sampling as S
from framewright.operators import sequences as Q
from framewright.operators import summaries as Y
from framewright.plans import scores
from framewright.sources import readers
from framewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_caption_rule_uses_the_fixed_words(spark):
    rows = [("Two men walk",), ("a single woman alone",), ("a NETWORK of cats",), ("A crowd, single file",), (None,)]
    df = spark.createDataFrame(rows, "c string").select(T.caption_rule(F.col("c")).alias("r"))
    assert [r.r for r in df.collect()] == [False, True, None, False, None]


def test_prompt_names(spark):
    names = ["a cat-0.mp4", "a cat.mp4", "a cat-12_003.mp4", "a cat-Scene-1_002.mp4", "x-y-3.mp4"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(T.prompt_of_clip(F.col("n")).alias("p"))
    assert [r.p for r in df.collect()] == ["a cat", "a cat", "a cat", "a cat", "x-y"]


def test_selector_grammar(spark):
    df = spark.createDataFrame([(1, "x"), (4, "y")], "a int, b string")
    assert P.select(df, "*").count() == 2
    assert P.select(df, "a:int=1-3,b=x").count() == 1
    assert P.select(df, "a=4").count() == 0  # a text never equals a number
    for bad in ("=x", "a", "a:date=1", "zz=1"):
        with pytest.raises(ValueError):
            P.selector(df, bad)
    with pytest.raises(TypeError):
        P.selector(df, "a=1-3")


def test_parse_lines_keeps_the_last(spark):
    lines = ["", "{x", '{"clip_id":"a","n":1}', '{"n":3}', '{"clip_id":"a","n":2}']
    df = spark.createDataFrame(list(enumerate(lines)), "at int, value string")
    assert readers.parse_lines(df, "clip_id string, n int", ["clip_id"], "at").collect() == [("a", 2)]


def test_frame_consistency_of_short_and_opposite_clips(spark):
    rows = [("one", 0, [1.0, 0.0]), ("same", 0, [1.0, 0.0]), ("same", 1, [2.0, 0.0]), ("off", 0, [1.0, 0.0]), ("off", 1, [-1.0, 0.0])]
    got = {r.clip_id: r.total for r in Q.frame_consistency(spark.createDataFrame(rows, "clip_id string, t int, emb array<double>")).collect()}
    assert got == {"same": 1.0, "off": 0.0}


def test_majority_repeats_the_edges(spark):
    bits = [1, 0, 0, 1, 1]
    df = spark.createDataFrame([("v", t, b) for t, b in enumerate(bits)], "v string, t int, b int")
    got = [r.voted for r in Q.majority(df, "v", "t", "b", 3).orderBy("t").collect()]
    pad = [bits[0], *bits, bits[-1]]
    assert got == [int(sum(pad[i : i + 3]) >= 2) for i in range(5)]


def test_dense_number_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = Q.dense_number(df, ["x"], "k").orderBy("x").collect()
    assert [r.k for r in rows] == list(range(1, 1001))


def test_interpolation_clamps(spark):
    m = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0)], "key double, mapped double")
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (10.0,), (11.0,), (None,)], "x double")
    assert [r.y for r in R.interpolate(df, "x", m).collect()] == [1.0, 1.0, 1.5, 2.0, 2.0, None]


def test_group_split_leaks_nothing_and_empty_tables_pass(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}" if i % 11 else None) for i in range(200)], "i int, g string")
    out = S.split_groups(df, F.coalesce("g", F.col("i").cast("string")), 0.2)
    assert out.count() == 200 and S.leaks(out, F.coalesce("g", F.col("i").cast("string"))).first()[0] == 0
    assert S.split_groups(df.limit(0), F.col("g"), 0.2).count() == 0


def test_suppression_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for image in range(6):
        for i in range(12):
            x, y = rng.integers(0, 20, 2)
            rows.append((image, i, float(rng.integers(0, 5)), (float(x), float(y), float(x + 10), float(y + 10))))
    df = spark.createDataFrame(rows, "image int, id int, score double, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = {(r.image, r.id) for r in D.suppress(df, ["image"], "id", 0.4).collect()}
    want = set()
    for image in range(6):
        kept = []
        for _, i, s, b in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1])):
            if all(D._iou_matrix(np.array(b), np.array([k]))[0] <= 0.4 for k in kept):
                kept.append(b)
                want.add((image, i))
    assert got == want


def test_rotated_overlap():
    a = np.array([0, 0, 2, 2, 0.0])
    assert D.rotated_iou(a, np.array([[0, 0, 2, 2, 90.0], [1, 0, 2, 2, 0.0], [9, 9, 1, 1, 0.0]])) == pytest.approx([1, 1 / 3, 0])


def test_box_deltas_invert(spark):
    df = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0), (1.0, 1.0, 3.0, 5.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    back = df.select(G.apply_deltas(G.box("a"), G.deltas(G.box("a"), G.box("b"))).struct().alias("r")).first().r
    assert tuple(back) == pytest.approx((1, 1, 3, 5))


def test_missing_dimensions_score_below_zero(spark):
    table = scores.dimension_table(spark, scores.VIDEO_DIMENSIONS)
    none = spark.createDataFrame([], "dimension string, score double")
    assert scores.final_score(scores.family_scores(none, table), scores.VIDEO_BLEND).first().total < 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{c} {t}" for c, t in events.dtypes)
    jobs.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ledger"), lambda d: d.where("value > 50"), 2).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert first == events.where("value > 50").count()
    jobs.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ledger"), lambda d: d.where("value > 50"), 2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_core_does_not_import_the_training_operators():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p


def test_natural_key_reads_all_numbers(spark):
    from framewright.functions.text import natural_key

    names = ["a10", "A2", "a1b10", "a1b2", "B1", "b", "007", "7a", "12345678901234567890123", "", "a1"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    cut = lambda n: [(t.lower(), int(d or -1)) for t, d in re.findall(r"(\D*)(\d*)", n) if t or d]
    assert got == sorted(names, key=lambda n: (cut(n), n))


def test_metric_lines_take_one_value_of_a_key(spark):
    from framewright.sources.writers import metric_lines

    rows = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "x", 2.0), (1, "a", "y", 0.5)], "step int, phase string, key string, value double")
    assert [r.value for r in metric_lines(rows).collect()] == ['{"step":1,"phase":"a","m":{"x":2.0,"y":0.5}}']


def test_results_of_any_length_are_read_back(spark, tmp_path):
    from framewright.sources.writers import result_json

    name = F.concat(F.repeat(F.lit("v"), 60), F.col("id").cast("string"))
    rows = spark.range(300_000).select(F.lit("long").alias("dimension"), name.alias("video"), (F.col("id") % 2).cast("double").alias("score"))
    rows = rows.union(spark.createDataFrame([("short", "a", 3.0), (None, "b", None)], "dimension string, video string, score double"))
    result_json(rows).write.json(f"{tmp_path}/results")
    held = F.from_json(F.get_json_object("value", "$[1]"), "array<struct<video: string, score: double>>")
    read = spark.read.schema("dimension string, value string").json(f"{tmp_path}/results").select("dimension", F.get_json_object("value", "$[0]").alias("score"), F.size(held).alias("n"))
    assert {(r.dimension, r.score): r.n for r in read.groupBy("dimension", "score").agg(F.sum("n").alias("n")).collect()} == {("long", "0.5"): 300_000, ("short", "3.0"): 1, (None, "null"): 1}


def test_flattened_names_nested_fields(spark):
    from framewright.operators.summaries import flattened

    df = spark.sql("SELECT named_struct('b', 1, 'c', named_struct('d', 2)) AS a, 3 AS e")
    assert flattened(df).columns == ["a/b", "a/c/d", "e"] and flattened(df).first() == (1, 2, 3)


def test_matches_at_just_the_threshold_and_of_whole_pixels(spark):
    kind = "image bigint, id bigint, box struct<x0: double, y0: double, x1: double, y1: double>"
    det = spark.createDataFrame([(1, 1, (0.0, 0.0, 9.0, 9.0), 0.9), (1, 2, (0.0, 0.0, 9.0, 6.0), 0.8), (1, 3, (50.0, 0.0, 59.0, 4.0), 0.7)], kind + ", score double")
    truth = spark.createDataFrame([(1, 10, (0.0, 0.0, 9.0, 6.0), False), (1, 11, (50.0, 0.0, 59.0, 9.0), False)], kind + ", difficult boolean")
    def told(**rule):
        rows = D.match_levels(det, truth, ["image"], [0.5, 0.6, 0.7], [F.desc("score")], **rule).collect()
        return {(r.id, r.threshold): (r.tp, r.fp) for r in rows}

    # with whole pixels the overlaps are 0.7, 1 and 0.5; without, 2 / 3, 1 and 4 / 9
    assert told() == {(1, 0.5): (1, 0), (2, 0.5): (0, 1), (3, 0.5): (0, 1), (1, 0.6): (1, 0), (2, 0.6): (0, 1), (3, 0.6): (0, 1), (1, 0.7): (0, 1), (2, 0.7): (1, 0), (3, 0.7): (0, 1)}
    loose = told(strict=False)
    assert loose[3, 0.5] == (1, 0) and loose[1, 0.7] == (1, 0) and loose[2, 0.7] == (0, 1)
    assert told(pixel=0.0)[1, 0.7] == (0, 1) and told(pixel=0.0, strict=False)[3, 0.5] == (0, 1)


def test_still_and_moving_clips_round_frames_to_even(spark):
    def static(frames, moving, wrap=0.0):
        rows = [("a", 9.0 if i < moving else 0.0, False) for i in range(frames - 1)] + [("a", wrap, True), ("a", 0.0, True)]
        df = spark.createDataFrame(rows, "clip string, s double, w boolean")
        return Y.static_clips(df, "clip", "s", F.col("w"), F.lit(256.0)).first().static

    assert not static(3, 1) and static(3, 0) and not static(4, 1) and static(5, 1) and static(12, 2) and not static(12, 3) and not static(20, 3) and static(21, 3)
    assert static(5, 0, 6.0) and not static(5, 0, 6.1) and not static(4, 0, 0.1)

    def moving(frames, hits):
        df = spark.createDataFrame([("a", 1.0 if i < hits else 0.0) for i in range(frames - 1)], "clip string, s double")
        return Q.moves(df, "clip", F.col("s"), 0.5).first().moving

    assert moving(2, 0) and not moving(3, 0) and moving(3, 1) and moving(6, 2) and not moving(6, 1) and moving(10, 2) and not moving(14, 3) and moving(14, 4)
