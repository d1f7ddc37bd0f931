"""Plain-loop comparisons of greedy and iterative operators, and hand-made cases of settings, scorers and hooks."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import catalogue
from framewright.operators import clips as C
from framewright.operators import detection as D
from framewright.operators import evaluation as E
from framewright.operators import grids as M
from framewright.operators import ranges as R
from framewright.operators import sequences as S
from framewright.plans import settings
from framewright.queries.boxes import detections
from framewright.streaming.hooks import Hooks

SF = "/root/testdata/sf0.001"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


@pytest.fixture(scope="module")
def boxes(spark):
    """image -> rows (id, class, score, box) of the fixture."""
    out = defaultdict(list)
    for r in detections(spark, SF).collect():
        out[r.image].append((r.id, r["class"], r.score, tuple(r.box)))
    return out


def test_running_sums_equal_a_window(spark):
    rows = [(None if i % 7 == 0 else "ab"[i % 2], i * 37 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(7)
    got = R.running(df, ["k"], ["o", "i"], {"s": F.col("i"), "n": F.lit(1)})
    got = R.latest_max(got, ["k"], "i", "top").collect()
    assert len(got) == 500
    for r in got:
        mine = [x for x in rows if x[0] == r.k]
        upto = [x for x in mine if (x[1], x[2]) <= (r.o, r.i)]
        assert (r.s, r.n, r.n_all) == (sum(x[2] for x in upto), len(upto), len(mine))
        assert r.top == max(x[2] for x in mine if (x[1], x[2]) >= (r.o, r.i))
    assert R.running(df.where("false"), ["k"], ["o"], {"n": F.lit(1)}).count() == 0


def test_cover_is_the_greatest_overlap_again_and_again(spark, boxes):
    got = defaultdict(dict)
    for r in catalogue.QUERIES["d19_cover"](spark, SF).collect():
        got[r.image][r.l] = (r.r, r.iou)
    for image, rows in boxes.items():
        left, right = {x[0]: x[3] for x in rows if x[0] % 2}, {x[0]: x[3] for x in rows if x[0] % 2 == 0}
        want = {}
        while left and right:
            v, i, j = max((overlap(a, b), -i, -j) for i, a in left.items() for j, b in right.items())
            if v == 0:
                break
            want[-i] = (-j, pytest.approx(v, abs=1e-6))
            del left[-i], right[-j]
        assert got[image] == want


def test_matches_at_thresholds_follow_the_rule(spark, boxes):
    got = {(r.image, r.threshold, r.id): (r.object, r.ignored) for r in catalogue.QUERIES["d18_match_thresholds"](spark, SF).collect()}
    seen = 0
    for image, rows in boxes.items():
        truth = sorted((x for x in rows if x[0] % 2 == 0), key=lambda x: (x[0] % 8 == 0, x[0]))
        for t in (0.1, 0.3, 0.5):
            free = {x[0] for x in truth}
            for i, _, _, b in sorted((x for x in rows if x[0] % 2), key=lambda x: (-x[2], x[0])):
                best, at = None, t
                for j, _, _, o in truth:  # those to ignore come last and only count where no other one was found
                    if j not in free and j % 16 or best is not None and best % 8 and j % 8 == 0:
                        continue
                    v = overlap(b, o)
                    if v >= t and (best is None or v > at):
                        best, at = j, v
                free.discard(best)
                assert got[image, t, i] == (best, best is not None and best % 8 == 0)
                seen += 1
    assert seen == len(got)


def test_masks_lose_what_earlier_ones_cover(spark):
    got = {(r.image, r.mask, r.pixel) for r in catalogue.QUERIES["g8_suppress_masks"](spark, SF).collect()}
    masks = defaultdict(lambda: defaultdict(set))
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        masks[r.l_orderkey % 500][r.l_partkey % 20].add(r.l_suppkey % 60)
    want = set()
    for image, own in masks.items():
        covered = set()
        for m in sorted(own, reverse=True):
            if len(own[m] & covered) / len(own[m]) <= 0.6:
                want |= {(image, m, p) for p in own[m] - covered}
                covered |= own[m]
    assert got == want


def test_proposals_are_cut_suppressed_and_limited(spark, boxes):
    got = {(r.image, r["class"], r.id) for r in catalogue.QUERIES["g10_proposals"](spark, SF).collect()}
    want = set()
    for image, rows in boxes.items():
        kept = []
        for level in {x[1] for x in rows}:
            mine = []
            for i, c, s, b in sorted((x for x in rows if x[1] == level), key=lambda x: (-x[2], x[0]))[:3]:
                b = (min(max(b[0], 0), 80), min(max(b[1], 0), 60), min(max(b[2], 0), 80), min(max(b[3], 0), 60))
                if b[2] - b[0] > 2 and b[3] - b[1] > 2 and all(overlap(b, o) <= 0.5 for *_, o in mine):
                    mine.append((i, c, s, b))
            kept += mine
        want |= {(image, c, i) for i, c, _, _ in sorted(kept, key=lambda x: (-x[2], x[0]))[:4]}
    assert got == want


def test_average_recall_covers_objects_once(spark, boxes):
    got = {round(r.threshold, 2): r.recall for r in catalogue.QUERIES["e37_average_recall"](spark, SF).collect()}
    best, total = [], 0
    for rows in boxes.values():
        found = [x[3] for x in sorted((x for x in rows if x[0] % 2), key=lambda x: (-x[2], x[0]))]
        truth = [x[3] for x in rows if x[0] % 2 == 0 and x[0] % 6 and (x[3][2] - x[3][0]) * (x[3][3] - x[3][1]) <= 1024]
        if not found:
            continue
        total += len(truth)
        m = np.array([[overlap(a, b) for b in truth] for a in found[:3]]).reshape(len(found[:3]), len(truth))
        for _ in range(min(m.shape)):
            i, j = np.unravel_index(m.argmax(), m.shape)
            best.append(m[i, j])
            m[i, :], m[:, j] = -1, -1
    assert total and got == pytest.approx({round(t, 2): sum(v >= t for v in best) / total for t in [0.1, 0.3, *E.LEVELS]})


def test_means_that_differ_in_their_last_bits_are_ties(spark):
    rows = [(1, False, 0, 0, 1, 0.1 + 0.2), (1, False, 0, 0, 0, 0.3), (2, False, 0, 0, 1, 0.31), (2, False, 0, 0, 0, 0.3)]
    df = spark.createDataFrame(rows, "image int, flipped boolean, scale int, x int, class int, p double")
    assert {r.image: r["class"] for r in E.ensemble(df, ["image"], "x", 10, {}).collect()} == {1: 0, 2: 1}


def test_regions_go_to_the_first_seed_beside_them(spark):
    rows = catalogue.QUERIES["h6_grown_regions"](spark, SF).collect()
    source = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_suppkey", (F.col("l_partkey") % 12).alias("x"), (F.col("l_linenumber") - 1).alias("y"))
    source = source.agg(F.max("l_quantity").alias("v"), F.min("l_orderkey").alias("o")).collect()
    kinds = {1: 0, 2: 1, 3: 1}
    around = lambda p: [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    grown = 0
    for image in {r.image for r in rows}:
        own = {(r.y, r.x): r for r in source if r.l_suppkey == image}
        seed = {p: r.o % 3 + 1 if r.o % 9 == 0 else 0 for p, r in own.items()}
        want, seen = dict(seed), set()
        for p in own:
            if seed[p] or p in seen:
                continue
            kind, region, new = own[p].v % 2, {p}, [p]
            while new:
                new = [q for q in {q for n in new for q in around(n)} if q in own and not seed[q] and own[q].v % 2 == kind and q not in region]
                region |= set(new)
            seen |= region
            seeds = [q for n in region for q in around(n) if seed.get(q) and kinds[seed[q]] == kind]
            for n in region:
                want[n] = seed[min(seeds)] if seeds else 0
        grown += sum(want[p] != seed[p] for p in own)
        mine = {(r.y, r.x): (r.label, r.human) for r in rows if r.image == image}
        assert mine == {p: (v, v * 10) for p, v in want.items()}
    assert grown > 0


def test_empty_tables_give_empty_results(spark):
    none = detections(spark, SF).where("false")
    truth = none.select("image", "id", "box", "class", F.lit(False).alias("difficult"))
    found = D.match_levels(none, truth, ["image"], [0.5], [F.desc("score")])
    curve = D.precision_recall(found, ["class"], [F.desc("score")], F.lit(1))
    assert D.average_precision(curve, ["class"]).count() == 0
    whole = truth.withColumns({"area": F.lit(1.0), "crowd": F.lit(False)})
    assert [r.recall for r in E.proposal_recall(none, whole, ["image"], thresholds=[0.5]).collect()] == [None]
    scores = spark.createDataFrame([], "x double")
    assert S.inverse_map(scores, "x", scores, "x").count() == 0


def test_frame_lists_of_short_clips(spark):
    row = spark.createDataFrame([(0,), (1,), (3,), (10,)], "n int")
    got = row.select(C.middle_frames(F.col("n"), 4), C.fixed_frames(F.col("n"), 2), C.even_frames(F.col("n"), 3), C.every_frame(F.col("n"), 4), C.frames_at_rate(F.col("n"), 4.0, 2.0)).collect()
    assert [tuple(r) for r in got] == [
        (None, None, None, None, []),
        ([0, 0, 0, 0], [0, 0], [0, 0, 0], [0], []),
        ([0, 1, 2, 2], [0, 1], [0, 1, 2], [0], [1]),
        ([0, 3, 5, 8], [0, 5], [0, 4, 9], [0, 4, 8], [1, 3, 5, 7, 9]),
    ]


def test_names_that_do_not_fit_are_errors(spark):
    one = spark.createDataFrame([("a dog runs",)], "n string")
    assert one.select(C.camera_type(F.col("n"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="no camera movement"):
        one.select(C.camera_type(F.col("n"))).collect()
    with pytest.raises(Exception, match=r"no \* in"):
        one.select(C.part_file("a.csv", F.lit(1))).collect()


def test_anchor_boxes_by_hand(spark):
    got = M.anchors(spark, [(1, 2, 4, [32.0])], [0.25, 1.0, 4.0]).orderBy("at").collect()
    assert [tuple(r)[2:] for r in got[:3]] == [(-32.0, -8.0, 32.0, 8.0), (-16.0, -16.0, 16.0, 16.0), (-8.0, -32.0, 8.0, 32.0)]
    assert tuple(got[3])[2:] == (-28.0, -8.0, 36.0, 8.0)


def test_settings_merge_and_refuse_unknown_names():
    base = {"run": {"steps": 10, "name": "a"}, "extra": {}}
    layer = settings.overrides(["run.steps=20", "run.name=b=c", "extra.x=[1]"])
    assert settings.merged(base, layer) == {"run": {"steps": 20, "name": "b=c"}, "extra": {"x": [1]}}
    assert base["run"]["steps"] == 10
    with pytest.raises(KeyError):
        settings.merged(base, {"run": {"stepz": 1}})
    with pytest.raises(ValueError):
        settings.overrides(["run.steps"])


def test_hooks_see_a_stream(spark, tmp_path):
    calls = []
    hooks = Hooks(lambda i: calls.append("start"), lambda i, batch, rows: calls.append((batch, rows)), lambda i, error: calls.append(error))
    spark.streams.addListener(hooks)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if None in calls:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(hooks)
    assert calls[0] == "start" and (0, 5) in calls and calls[-1] is None


def test_proposals_without_any_area_are_background_and_images_meet_once(spark):
    from framewright.operators import evaluation

    kind = "image int, id int, class string, box struct<x0: double, y0: double, x1: double, y1: double>"
    truth = spark.createDataFrame([(1, 10, "a", (7.0, 7.0, 7.0, 7.0)), (2, 10, "b", (0.0, 0.0, 4.0, 4.0))], kind)
    found = spark.createDataFrame([(1, 1, None, (5.0, 5.0, 5.0, 5.0)), (2, 1, None, (0.0, 0.0, 4.0, 3.0)), (2, 3, None, (0.0, 0.0, 4.0, 1.6)), (3, 1, None, (0.0, 0.0, 1.0, 1.0)), (None, 1, None, (0.0, 0.0, 1.0, 1.0))], kind)
    got = evaluation.label_proposals(found, truth, ["image"], 0.3, 0.5, "none", 4, 0.5)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == [(1, 1, 0, "none", None), (1, 10, 0, "none", None), (2, 1, 1, "b", 10), (2, 10, 1, "b", 10), (3, 1, 0, "none", None), (None, 1, 0, "none", None)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
