"""Tracks in pieces against one sequential loop over every video, through the queries and on crowded hand-made ones."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright import catalogue
from framewright.operators import tracking as K
from framewright.queries.boxes import detections

SF = "/root/testdata/sf0.001"


def box_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def mask_iou(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def plain(rows, iou, threshold, patience=8):
    """{(video, t, id): track} of (video, t, id, label, shape) rows, frame after frame."""
    videos = defaultdict(lambda: defaultdict(list))
    for video, t, i, label, shape in rows:
        videos[video][t].append((i, label, shape))
    out = {}
    for video, frames in videos.items():
        old, made = [], 0  # [label, shape, track, ttl]
        for t in sorted(frames):
            new = [[label, shape, None, patience, i] for i, label, shape in sorted(frames[t], key=lambda r: r[0])]
            extra = []
            for o in old:
                v = [iou(o[1], n[1]) if n[0] == o[0] else 0.0 for n in new]
                at = v.index(max(v))
                if v[at] > threshold and new[at][2] is None:
                    new[at][2] = o[2]
                    continue
                o[3] -= 1
                if o[3] > 0:
                    extra.append(o)
            for n in new:
                if n[2] is None:
                    n[2], made = made, made + 1
                out[video, t, n[4]] = n[2]
            old = [n[:4] for n in new] + extra
    return out


def test_queries_equal_the_sequential_loop(spark):
    rows = [(r.image % 101, r.image, r.id, r["class"], tuple(r.box)) for r in detections(spark, SF).collect()]
    got = {(r.video, r.image, r.id): r.track for r in catalogue.QUERIES["d26_track"](spark, SF).collect()}
    assert got == plain(rows, box_iou, 0.6)
    cells = lambda b: tuple(x * 100 + y for x in range(int(b[0] // 8), int(b[2] // 8) + 1) for y in range(int(b[1] // 8), int(b[3] // 8) + 1))
    masks = [(r["class"], r.image, r.id, 1, cells(tuple(r.box))) for r in detections(spark, SF).collect()]
    want = plain(masks, mask_iou, 0.5)
    got = {(r.video, r.image, r.id): r.track for r in catalogue.QUERIES["d26_track_masks"](spark, SF).collect()}
    assert got == want and len(set(want.values())) < len(want) / 2


@pytest.mark.parametrize("before", [0, 2])
def test_seams_that_disagree_are_done_again(spark, before):
    rng, rows = random.Random(before), []
    for t in range(120):
        for i in range(3):
            if rng.random() < 0.6:  # objects drift and are missed often
                x = i * 4 + t * 0.05 + rng.random()
                rows.append((7, t * 2, i, "a" if rng.random() < 0.9 else "b", (x, 0.0, x + 10, 10.0)))
    rows += [(8, 5, 1, "a", (0.0, 0.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, "video bigint, t bigint, id bigint, label string, box struct<x0: double, y0: double, x1: double, y1: double>")
    got = {(r.video, r.t, r.id): r.track for r in K.track(df, "video", "t", "id", "label", piece=6, before=before).collect()}
    assert got == plain(rows, box_iou, 0.6)
    assert K.track(df.limit(0), "video", "t", "id", "label").count() == 0


def test_equal_states_are_equal_bytes():
    one, other = "".join(["la", "bel"]), "".join(["lab", "el"])
    state = lambda a, b: [(1, 1, a, (0.0, 1.0), 8), (1, 2, b, (0.0, 2.0), 8)]
    assert K._dumped(state(one, one)) == K._dumped(state(one, other)) != K._dumped(state(one, "x"))


def test_all_overlaps_of_a_frame_are_taken_at_once():
    calls = []
    overlaps = lambda a, b: calls.append((len(a), len(b))) or K._box_overlaps(a, b)
    box = lambda x: (x, 0.0, x + 10.0, 10.0)
    state, found = K.advance([(1, i, "a", box(20.0 * i), 2) for i in range(5)], [(2, i, "a", box(20.0 * i)) for i in (3, 1)], 0.6, 8, overlaps)
    assert found == [3, 1] and calls == [(5, 2)] and [s[1] for s in state] == [3, 1, 0, 2, 4]


def test_a_track_over_many_pieces_keeps_its_number(spark):
    rows = [(t, 1, (0.0, 0.0, 10.0, 10.0)) for t in range(200)] + [(t, 2, (50.0, 0.0, 60.0, 10.0)) for t in range(90, 200, 7)]
    df = spark.createDataFrame(rows, "t bigint, id bigint, box struct<x0: double, y0: double, x1: double, y1: double>").select(F.lit("v").alias("video"), "*", F.lit(1).alias("label"))
    got = {(r.t, r.id): r.track for r in K.track(df, "video", "t", "id", "label", piece=4, before=9).collect()}
    assert {v for (t, i), v in got.items() if i == 1} == {0} and {v for (t, i), v in got.items() if i == 2} == {1}


def test_many_frames_at_once_equal_the_rule(monkeypatch):
    """Pixels and pairs are compared in blocks; masks are compared once for many frames, not frame by frame."""
    monkeypatch.setattr(K, "MARKS", 64 * 40)
    monkeypatch.setattr(K, "PAIRS", 50)
    rng = random.Random(3)
    rows = []
    for video in (1, 2):
        for t in sorted(rng.sample(range(100), 60)):
            for i in range(rng.randrange(1, 4)):
                begin = rng.randrange(6)
                rows.append((video, t, i, rng.choice(["a", "b", None]), [(begin + k) * 97 % 4001 for k in range(rng.randrange(120, 200))] + [7]))
    calls = []
    prepare = lambda shapes: calls.append(len(shapes)) or K._masks(shapes)
    names = ["video", "t", "id", "label", "shape"]
    table = pa.table({"piece": pa.array([0] * len(rows))} | {n: pa.array([r[k] for r in rows]) for k, n in enumerate(names)} | {"left": pa.nulls(len(rows), pa.int32())})
    told = list(K._follow(iter(table.to_batches(max_chunksize=50)), 0, 16, 0.5, 8, prepare))
    got = {(r["video"], r["t"], r["id"]): r["ref"] for b in told for r in b.to_pylist() if r["held"] is None}
    assert got == plain(rows, mask_iou, 0.5) and len(set(got.values())) < len(rows) / 3 and len(calls) < 30


def test_shapes_are_written_for_heads_alone(spark, monkeypatch):
    written, whole = [], K.materialise
    monkeypatch.setattr(K, "materialise", lambda df: written.append(whole(df)) or written[-1])
    rows = [(t, i, (10.0 * i + t % 3, 0.0, 10.0 * i + 10, 10.0)) for t in range(400) for i in range(3)]
    df = spark.createDataFrame(rows, "t bigint, id bigint, box struct<x0: double, y0: double, x1: double, y1: double>").select(F.lit("v").alias("video"), "*", F.lit(1).alias("label"))
    got = {(r.t, r.id): r.track for r in K.track(df, "video", "t", "id", "label", before=9).collect()}
    assert got == {k[1:]: v for k, v in plain([("v", t, i, 1, b) for t, i, b in rows], box_iou, 0.6).items()}
    shapes = [d.where(f"{c} is not null").count() for d in written for c in ("shape", "held.shape") if c.split(".")[0] in d.columns]
    assert 0 < sum(shapes) < len(rows) / 2
