"""Panoptic merges and their quality against plain loops over the same pixels, through the queries."""

import pytest

from framewright import catalogue
from framewright.operators import detection as D
from framewright.operators import panoptic as N
from framewright.queries import panoptics

SF = "/root/testdata/sf0.001"


def plain_merge(masks, semantic, overlap, least, confidence):
    """{(image, pixel): (segment, class, thing)}, painting one mask after the other."""
    out = {}
    own, labels = {}, {}
    for r in masks:
        own.setdefault(r["image"], {}).setdefault((-r["score"], r["mask"], r["class"]), set()).add(r["pixel"])
    for r in semantic:
        labels.setdefault(r["image"], {}).setdefault(r["label"], set()).add(r["pixel"])
    for image in own.keys() | labels.keys():
        painted, n = {}, 0
        for (score, _, kind), pixels in sorted(own.get(image, {}).items()):
            if -score < confidence or len(pixels & painted.keys()) / len(pixels) > overlap:
                continue
            n += 1
            painted |= {p: (n, kind, True) for p in pixels - painted.keys()}
        free = set().union(*labels.get(image, {0: set()}).values()) - painted.keys()
        for label, pixels in sorted(labels.get(image, {}).items()):
            if label and len(pixels & free) >= least:
                n += 1
                painted |= {p: (n, label, False) for p in pixels & free}
        out |= {(image, p): v for p, v in painted.items()}
    return out


def plain_quality(truth, found):
    """{class: (pq, sq, rq)} of {(image, pixel): (segment, class, crowd)} and {(image, pixel): (segment, class)}."""
    scores = {}
    for image in {k[0] for k in [*truth, *found]}:
        t = {p: v for (i, p), v in truth.items() if i == image}
        f = {p: v for (i, p), v in found.items() if i == image}
        areas = lambda m: {s: (sum(v[0] == s for v in m.values()), next(v for v in m.values() if v[0] == s)) for s in {v[0] for v in m.values()}}
        both, taken, hit = {}, set(), set()
        for p, v in f.items():
            key = (t[p][0] if p in t else None, v[0])
            both[key] = both.get(key, 0) + 1
        ta, fa = areas(t), areas(f)
        for (a, b), n in both.items():
            if a is None or ta[a][1][1] != fa[b][1][1] or ta[a][1][2]:
                continue
            iou = n / (ta[a][0] + fa[b][0] - n - both.get((None, b), 0))
            if iou > 0.5:
                scores.setdefault(ta[a][1][1], []).append(("tp", iou))
                taken.add(a)
                hit.add(b)
        crowds = {v[1]: a for a, (_, v) in sorted(ta.items()) if v[2]}
        for a, (_, v) in ta.items():
            if a not in taken and not v[2]:
                scores.setdefault(v[1], []).append(("fn", 0))
        for b, (n, v) in fa.items():
            aside = both.get((None, b), 0) + (both.get((crowds[v[1]], b), 0) if v[1] in crowds else 0)
            if b not in hit and aside / n <= 0.5:
                scores.setdefault(v[1], []).append(("fp", 0))
    out = {}
    for kind, rows in scores.items():
        tp, rest, total = sum(k == "tp" for k, _ in rows), sum(k != "tp" for k, _ in rows), sum(v for _, v in rows)
        out[kind] = (total / (tp + rest / 2), total / tp if tp else None, tp / (tp + rest / 2))
    return out


def test_merge_equals_painting(spark):
    m, s = panoptics.masks(spark, SF).collect(), panoptics.semantic(spark, SF).collect()
    want = plain_merge(m, s, 0.5, 4, 0.1)
    got = {(r.image, r.pixel): (r.segment, r["class"], r.thing) for r in catalogue.QUERIES["g12_panoptic_merge"](spark, SF).collect()}
    assert got == want and {v[2] for v in got.values()} == {True, False}
    painted = {r["image"]: set() for r in m}
    assert len({k for k, v in want.items() if v[2]}) < len({(r["image"], r["pixel"]) for r in m})  # some masks went
    assert painted


def test_quality_of_merges_equals_a_plain_loop(spark):
    m, s = panoptics.masks(spark, SF).collect(), panoptics.semantic(spark, SF).collect()
    truth = {k: (v[0], v[1], False) for k, v in plain_merge(m, s, 0.3, 2, 0.3).items()}
    want = plain_quality(truth, {k: v[:2] for k, v in plain_merge(m, s, 0.5, 4, 0.1).items()})
    got = {r["class"]: (r.pq, r.sq, r.rq) for r in catalogue.QUERIES["e38_quality_of_merge"](spark, SF).collect()}
    assert got.keys() == want.keys() and 0 < got[1][2] < 1
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_quality_with_crowds_and_void_equals_a_plain_loop(spark):
    t, f = panoptics.label_maps(spark, SF)
    truth = {(r.image, r.pixel): (r.segment, r["class"], r.crowd) for r in t.collect()}
    want = plain_quality(truth, {(r.image, r.pixel): (r.segment, r["class"]) for r in f.collect()})
    got = {r["class"]: (r.pq, r.sq, r.rq) for r in D.panoptic_quality(N.match_segments(t, f, "image", ["pixel"])).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_empty_maps_and_null_segments(spark):
    kind = "image bigint, pixel int, segment int, class int"
    t = spark.createDataFrame([(1, 1, 1, 5, False), (1, 2, 1, 5, False), (1, 3, None, 5, False), (2, 1, 4, 6, True)], kind + ", crowd boolean")
    f = spark.createDataFrame([(1, 1, 9, 5), (1, 2, 9, 5), (1, 3, 9, 5), (1, 4, 8, 5), (2, 1, 3, 6), (2, 2, None, 6)], kind)
    rows = lambda df: sorted((r["class"], r.kind, r.iou) for r in df.collect())
    assert rows(N.match_segments(t, f, "image", ["pixel"])) == [(5, "tp", 1.0)]  # void pixels of the found one don't count; 8 is void, 3 in a crowd
    assert rows(N.match_segments(t, f.limit(0), "image", ["pixel"])) == [(5, "fn", None)]
    assert rows(N.match_segments(t.limit(0), f, "image", ["pixel"])) == []
    none = spark.createDataFrame([], "image bigint, mask int, pixel int, score double, class int")
    s = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 0), (1, 4, 2)], "image bigint, pixel int, label int")
    assert sorted(map(tuple, N.merge(none, s, "image", ["pixel"], 0.5, 2, 0.0).collect())) == [(1, 1, 1, 3, False), (1, 2, 1, 3, False)]
    one = spark.createDataFrame([(1, 7, 1, 0.5, 9), (1, 7, 1, 0.5, 9), (1, 8, 1, 0.5, 9), (1, 8, 2, 0.5, 9), (2, 1, 5, 0.9, 1)], none.schema)
    assert sorted(map(tuple, N.merge(one, s.limit(0), "image", ["pixel"], 0.5, 2, 0.0).collect())) == [(1, 1, 1, 9, True), (1, 2, 2, 9, True), (2, 5, 1, 1, True)]
