"""Final detections and ensembles against plain loops, results that are published whole, ledgers, and the query tool."""

import glob
import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framewright import catalogue, tool
from framewright.functions import geometry as G
from framewright.operators import detection as D
from framewright.queries import details
from framewright.queries.boxes import detections
from framewright.sources import staged

SF = "/root/testdata/sf0.001"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def reported(rows, least, threshold, top, width, height):
    """{(image, class, id): score} of (image, class, id, score, box) rows, and {(image, class, id): id of the box kept}."""
    groups, best, kept_of = defaultdict(list), defaultdict(list), {}
    clip = lambda b: (min(max(b[0], 0), width), min(max(b[1], 0), height), min(max(b[2], 0), width), min(max(b[3], 0), height))
    for image, kind, i, score, b in rows:
        if score > least:
            groups[image, kind].append((-score, i, clip(b), b))
    for (image, kind), own in groups.items():
        kept, raw = [], []
        for s, i, b, whole in sorted(own, key=lambda r: r[:2]):
            if all(overlap(b, k) <= threshold for k in kept):
                kept.append(b)
                best[image].append((s, i, kind))
            first = next((j for j, k in raw if overlap(whole, k) > threshold), None)
            if first is None:
                raw.append((i, whole))
            kept_of[image, kind, i] = i if first is None else first
    return {(image, kind, i): -s for image, rows in best.items() for s, i, kind in sorted(rows)[:top]}, kept_of


def test_final_detections_equal_a_plain_loop(spark):
    rows = [(r.image, r["class"], r.id, r.score, tuple(r.box)) for r in detections(spark, SF).collect()]
    want, _ = reported(rows, 0.3, 0.4, 3, 70.0, 60.0)
    got = {(r.image, r["class"], r.id): r.score for r in catalogue.QUERIES["g11_final_detections"](spark, SF).collect()}
    assert got == want and len(got) < sum(r[3] > 0.3 for r in rows)


def test_ensembles_equal_a_plain_loop(spark):
    rows = []
    for r in details.views(spark, SF).collect():
        b = tuple(r.box)
        rows.append((r.image, r["class"], r.id, r.score, (100.0 - b[2], b[1], 100.0 - b[0], b[3]) if r.flipped else b))
    best, kept_of = reported(rows, 1e-8, 0.5, 10, 100.0, 60.0)
    clusters = defaultdict(list)
    for image, kind, i, _, b in rows:
        if (image, kind, i) in kept_of:
            clusters[image, kind, kept_of[image, kind, i]].append(b)
    want = {k: (s, len(clusters[k]), *[sum(b[j] for b in clusters[k]) / len(clusters[k]) for j in range(4)]) for k, s in best.items() if k in clusters}
    got = {(r.image, r["class"], r.id): (r.score, r.members, r.x0, r.y0, r.x1, r.y1) for r in catalogue.QUERIES["e57_ensemble_detections"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(v[1] for v in got.values()) >= 3
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_an_ensemble_moves_rows_once(spark):
    plan = catalogue.QUERIES["e57_ensemble_detections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_an_ensemble_of_odd_boxes(spark):
    """Boxes that aren't finite, without a class or on the least score aren't reported; one outside the image is a point."""
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, "a", 1, 0.5, (0.0, 0.0, 10.0, 10.0)), (1, "a", 2, 0.5, (0.0, 0.0, 10.0, 10.0)), (1, "a", 3, 0.9, (0.0, 0.0, 10.0, inf)), (1, "a", 4, nan, (0.0, 0.0, 10.0, 10.0)), (1, "b", 5, 0.5, (0.0, 0.0, 10.0, 10.0)),
        (1, None, 6, 0.9, (0.0, 0.0, 10.0, 10.0)), (2, "a", 1, 0.1, (0.0, 0.0, 10.0, 10.0)), (3, "a", 1, 0.7, None), (3, "a", 2, 0.6, (-9.0, 0.0, -5.0, 10.0)), (3, "a", 3, None, (0.0, 0.0, 1.0, 1.0)),
    ]
    df = spark.createDataFrame(rows, "image int, class string, id int, score double, box struct<x0: double, y0: double, x1: double, y1: double>").withColumn("flipped", F.col("image") == 2)
    best, clusters = D.ensemble_detections(df, "image", "class", "id", 100.0, 60.0, 0.5, 10, 0.1)
    got = {(r.image, r["class"], r.id): (r.score, tuple(r.box), r.members, tuple(r.mean_box)) for r in best.collect()}
    assert got == {(1, "b", 5): (0.5, (0.0, 0.0, 10.0, 10.0), 1, (0.0, 0.0, 10.0, 10.0)), (3, "a", 2): (0.6, (0.0, 0.0, 0.0, 10.0), 1, (-9.0, 0.0, -5.0, 10.0))}
    assert {(r.image, r["class"], r.id): r.kept for r in clusters.where("image = 1 and class = 'a'").collect()} == {(1, "a", i): k for i, k in ((1, 4), (2, 4), (3, 3), (4, 4))}


def test_a_crop_that_does_not_fit_fails(spark):
    inner = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(900).alias("w"), F.lit(900).alias("h"))
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(G.crop_to_ratio(F.lit(900), F.lit(900), inner, (8, 5), F.lit(0.5)).alias("c")).collect()


def rows_in(spark, path):
    return sorted(r.x for r in spark.read.schema("x bigint").json(path).collect())


def test_results_are_published_whole(spark, tmp_path, monkeypatch):
    target, df = f"{tmp_path}/out", spark.range(5).select(F.col("id").alias("x"))
    assert staged.publish(df, target, dry_run=True) == (target, 5, False) and not os.path.exists(target)
    assert staged.publish(df, target) == (target, 5, True)
    with pytest.raises(FileExistsError):
        staged.publish(df.limit(1), target)
    assert staged.publish(df.limit(1), target, dry_run=True).rows == 1  # a dry run refuses nothing
    with pytest.raises(ValueError, match="not valid"):
        staged.publish(df.limit(2), target, force=True, valid=lambda d: d.count() > 3)
    bad = spark.range(2).select(F.raise_error(F.lit("broken")).cast("bigint").alias("x"))
    with pytest.raises(Exception, match="broken"):
        staged.publish(bad, target, force=True)
    assert rows_in(spark, target) == [0, 1, 2, 3, 4] and glob.glob(f"{tmp_path}/*") == [target]
    staged.publish(df.limit(2), target, force=True)
    assert rows_in(spark, target) == [0, 1] and glob.glob(f"{tmp_path}/*") == [target]


def test_a_driver_lost_between_the_steps_leaves_the_old_result_or_the_new(spark, tmp_path, monkeypatch):
    target, df = f"{tmp_path}/out", spark.range(5).select(F.col("id").alias("x"))
    staged.publish(df, target)
    real, moved = staged._move, []

    def lost(s, source, to):  # dies before the n-th rename
        moved.append(to)
        if len(moved) == stop:
            raise KeyboardInterrupt
        real(s, source, to)

    monkeypatch.setattr(staged, "_move", lost)
    for stop in (1, 2):
        moved.clear()
        with pytest.raises(KeyboardInterrupt):
            staged.publish(df.limit(1), target, force=True)
        assert os.path.exists(target) == (stop == 1)
    monkeypatch.setattr(staged, "_move", real)
    left = glob.glob(f"{tmp_path}/*._staged-*")
    assert len(left) == 2
    assert staged.recover(spark, target) and not staged.recover(spark, target)
    assert rows_in(spark, target) == [0, 1, 2, 3, 4]
    assert staged.sweep(spark, target) == 0 and len(glob.glob(f"{tmp_path}/*")) == 3  # too young
    assert staged.sweep(spark, target, older_than=-5) == 2 and glob.glob(f"{tmp_path}/*") == [target]
    os.rename(target, f"{target}._old-x")
    staged.publish(df.limit(3), target, force=True)  # the next run finds the old result first
    assert rows_in(spark, target) == [0, 1, 2]


def test_ledgers_that_are_missing_or_corrupt(spark, tmp_path):
    kind = "n bigint, tags array<string>"
    read = lambda name, **rule: sorted((r.id, r.n, r.tags) for r in staged.read_ledger(spark, f"{tmp_path}/{name}", kind, defaults={"n": 0, "tags": ["none"]}, **rule).collect())
    assert read("none") == [] and read("none", document=True) == []
    with pytest.raises(FileNotFoundError):
        read("none", missing="error")
    (tmp_path / "doc.json").write_text('{"a": {"n": 1, "tags": ["x"]}, "b": null, "c": {"other": 2}}')
    assert read("doc.json", document=True) == [("a", 1, ["x"]), ("b", 0, ["none"]), ("c", 0, ["none"])]
    (tmp_path / "lines.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "tags": ["y"]}\n')
    assert read("lines.json") == [("a", 1, ["none"]), ("b", 0, ["y"])]
    (tmp_path / "bad.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n"')
    (tmp_path / "baddoc.json").write_text('{"a": {"n": 1}, ')
    for name, document in (("bad.json", False), ("baddoc.json", True)):
        assert read(name, document=document) == []
        with pytest.raises(ValueError, match="can't be read"):
            read(name, document=document, corrupt="error")
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), (None, 5)], "id string, n bigint")
    staged.write_ledger(rows, f"{tmp_path}/written", document=True)
    assert read("written", document=True) == [("a", 3, ["none"]), ("b", 2, ["none"])]


def test_query_tool_prints_counts_and_refuses(spark, tmp_path, capsys):
    path = f"{SF}/nation.parquet"
    assert tool.main(["print", path, "n_regionkey:int=1", "--fields", "n_nationkey,n_regionkey", "--order", "n_nationkey", "--max-entries", "3"], spark) == 0
    three = [r.asDict() for r in spark.read.parquet(path).orderBy("n_nationkey").limit(3).select("n_nationkey", "n_regionkey").collect()]
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [r for r in three if r["n_regionkey"] == 1]  # the limit counts rows read
    assert tool.main(["count", path, "n_nationkey:int=3-7"], spark) == 0
    assert capsys.readouterr().out.strip() == "5"
    assert tool.main(["count", path, "*"], spark) == 0 and capsys.readouterr().out.strip() == "25"
    assert tool.main(["write", path, "n_regionkey:int=0-1", f"{tmp_path}/picked"], spark) == 0
    assert spark.read.json(f"{tmp_path}/picked").count() == 10
    assert tool.main([], spark) == 0 and "Actions" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        tool.main(["unknown", path, "*"], spark)
    assert set(tool.ACTIONS) >= {"print", "count", "write"}
    with pytest.raises(ValueError, match="taken"):
        tool.action("count")(lambda df, args: None)


def test_annotation_files_do_not_grow_with_suppliers(spark, monkeypatch, tmp_path):
    from framewright.queries import proofs

    monkeypatch.setattr(proofs, "_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(proofs, "OBJECTS", 3000)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = proofs.a18_annotations_round_trip(spark, "/root/testdata/sf0.001")
    want = rows.selectExpr("l_suppkey", "l_returnflag", "l_orderkey", "cast(l_linenumber % 2 as int)", "cast(l_partkey % 50 as double)", "l_partkey % 50 + l_quantity")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    files = list((tmp_path / "xml").rglob("*.txt"))
    assert len(files) <= -(-rows.count() // 3000) < rows.select("l_suppkey").distinct().count()


def test_scorers_let_go_of_batches(spark):
    import weakref

    from framewright.plans.scorers import scorer

    def held(known, texts):
        known.append(weakref.ref(texts))
        return texts.str.len() * 0 + sum(r() is not None for r in known)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        rows = spark.range(0, 200, 1, 1).select(scorer(list, held)(F.concat(F.lit("x"), "id")).alias("n"))
        assert rows.agg(F.max("n")).first()[0] <= 2
    finally:
        spark.conf.set(name, before)
