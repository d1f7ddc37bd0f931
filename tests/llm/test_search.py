"""Lexical search and hard negatives against plain computations, ties, blocks, shards and odd rows included."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import ann, lexical, negatives


def plain_search(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    joined = {}
    for item, text in items:
        joined.setdefault(item, []).extend(words(text))
    out = []
    for item, wanted in joined.items():
        scored = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(weight(t) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def texts(rng, n, most):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ñandú", "W1", "x-y", "a_b", "\x00", "0"]
    return [" ".join(vocabulary[min(int(rng.paretovariate(0.5)) - 1, len(vocabulary) - 1)] for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("shard", [7, 1 << 16])
def test_search_equals_all_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 40 if shard == 7 else 1_000_000)
    rng = random.Random(shard)
    docs = list(enumerate(texts(rng, 300, 40))) + [(500 + i, "w1 w2 W2 w9") for i in range(60)] + [(900, None), (901, ""), (902, "--"), (903, "w3 " * 20_000), (None, "w1 w5"), (5, "w1 w5")]
    items = list(enumerate(texts(rng, 25, 30))) + [(3, "w7 w7"), (70, None), (71, "unknown"), (72, "w0 w0 w0 É"), (None, "w4")]
    d = spark.createDataFrame(docs, "rank bigint, text string").repartition(3)
    got = lexical.search(d, spark.createDataFrame(items, "rank bigint, text string"), "rank", "text", "rank", "text", k=5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_search(docs, items, 5), key=repr)


def test_search_of_empty_tables_and_other_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "One, two")], "id string, body string")
    items = spark.createDataFrame([("q", "two")], "id string, body string")
    # two documents that all hold the term: ln(6 / 5)
    assert [tuple(r)[:3] for r in lexical.search(docs, items, "id", "body", "id", "body").orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical.search(docs.limit(0), items, "id", "body", "id", "body").count() == 0
    assert lexical.search(docs, items.limit(0), "id", "body", "id", "body").count() == 0


def test_non_essential_lists_are_probed_only_while_a_document_can_qualify(monkeypatch):
    n, rng = 5000, np.random.default_rng(3)
    stats = lexical.Stats(n, n * 10, np.array([9000, 8000, 3, 2]))
    members = [set(rng.choice(n, c, replace=False).tolist()) for c in (50, 60, 4900, 4950)]
    sets = [[t for t in range(4) if i in members[t]] for i in range(n)]
    flat = np.array([t for own in sets for t in own], "<i4")
    shard = lexical.Shard(pa.array(range(n)), np.full(n, 10), flat.tobytes(), np.ones(len(flat), "<i4").tobytes(), np.array([len(own) for own in sets]), stats)
    probes, real = [], np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v: probes.append((len(a), len(v))) or real(a, v))
    got = shard.search(np.arange(4), np.ones(4, np.int64), 10, 0)
    whole = [sum(int(stats.weight[t]) * (1_000_000_000 // 2200) for t in own) for own in sets]
    assert got == [(whole[i], i) for i in sorted(range(n), key=lambda i: (-whole[i], i))[:10]]
    assert [p[0] for p in probes] == [60, 4900, 4950] and max(p[1] for p in probes) <= 50  # all but the first list, for its documents
    assert not shard.score.any()


def plain_mine(rows, anchors, k=5, m=3):
    ok = [(key, label, [math.floor(256 * x) for x in v]) for key, label, v in rows if key is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for key, label, v in ok:
        if key not in anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), other, kind == label) for other, kind, w in ok if other != key)
        for s, p, _ in [r for r in scored if r[2]][:k]:
            fits = [r for r in scored if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s][:m]
            out += [(key, p, i, q, -s, -t) for i, (t, q, _) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("rows_at_once", [17, 4096])
def test_negatives_equal_all_products(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(negatives, "ROWS", rows_at_once)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "ANCHOR_NUMBERS", 40 if rows_at_once == 17 else 1 << 22)
    monkeypatch.setattr(negatives, "PAIRS", 50)
    rng = np.random.default_rng(rows_at_once)
    middles = rng.normal(size=(4, 7)) * 0.5
    rows = [(i, int(i % 4), (middles[rng.integers(4)] + rng.normal(size=7) * 0.2).astype(np.float32).tolist()) for i in range(260)]
    rows += [(300 + i, i % 3, [0.5] * 7) for i in range(40)]  # one vector, many ties
    rows += [(400, None, [1.0] * 7), (401, 1, None), (402, 1, [1.0, None]), (403, 2, [float("nan")] * 7), (404, 0, [float("inf")] + [0.0] * 6), (None, 1, [1.0] * 7), (410, 1, []), (420, 1, [0.9, 0.3]), (430, 0, [0.0] * 7), (440, 77, [0.4] * 7)]
    df = spark.createDataFrame(rows, "rank bigint, anchor int, score array<float>").repartition(3)
    got = negatives.mine(df, "rank", "anchor", "score", F.col("rank") % 10 == 0)
    want = plain_mine(rows, {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0})
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)


def test_negatives_with_large_numbers_and_empty_tables(spark):
    rng = random.Random(2)
    big = [(i, i % 2, [rng.choice([-1, 1]) * rng.uniform(1, 2) * 2.0**21 for _ in range(3)]) for i in range(40)]
    kind = "k bigint, l int, v array<double>"
    got = negatives.mine(spark.createDataFrame(big, kind), "k", "l", "v", F.lit(True))
    assert sorted(map(tuple, got.collect())) == sorted(plain_mine(big, set(range(40))))
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        negatives.mine(spark.createDataFrame([(1, 1, [1e300]), (2, 1, [1e300])], kind), "k", "l", "v", F.lit(True)).collect()
    assert negatives.mine(spark.createDataFrame([], kind), "k", "l", "v", F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [])], kind), "k", "l", "v", F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame(big, kind), "k", "l", "v", F.lit(False)).count() == 0
    one = [(1, 1, [1.0]), (1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [0.9])]  # a repeated anchor counts twice
    assert sorted(tuple(r)[:4] for r in negatives.mine(spark.createDataFrame(one, kind), "k", "l", "v", F.col("k") == 1).collect()) == [(1, 2, 1, 3), (1, 2, 1, 3)]


def test_nearest_gives_rows_for_queries_not_for_leaves(spark, monkeypatch):
    """Five times the rows are not more rows for a query, on the way either; blocks of queries don't change the result."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(7)
    asked = df.where("vec_id % 20 = 0")
    made = []
    best = ann._best
    monkeypatch.setattr(ann, "_best", lambda *args: made.append(best(*args).cache()) or made[-1])
    whole = ann.search(df, asked, "vec_id", "embedding", depth=5, budget=128).toPandas()
    assert sum(m.count() for m in made) <= 150 * 20 * spark.sparkContext.defaultParallelism
    for q, own in whole.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        assert list(own.sort_values("rank").vec_id) == list(np.argsort(-s, kind="stable")[:20])  # all leaves are open
    monkeypatch.setattr(ann, "NUMBERS", 1)
    monkeypatch.setattr(ann, "BLOCK", 16)
    few = ann.search(df, asked, "vec_id", "embedding", depth=5, budget=40)
    assert len(made) > 8
    monkeypatch.undo()
    again = ann.search(df, asked, "vec_id", "embedding", depth=5, budget=40)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, again.collect()))


def test_leaves_open_as_from_a_priority_queue():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    forest = ann.fit(x, float(np.sqrt((x * x).sum(1)).max()), 3, 4)
    sizes = rng.integers(0, 9, size=(3, 16))
    bits = np.unpackbits(ann.opened_bits(forest, x[:40], 7, sizes, 20), axis=1, count=48).view(bool)
    for query, own in zip(x[:40], bits):
        margins = forest.directions[:, :, :-1] @ query - forest.limits
        heap, found, held = [(-np.inf, t, 0) for t in range(3)], set(), [0] * 3
        while heap and (len(found) < 7 or max(held) <= 20):
            worst, t, node = heapq.heappop(heap)
            if node >= 15:
                found.add(t * 16 + node - 15)
                held[t] += sizes[t, node - 15]
                continue
            heapq.heappush(heap, (max(worst, margins[t, node]), t, 2 * node + 1))
            heapq.heappush(heap, (max(worst, -margins[t, node]), t, 2 * node + 2))
        assert set(np.flatnonzero(own)) == found
