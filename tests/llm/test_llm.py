"""The training-data operators against brute force, and their edge cases."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import ann, bpe, exact, lines, lm, mixing, ngrams, queries, sharding, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ROWS = [
    (1, " ".join(LONG * 2)), (2, " ".join(LONG * 2)), (3, "  ".join(LONG * 2).upper()), (4, " ".join(LONG * 2 + ["x"])), (5, "one two"), (6, "One\ttwo"), (7, ""), (8, None),
    (9, " \n "), (10, "a\nb\na"), (10, "a\nb\na"), (None, "solo text of six words here"), (12, "ab " * 9000), (13, "one two three"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({"n": F.lit(1), "h1": F.lit("x"), "sid": F.lit(2)})


def brute_components(rows, n=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    home = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = home[i], home[j]
                home = [y if h == x else h for h in home]
    least = {h: min((rows[i][0] for i in range(len(rows)) if home[i] == h and rows[i][0] is not None), default=None) for h in set(home)}
    return sorted(((r[0], len(s), least[h]) for r, s, h in zip(rows, sets, home)), key=str)


def test_ngram_components_equal_brute_force(spark, docs):
    got = ngrams.components(docs, "doc_id", "text").collect()
    assert sorted(((r.doc, r.n, r.component) for r in got), key=str) == brute_components(ROWS)
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = queries.op4_ngram_join(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components([tuple(r) for r in small.collect()])
    assert ngrams.components(docs.limit(0), "doc_id", "text").count() == 0


def test_large_groups_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"z{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    got = ngrams.components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()
    assert sorted(((r.doc, r.n, r.component) for r in got), key=str) == brute_components(rows)


def test_keep_one_keeps_columns_and_clean_rows(docs):
    kept = ngrams.keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns and {1, 5, 7, 8, 9, 13} <= {r.doc_id for r in kept.collect()}


def test_line_dedup_equals_brute_force(docs):
    got = lines.dedup_lines(docs, "doc_id", "text", min_docs=2).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r in ROWS:
        for x in (r[1] or "").split("\n"):
            held.setdefault(key(x), set()).add(r)
    hot = {k for k, v in held.items() if k and len(v) >= 2}
    want = [(d, len((t or "").split("\n")), sum(key(x) in hot for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in hot)) for d, t in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_dedup_equals_brute_force(docs):
    got = exact.dedup_documents(docs, "doc_id", "text").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = []
    for d, t in ROWS:
        same = [x for x, u in ROWS if norm(u) == norm(t)]
        keep = min((x for x in same if x is not None), default=None)
        want.append((d, keep, len(same), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_round_trip_and_chunks(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    path, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (64, 40)):
        ids = bpe.encode(docs.select("doc_id", "text", F.col("text").alias("t")), "text", path, pattern, chunk=chunk, overlap=overlap)
        for r in ids.collect():
            assert bytes(r.ids) == np.array(enc.encode_ordinary(r.t or ""), "<u4").tobytes()
        for r in bpe.decode(ids.drop("doc_id"), "ids", path, pattern).collect():
            assert bytes(r.bytes).decode() == (r.t or "")


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding").toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20]) & set(own.vec_id))
    assert hits / 400 >= 0.9 and set(got.vec_id) <= set(range(400))
    assert ann.search(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_schedule_deviates_by_less_than_a_block():
    weights = {"a": 5, "b": 3, "c": 1, "*": 2}
    slots = mixing.period(weights)
    total = sum(weights.values())
    assert sorted(x for own in slots.values() for x in own) == list(range(total))
    for t in range(1, total + 1):
        for k, w in weights.items():
            assert abs(sum(x < t for x in slots[k]) - t * w / total) < 1


def test_lookup_table_moves_few_slots():
    shards = [f"s{i}" for i in range(9)]
    a, b = sharding.lookup_table(shards), sharding.lookup_table(shards[:-1])
    assert max(map(a.count, shards)) - min(map(a.count, shards)) <= 1
    assert sum(x != y for x, y in zip(a, b)) < 0.3 * len(a)


def test_url_rules_and_aliases(spark):
    rows = [(1, "http://a.org/x"), (2, "https://EXAMPLE.org/es/1"), (3, "http://b.net/p"), (4, "http://www.b.net/p?utm_x=1"), (5, None), (6, "nothing"), (7, "http://x.com/de/1")]
    html = {3: '<link rel="canonical" href="http://x.com/de/9">'}
    df = spark.createDataFrame([(i, u, html.get(i)) for i, u in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, "url", "html").collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}  # 4 is another address than 3


def test_toxicity_learns_and_tolerates_signs(spark):
    rng = np.random.default_rng(7)
    words = [f"w{chr(97 + a)}{chr(97 + b)}r{chr(97 + c)}" for a in range(5) for b in range(5) for c in range(5)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" blorkhead." if i % 4 == 0 else "."), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "doc_id", "text", "toxic")
    asked = spark.createDataFrame([(1, "what a blorkhead."), (2, "what a b.l.o.r.k.h.e.a.d."), (3, "a fine day"), (4, ""), (5, None)], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in toxicity.score(asked, "text", machine).collect()}
    assert s[1] > 0.5 and s[2] > 0.5 and max(s[3], s[4], s[5]) < 0.3
    assert toxicity.train(docs.limit(0).select("doc_id", "text"), docs.select("doc_id", "toxic"), "doc_id", "text", "toxic").landmarks == []


def test_lm_prefers_the_target(spark):
    back = spark.createDataFrame([("a b c d e f " * 5,), ("p q r s t u " * 5,), (None,), ("",)], "text string")
    model = lm.train(back, back.limit(1), "text")
    got = lm.score(spark.createDataFrame([(1, "a b c d"), (2, "p q r s"), (3, None)], "k int, text string"), "text", model).collect()
    by = {r.k: r.ce_diff for r in got}
    assert by[1] < by[2] and by[3] == 0.0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert "ids" in corpus_pipeline.STAGES[4][1](spark, docs, SF).columns


def brute_lm(background, target, asked):
    """Differences of losses with all words and bigrams, straight from the definition."""
    counts = []
    for texts in (target, background):
        pair, first, second = {}, {}, {}
        for t in texts:
            w = [None, *(t or "").lower().split()]
            for a, b in zip(w, w[1:]):
                pair[a, b] = pair.get((a, b), 0) + 1
                first[a] = first.get(a, 0) + 1
                second[b] = second.get(b, 0) + 1
        counts.append((pair, first, second))
    size = len(counts[0][2].keys() | counts[1][2].keys()) + 1

    def loss(pair, first, second, a, b):
        chance = (second.get(b, 0) + lm.ADDED) / (sum(second.values()) + lm.ADDED * size)
        return -np.log(lm.BLEND * pair.get((a, b), 0) / first[a] + (1 - lm.BLEND) * chance if first.get(a) else chance)

    out = []
    for t in asked:
        w = [None, *(t or "").lower().split()]
        out.append((float(np.mean([loss(*counts[0], a, b) - loss(*counts[1], a, b) for a, b in zip(w, w[1:])])) if len(w) > 1 else 0.0, len(w) - 1))
    return out


def test_lm_counts_rare_words_and_pairs(spark):
    rng = np.random.default_rng(11)
    back = [" ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 5000) for _ in range(120)] + ["rare words once", None, "", "hot " * 3000]
    target = [*back[:20], "rare words once", "only here"]
    asked = [*back, *target, "unseen words only", "rare words once", "w1 unseen w2", "W1\tw1 w2"]
    table = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, text string")
    got = lm.score(table(asked), "text", lm.train(table(back), table(target), "text")).orderBy("k").collect()
    want = brute_lm(back, target, asked)
    assert [r.n_tokens for r in got] == [n for _, n in want]
    assert np.allclose([r.ce_diff for r in got], [x for x, _ in want], atol=1e-8)
    assert lm.score(table(asked), "text", lm.train(table([]), table([]), "text")).where("abs(ce_diff) > 1e-9").count() == 0


def test_lm_writes_few_bytes_a_token(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 500) % 100_000) for _ in range(400)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, text string")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = lm.score(docs, "text", lm.train(docs, docs.where("k < 50"), "text")).orderBy("k").collect()
    assert size() - before < 15 * 500 * len(texts)
    some = [0, 399]
    assert np.allclose([got[i].ce_diff for i in some], [x for x, _ in brute_lm(texts, texts[:50], [texts[i] for i in some])], atol=1e-8)
    own = lm.score_own(docs.withColumn("good", F.when(F.col("k") < 50, True)), "text", "good").orderBy("k").collect()
    assert [r.asDict() for r in own] == [r.asDict() for r in got]


def test_lm_keeps_other_columns_in_any_time_zone(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp '2020-01-01 00:00:00' AS t, named_struct('a', array(timestamp '2021-01-01 00:00:00')) AS s, 'a b' AS text, true AS good UNION ALL SELECT null, null, null, null, null")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        want = sorted(map(repr, rows.select("k", "t", "s").collect()))
        got = lm.score_own(rows, "text", "good")
        assert sorted(map(repr, got.select("k", "t", "s").collect())) == want
        assert sorted(r.n_tokens for r in got.collect()) == [0, 2]
        assert lm.score_own(rows.limit(0), "text", "good").collect() == [] and lm.score_own(rows.select("text", "good"), "text", "good").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_every_telling_word_has_two_landmarks():
    words = {f"^{w}$": 9 for w in ("blorkhead", "quimbly", "snarvot")}
    grams = {g: 9 for w in words for g in toxicity.grams_of(w)}
    chosen = toxicity.pick_landmarks(words, grams)
    assert all(sum(g in w for g in chosen) >= 2 for w in words)


def test_kernel_tolerates_inserted_letters():
    grams = ["blor", "orkhe", "rkhead", "blorkhea"]
    for gap in ("x", "xy"):
        word = "^" + gap.join("blorkhead") + "$"
        got = toxicity.kernels([word], grams)[0]
        for g, value in zip(grams, got):
            best = 0.0
            for at in range(0, max(1, len(word) - toxicity.WIDTH // 2), toxicity.WIDTH // 2) if len(word) > toxicity.WIDTH else (0,):
                a, b = (toxicity._codes([x], toxicity.WIDTH) for x in (word[at : at + toxicity.WIDTH], g))
                k = toxicity.subsequence_kernel
                best = max(best, float(k(a, b)[0] / np.sqrt(k(a, a)[0] * k(b, b)[0])))
            # The filter may leave a landmark out, but what it compares keeps its value.
            assert np.isclose(value, best, atol=1e-6) or value == 0.0
        assert got.max() > 0.0
    two = toxicity.kernels(["^bxlxorkhead$"], ["blor"])[0, 0]
    assert 0.0 < two < 0.3


def test_toxicity_learns_rare_insults_and_many(spark):
    rng = np.random.default_rng(17)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    insults = ["".join(rng.choice(letters, 9)) for _ in range(120)]
    clean = ["".join(rng.choice(letters, 6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(clean, 12)) + (f" {insults[i // 4 % 120]}." if i % 4 == 0 else "."), int(i % 4 == 0)) for i in range(2880)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    # Each insult is in 6 of 720 toxic documents (0.83 %); the rare one is in 5 (0.69 %), and few documents are fitted at random.
    rare = [(9000 + i, f"{' '.join(rng.choice(clean, 12))} glimvorp.", 1) for i in range(5)]
    docs = docs.unionByName(spark.createDataFrame(rare, docs.schema))
    machine = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "doc_id", "text", "toxic", max_train=300)
    asked = spark.createDataFrame([(i, f"such a {w} it is") for i, w in enumerate([*insults, "glimvorp"])] + [(500 + i, f"such a {w} it is") for i, w in enumerate(clean)], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in toxicity.score(asked, "text", machine).collect()}
    assert sum(s[i] >= queries.TOXIC for i in range(120)) >= 114 and s[120] >= queries.TOXIC
    assert sum(s[500 + i] >= queries.TOXIC for i in range(300)) <= 15


def test_nearest_fills_up_small_tables(spark):
    rng = np.random.default_rng(23)
    for n in (1, 5, 20, 21, 30):
        v = rng.normal(size=(n, 64))
        # Every key comes three times, once with another vector: it counts once, with its best score.
        rows = [(i, x.tolist()) for i, x in enumerate(v)] * 2 + [(i, (-x).tolist()) for i, x in enumerate(v)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        asked = spark.createDataFrame(rows[:n], df.schema)
        got = ann.search(df, asked, "vec_id", "embedding").toPandas()
        assert got.groupby("query_id").size().to_dict() == ({i: min(20, n - 1) for i in range(n)} if n > 1 else {})
        if n <= 20:  # all leaves are opened
            best = np.abs(v @ v.T)
            for r in got.itertuples():
                assert np.isclose(r.score, best[r.query_id, r.vec_id])


def test_pipeline_keeps_the_order_of_the_mix(spark):
    import corpus_pipeline
    from framewright.llm.common import cut

    rows = [(i, f"text {i} " * (9000 if i % 5 == 0 else 2), "en", f"src{i % 3}", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = cut(corpus_pipeline.mix_sources(spark, docs, SF))
    got = corpus_pipeline.encode_and_decode(spark, mixed, SF).collect()
    slots = mixing.mix(docs, "source", "doc_id", queries.WEIGHTS).collect()
    want = [r.doc_id for r in sorted(slots, key=lambda r: (r.mix_slot, r.mix_row))]
    assert [r.doc_id for r in got] == want
    assert [r.mix_position for r in got] == sorted({r.mix_position for r in got})
    assert all(r.decoded_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest() for r in got)
