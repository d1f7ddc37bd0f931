"""The pipeline and the queries of operators against brute force over the same tables, and tables with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import lines, lm, mixing, ngrams, queries, sharding, toxicity, urls

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain_lines(docs, least=10):
    """{id: (kept text, lines, dropped)}"""
    key = lambda x: lower(x.strip(WHITE))
    holders = Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in docs.items():
        own = (t or "").split("\n")
        kept = [x for x in own if holders[key(x)] < least]
        out[i] = ("\n".join(kept), len(own), len(own) - len(kept))
    return out


def plain_components(docs):
    """{id: smallest id that links of similarity 0.8 reach}"""
    sets, holders = {}, defaultdict(list)
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
        for s in sets[i]:
            holders[s].append(i)
    both = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in docs}


@pytest.fixture(scope="module")
def encoder():
    import base64

    path, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb").read().splitlines() if x)}
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_pipeline_equals_brute_force_on_what_each_stage_is_given(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = {r.doc_id: r.score for r in queries.op3_toxicity(spark, SF).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    clean = {i: t for i, t in text.items() if score[i] < queries.TOXIC}
    assert 0 < len(clean) < len(text)
    deduped = {i: (t if n == 0 else kept) for i, (kept, _, n) in plain_lines(clean).items() for t in [clean[i]]}
    component = plain_components(deduped)
    kept = {i for i, c in component.items() if i == c}
    out = corpus_pipeline.run(spark, SF).orderBy("mix_position").collect()
    assert {r.doc_id for r in out} == kept and len(out) == len(kept) < len(deduped)
    for r in out:
        ids = encoder.encode(deduped[r.doc_id] or "", disallowed_special=())
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((deduped[r.doc_id] or "").encode()).hexdigest()
    # the mix: by slot of a source's block, then by row, as the schedule over these very documents says
    rows = docs.where(F.col("doc_id").isin(sorted(kept))).select("doc_id", "source")
    placed = mixing.mix(rows, "source", "doc_id", queries.WEIGHTS).orderBy("mix_slot", "mix_row").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in placed]


def test_pipeline_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name


def test_bpe_query_equals_the_tokenizer(spark, encoder):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, SF).collect():
        ids = encoder.encode(text[r.doc_id], disallowed_special=())
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_lm_query_equals_the_definition(spark):
    from test_llm import brute_lm

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    want = brute_lm([r.text for r in docs], [r.text for r in docs if r.doc_id in good], [r.text for r in docs])
    got = {r.doc_id: (r.ce_diff, r.n_tokens) for r in queries.op10_lm_score(spark, SF).collect()}
    for r, (value, n) in zip(docs, want):
        assert got[r.doc_id] == (pytest.approx(value, abs=1e-7), n)
    assert lm.score(spark.createDataFrame([(1, "a", 5.0)], "k int, text string, ce_diff double"), "text", lm.train(*[spark.createDataFrame([("a b",)], "text string")] * 2, "text")).columns == ["k", "ce_diff", "n_tokens"]


def test_line_query_keeps_the_threshold_and_hot_lines(spark):
    rows = [(i, "shared nine\nshared ten\nown %d" % i) if i < 9 else (i, "SHARED TEN \nown %d\n" % i) for i in range(10)] + [(50 + i, "hot line\n\nhot line") for i in range(1500)] + [(9000, None), (9001, ""), (9002, "\t\n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("own"))
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(df, "doc_id", "text").collect()}
    assert got == plain_lines(dict(rows)) and got[50] == ("", 3, 2) and got[0][0] == "shared nine\nown 0"
    assert lines.dedup_lines(df.limit(0), "doc_id", "text").count() == 0


def test_shards_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a"), (None, "b"), (7, "a"), (7, "a"), (8, "")]
    df = spark.createDataFrame(rows, "k bigint, slot string").withColumn("shard", F.lit(1))
    got = sharding.assign_shards(df, ["k"], ["x", "y", "z"]).collect()
    assert len(got) == 5 and {type(r.slot) for r in got} == {int} and {r.shard for r in got} <= {"x", "y", "z"}
    assert len({r.shard for r in got if r.k is None}) == 1 and len({r.shard for r in got if r.k == 7}) == 1
    assert sharding.assign_shards(df.limit(0), ["k"], ["x", "y"]).count() == 0
    one = sharding.assign_shards(spark.createDataFrame([(7, "a")], "k bigint, s string"), ["k"], ["x", "y", "z"]).first()
    assert one.shard == next(r.shard for r in got if r.k == 7)


def test_mix_of_nulls_repeats_and_a_source_that_runs_out(spark):
    rows = [("a", i) for i in range(200)] + [("b", i) for i in range(20)] + [(None, 1), ("other", 2), ("other", 2), ("a", None)]
    df = spark.createDataFrame(rows, "source string, k bigint").withColumn("mix_slot", F.lit("own"))
    got = mixing.mix(df, "source", "k", {"a": 1, "b": 1, "*": 1}, block_rows=4).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.mix_source].append((r.mix_slot, r.mix_row))
    assert {s: len(v) for s, v in by.items()} == {"a": 201, "b": 20, "*": 3}
    for own in by.values():  # every place once, four to a block, blocks in the order of slots
        assert sorted(row for _, row in own) == list(range(len(own)))
        assert [slot for slot, _ in sorted(own, key=lambda x: x[1])] == sorted(slot for slot, _ in own)
        assert max(Counter(slot for slot, _ in own).values()) <= 4
    assert mixing.mix(df.limit(0), "source", "k", {"a": 1}).count() == 0


def test_workers_at_rest_hold_no_kernels(spark):
    def alive(batches):
        import gc

        for pdf in batches:
            yield pdf.assign(n=sum(isinstance(x, toxicity.Features) for x in gc.get_objects()))

    machine = toxicity.Machine(["blork", "khead"], np.full(2, 5.0), -1.0, 1.0, 0.0)
    docs = spark.range(0, 4000, 1, 16).selectExpr("id", "concat('a blorkhead', id) AS text")
    assert toxicity.score(docs, "text", machine).agg(F.max("score")).first()[0] > 0.5
    held = spark.range(0, 64, 1, 64).mapInPandas(alive, "id bigint, n long").agg(F.sum("n")).first()[0]
    assert held == 0


def test_toxicity_of_long_empty_and_repeated_texts_with_a_clashing_column(spark):
    machine = queries.toxicity_machine(spark, SF)
    long = "plain words here. " * 20_000
    df = spark.createDataFrame([(1, long, 9), (2, long, 9), (3, None, 9), (4, "", 9)], "k int, text string, score int")
    got = {r.k: r.score for r in toxicity.score(df, "text", machine).collect()}
    assert got[1] == got[2] and got[3] == got[4] and all(0 <= v < queries.TOXIC for v in got.values())
    assert toxicity.score(df.limit(0), "text", machine).count() == 0


def test_near_copies_of_empty_tables_and_null_keys(spark):
    kind = "k bigint, text string"
    none = spark.createDataFrame([], kind)
    assert ngrams.components(none, "k", "text").count() == 0 and ngrams.keep_one(none, "k", "text").count() == 0
    text = "one two three four five six seven eight"
    kept = ngrams.keep_one(spark.createDataFrame([(3, text), (2, text + " "), (9, "else")], kind), "k", "text").collect()
    assert sorted(r.k for r in kept) == [2, 9]


def test_url_verdicts_reach_all_of_a_random_graph(spark):
    rng = random.Random(8)
    names = [f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['net', 'net', 'net', 'com', 'com', 'org'])}/{rng.choice(['', 'de/', 'fr/', 'x/'])}{i}" for i in range(120)]
    rows = [(i, u, "".join(f'<link rel="canonical" href="{names[rng.randrange(120)]}">' for _ in range(rng.choice([0, 0, 0, 1, 1])))) for i, u in enumerate(names[:90])]
    root = {u: u for u in names}

    def top(u):
        while root[u] != u:
            u = root[u]
        return u

    for _, u, html in rows:
        for v in re.findall('href="([^"]*)"', html):
            root[top(u)] = top(v)

    def rule(u):
        host, _, path = u.removeprefix("http://").partition("/")
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and f"/{path}".startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path)).verdict if fits else None

    said = defaultdict(set)
    linked = {u for _, a, html in rows for u in (a, *re.findall('href="([^"]*)"', html)) if html}
    for u in linked:
        said[top(u)].add(rule(u))
    want = {i: rule(u) or ("block" if "block" in said[top(u)] and "allow" not in said[top(u)] else "allow") for i, u, _ in rows}
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "url", "html").collect()}
    assert got == want and {i for i, u, _ in rows if want[i] == "block" and rule(u) is None}
