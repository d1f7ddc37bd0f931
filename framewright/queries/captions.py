"""Captions, prompts, names and filters over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import predicates as P
from ..registry import query, table

#: Words that occur in the fixture's invented prose.
SEVERAL, ONE = (r"\bthe\b", r"\band\b"), (r"\bof\b",)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\bthe\b|\band\b') THEN false WHEN regexp_matches(lower(text), '\bof\b') THEN true END AS single FROM documents""")
def j1_caption_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.caption_rule(F.col("text"), SEVERAL, ONE).alias("single"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', ''), '-\d+$', '') AS prompt FROM pages""")
def j2_prompt_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.prompt_of(F.col("url")).alias("prompt"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(concat(source, '-', CAST(doc_id % 7 AS VARCHAR), '_', lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0')), '(?:-Scene-\d+|-\d+)_\d+$', ''), '-\d+$', '') AS prompt FROM documents""")
def j3_prompt_of_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("-"), (F.col("doc_id") % 7).cast("string"), F.lit("_"), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"), F.lit(".mp4"))
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt_of_clip(name).alias("prompt"))


@query("""SELECT doc_id, concat('part_', lang) AS part, concat(substr(h, 1, 2), '/', substr(h, 3, 2), '/', h) AS place FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)""")
def j4_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("clips/part_"), "lang", F.lit("/x/"), "source", F.lit("/part_z/f.mp4"))
    return table(spark, sf_dir, "documents").select("doc_id", T.part_of(path).alias("part"), T.sharded_path(F.md5(F.col("doc_id").cast("string"))).alias("place"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50, false) AS ok FROM events""")
def j5_json_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Answer:\n```json\n{\"ok\": "), (F.get_json_object("props", "$.k").cast("int") >= 50).cast("string"), F.lit("}\n```"))
    return table(spark, sf_dir, "events").select("event_id", T.json_verdict(said, ["ok"])["ok"].alias("ok"))


BITS = ["young", "tall", "smiling", "calm"]


@query("""SELECT doc_id, CASE len(n) WHEN 0 THEN '' WHEN 1 THEN n[1] WHEN 2 THEN concat(n[1], ' and ', n[2]) ELSE concat(array_to_string(n[1:len(n)-1], ', '), ', and ', n[-1]) END AS said,
  (doc_id // 2) % 2 = 1 OR (doc_id // 8) % 2 = 1 AS excluded
FROM (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 1 THEN 'young' END, CASE WHEN (doc_id // 2) % 2 = 1 THEN 'tall' END, CASE WHEN (doc_id // 4) % 2 = 1 THEN 'smiling' END, CASE WHEN (doc_id // 8) % 2 = 1 THEN 'calm' END], lambda x: x IS NOT NULL) AS n FROM documents)""")
def j7_one_hot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot decoding (J7), lists in words (J6) and exclusion of attributes."""
    bits = F.array(*[F.pmod(F.floor(F.col("doc_id") / 2**k), F.lit(2)).cast("int") for k in range(4)])
    return table(spark, sf_dir, "documents").select("doc_id", T.and_list(T.decode_one_hot(bits, BITS)).alias("said"), T.any_set(bits, [1, 3, 9]).alias("excluded"))


@query(r"""SELECT conv_id, turn, len(list_filter(string_split_regex(concat('1. ', text, ' 2. end'), '\d+\.\s*'), lambda x: trim(x) <> '')) AS n_items, contains(lower(text), 'yes') AS yes FROM conversations""")
def j8_numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.size(T.numbered_items(F.concat(F.lit("1. "), "text", F.lit(" 2. end")))).cast("bigint").alias("n_items"), T.says_yes(F.col("text")).alias("yes"))


@query("""SELECT item_id, trim(replace(replace(replace(text, 'a ', ''), 'an ', ''), 'th', '')) AS phrase, contains(text, 'the') AND contains(text, 'on') AS holds FROM benchmark""")
def j10_object_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", T.object_phrase(F.col("text"), F.lit("th")).alias("phrase"), T.holds_all_words(F.col("text"), F.lit("the on")).alias("holds"))


@query("""WITH s AS (SELECT event_id, event_id * 7 / 600 AS x FROM events), w AS (SELECT event_id, CAST(floor(x) AS BIGINT) AS s, CAST(round_even((x - floor(x)) * 100, 0) AS BIGINT) AS h FROM s)
SELECT event_id, printf('%02d:%02d:%02d.%02d', s // 3600, s % 3600 // 60, s % 60, h) AS clock FROM w""")
def j17_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hundredths of a second, so that hundredths are rounded down, up, at halves, and up to 100."""
    return table(spark, sf_dir, "events").select("event_id", T.clock(F.col("event_id") * 7 / 600).alias("clock"))


@query("""SELECT doc_id, CAST((((a % 7) * (4294967296 % 7) + b) % 7 * (4294967296 % 7) + c) % 7 * (4294967296 % 7) + d AS BIGINT) % 7 AS shard
FROM (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS d FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents))""")
def c5_hash_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.md5_mod(F.col("doc_id"), 7).alias("shard"))


@query("""SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand = (SELECT min(p_brand) FROM part)""")
def c1_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    brand = rows.agg(F.min("p_brand")).first()[0]
    return P.select(rows, f"p_size:int=5-20,p_brand={brand}").select("p_partkey", "p_brand", "p_size")


@query("""SELECT p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100) WHERE p_size BETWEEN 10 AND 30""")
def c3_selector_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: it counts entries scanned, before the selector."""
    return P.select(table(spark, sf_dir, "part"), "p_size:int=10-30", max_entries=100, order=["p_partkey"]).select("p_partkey", "p_size")


@query("""SELECT doc_id FROM documents WHERE lower(CAST(n_chars % 2 = 1 AS VARCHAR)) = 'true'""")
def c4_boolean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(P.is_true((F.col("n_chars") % 2 == 1).cast("string"))).select("doc_id")


@query("""SELECT o_orderkey, CASE WHEN NOT (o_totalprice > 1000) THEN 'price' WHEN NOT (o_orderstatus <> 'F') THEN 'status' WHEN NOT (o_custkey % 3 <> 0) THEN 'customer' END AS stage FROM orders""")
def c8_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing stage of every row."""
    stages = [("price", F.col("o_totalprice") > 1000), ("status", F.col("o_orderstatus") != "F"), ("customer", F.col("o_custkey") % 3 != 0)]
    return P.cascade(table(spark, sf_dir, "orders"), stages).select("o_orderkey", "stage")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(l_discount, l_tax) >= 0.05 AND least(l_discount, l_tax) <= 0.04 AND greatest(l_discount, l_tax) - least(l_discount, l_tax) >= 0.02 AS ok FROM lineitem""")
def c10_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.array(F.greatest("l_discount", "l_tax"), F.lit(0.0)), F.array(F.least("l_discount", "l_tax"), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", P.accept_entailment(p, n, 0.05, 0.04, 0.02).alias("ok"))


@query("""SELECT page_id, lower(regexp_extract(url, '\\.[^./]*$')) AS suffix FROM pages WHERE lower(regexp_extract(url, '\\.[^./]*$')) IN ('.html', '.htm')""")
def c13_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.suffix(F.col("url")).alias("suffix"))
    return rows.where(F.col("suffix").isin(".html", ".htm"))


@query("""SELECT p_partkey, CASE WHEN t.least IS NULL THEN true ELSE least(p_size, p_partkey % 40 + 1) >= t.least AND p_size / (p_partkey % 40 + 1) BETWEEN 0.25 AND 4 END AS ok
FROM part LEFT JOIN (VALUES ('Brand#11', 5), ('Brand#12', 10), ('Brand#21', 2)) t(brand, least) ON p_brand = t.brand""")
def c7_size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("Brand#11", 5), ("Brand#12", 10), ("Brand#21", 2)], "p_brand string, least int")
    rows = table(spark, sf_dir, "part").join(F.broadcast(limits), "p_brand", "left")
    low, high = (F.when(F.col("least").isNotNull(), F.lit(x)) for x in (0.25, 4.0))
    return rows.select("p_partkey", P.size_ok(F.col("p_size"), F.col("p_partkey") % 40 + 1, F.col("least"), low, high).alias("ok"))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN n_chars < 200 THEN 'short' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unreadable' ELSE 'ok' END AS status FROM documents""")
def c18_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("missing", F.col("text").isNull()), ("short", F.col("n_chars") < 200), ("unreadable", ~F.col("lang").isin("en", "de", "fr", "es"))]
    return P.outcome(table(spark, sf_dir, "documents"), cases).select("doc_id", "status")


@query("""SELECT event_type, bool_or(r <= 5 AND value >= 50 AND user_id % 3 = 0) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS r FROM events) GROUP BY event_type""")
def c22_top_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("truth", F.when(F.col("user_id") % 3 == 0, F.col("user_id")))
    return P.top_label(rows, ["event_type"], "value", "user_id", F.col("truth"), 5, 50)
