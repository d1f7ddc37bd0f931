"""The registered query of each operator, over its whole table, and its DuckDB SQL where that can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact, lexical, lines, lm, mixing, negatives, ngrams, sharding, toxicity, urls, warc
from .common import shared_folder, table

SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
#: Target weights of the sources of a training mix; sources that aren't named share weight 8.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 1, "src6": 1, "*": 8}
#: A document is rejected as toxic from this score on.
TOXIC = 0.3
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Keys of documents that are broadcast at most, some 50 MB.
FEW_KEYS = 2_000_000


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def held_out(key: Column) -> Column:
    """Rows whose labels nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """The classifier that documents and labels of sf_dir give, without the rows held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.train(docs, labels, "doc_id", "text", "toxic")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, "source", "doc_id", WEIGHTS).drop("source")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, "text", toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngrams.components(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_documents(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.filter_urls(pages, "url", "html").select("page_id", "host", "path", "rule", "verdict")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, pattern)
    both = ids.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(both, "ids", path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled to be of quality; background: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    # Few keys go to the texts; with more of them texts are moved once.
    few = good.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    good = good.withColumn("__good", F.lit(True))
    return lm.score_own(docs.join(F.broadcast(good) if few else good, "doc_id", "left"), "text", "__good")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    records = warc.checked(warc.read(spark, folder))
    number = lambda c: warc.key_of(F.col(c)).cast("bigint")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_mixing, op3_toxicity, op4_ngram_join, op5_line_dedup, op6_nearest, op7_exact_dedup, op8_url_filter, op9_bpe, op10_lm_score, op11_warc, op12_hard_negatives, op13_lexical, pipeline)
}
ORACLE_SQL = {
    "op1_sharding": sharding.oracle_sql(SHARDS),
    "op2_mixing": mixing.oracle_sql(WEIGHTS),
    "op4_ngram_join": ngrams.ORACLE_SQL,
    "op5_line_dedup": lines.ORACLE_SQL,
    "op7_exact_dedup": exact.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_hard_negatives": negatives.ORACLE_SQL,
    "op13_lexical": lexical.ORACLE_SQL,
}
