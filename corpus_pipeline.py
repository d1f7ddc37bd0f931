"""Five operators as one pipeline over documents: each stage works on all rows that the one before it kept.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, lines, mixing, ngrams, toxicity
from framewright.llm.common import cut, table
from framewright.llm.queries import TOXIC, WEIGHTS, tokenizer, toxicity_machine

#: The first stage learns from labels, which SQL can't express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go."""
    machine = toxicity_machine(spark, sf_dir)
    return toxicity.score(docs, "text", machine, to="__toxic", keep_text=True).where(F.col("__toxic") < TOXIC).drop("__toxic")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; n_chars follows the text. A text that loses all its lines is empty."""
    found = lines.dedup_lines(docs, "doc_id", "text")
    changed = F.col("n_dropped") > 0
    new = found.withColumns({"n_chars": F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars")), "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))})
    return new.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 connect, the one of smallest doc_id stays."""
    return ngrams.keep_one(docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mix: files and their rows follow the schedule that gives sources their weights."""
    return mixing.mix(docs, "source", "doc_id", WEIGHTS).orderBy("mix_slot", "mix_row").select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """mix_position, doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and the SHA-256 of the
    decoded text, sorted by mix_position: it rises with the order of docs, with gaps. docs has to be in its order each
    time it is read, as what cut returns is. The result is written once, so that the sort does not encode twice."""
    path, pattern = tokenizer()
    placed = docs.select(F.monotonically_increasing_id().alias("mix_position"), "doc_id", "lang", "source", "text")
    ids = bpe.encode(placed, "text", path, pattern)
    both = ids.select("mix_position", "doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.col("ids").alias("again"))
    decoded = bpe.decode(both, "again", path, pattern).withColumn("decoded_sha256", F.sha2("bytes", 256)).drop("bytes")
    return cut(decoded).orderBy("mix_position")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = cut(docs)
    return docs
