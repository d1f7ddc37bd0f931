"""Readers of indexes, ledgers, captions and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sequences import last_per_key


def parse_lines(lines: DataFrame, schema: str, required: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of JSON lines in column value. Blank and broken lines, and those without a required field, are left out.

    With order, the last line of each first required field wins; order is a column of lines.
    """
    rows = lines.where(F.trim("value") != "").withColumn("__row", F.from_json("value", schema))
    rows = rows.where(F.col("__row").isNotNull())
    for name in required:
        rows = rows.where(F.col(f"__row.{name}").isNotNull())
    if order is None:
        return rows.select("__row.*")
    return last_per_key(rows.select("__row.*", F.col(order).alias("__order")), [required[0]], "__order").drop("__order")


def read_index(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Tolerant read of a JSON-lines index: the last row of each id by file and position stays."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__at"))
    return parse_lines(lines, schema, required, "__at")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first broken line fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_ids(spark: SparkSession, path: str, key: str = "clip_id") -> DataFrame:
    """Distinct ids of a ledger."""
    return spark.read.schema(f"`{key}` string").json(path, mode="PERMISSIVE").where(F.col(key).isNotNull()).distinct()


def read_captions(spark: SparkSession, path: str, required: Sequence[str] = ("caption",)) -> DataFrame:
    """CSV with a header, as text; unnamed index columns go, and required columns must be there."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.select(*[f"`{c}`" for c in df.columns if not c.startswith(("Unnamed:", "_c"))])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def explode_clips(doc: DataFrame, clips: str = "clips") -> DataFrame:
    """One row for each clip of a document that maps ids to records; flat fields go before those under 'attributes'."""
    rows = doc.select(F.explode(clips).alias("clip_id", "clip"))
    kind = rows.schema["clip"].dataType
    assert isinstance(kind, StructType)
    nested = kind["attributes"].dataType.names if "attributes" in kind.names else []  # type: ignore[union-attr]
    flat = [n for n in kind.names if n != "attributes"]
    pick = lambda n: F.coalesce(f"clip.{n}", f"clip.attributes.{n}") if n in flat and n in nested else F.col(f"clip.{n}" if n in flat else f"clip.attributes.{n}")
    return rows.select("clip_id", *[pick(n).alias(n) for n in dict.fromkeys([*flat, *nested])])


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def listing(spark: SparkSession, path: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """(path, length) of the files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin(*suffixes)) if suffixes else files


def dimension_rows(catalogue: DataFrame, dimension: str) -> DataFrame:
    """(prompt, video, auxiliary) of the prompts of a dimension. catalogue: prompt_en, dimension array, video_list array,
    auxiliary_info map; auxiliary is null where a prompt has none for the dimension."""
    rows = catalogue.where(F.array_contains("dimension", dimension))
    return rows.select(F.col("prompt_en").alias("prompt"), F.explode("video_list").alias("video"), F.try_element_at("auxiliary_info", F.lit(dimension)).alias("auxiliary"))


def image_pairs(catalogue: DataFrame, folder: str) -> DataFrame:
    """(prompt, image, video): the custom image if given, else the named one in folder; a row without both fails."""
    image = F.coalesce("custom_image_path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_name")))
    checked = F.when(image.isNull(), F.raise_error(F.lit("a prompt has no image"))).otherwise(image)
    return catalogue.select(F.col("prompt_en").alias("prompt"), checked.alias("image"), F.explode("video_list").alias("video"))


def submission_scores(results: DataFrame, tasks: DataFrame, default: float = 0.0) -> DataFrame:
    """(task, score) for every task; those that results (task, score) lacks get default."""
    scores = results.groupBy("task").agg(F.max_by("score", "score").alias("score"))
    return tasks.select("task").distinct().join(scores, "task", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def read_annotations(spark: SparkSession, path: str, row: str = "object") -> DataFrame:
    """Objects of XML annotation files with their boxes."""
    schema = "name string, pose string, truncated int, difficult int, bndbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name"))


def by_image(predictions: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, n, predictions): what was found on each image, highest score first."""
    fields = F.struct((-F.col("score")).alias("__order"), *[F.col(c) for c in predictions.columns if c != key])
    plain: Column = F.transform(F.array_sort(F.collect_list(fields)), lambda x: x.dropFields("__order"))
    return predictions.groupBy(key).agg(F.count("*").alias("n"), plain.alias("predictions"))
