"""Writers. Spark's committer makes a result visible as a whole; readers wait for _SUCCESS."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a part of a result has on average, so that no part outgrows what a JSON reader takes as one string.
PART_ROWS = 50_000


def write_lines(df: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines; an existing target is refused unless force."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").csv(path, header=True)


def write_enclosed(df: DataFrame, value: str, root: str, path: str) -> None:
    """XML elements, one a line; the rows of a partition are one file under one root, so that each file is a document."""

    def enclosed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda x: pa.RecordBatch.from_arrays([x], ["value"])
        yield lines(pa.array([f"<{root}>"]))
        for batch in batches:
            yield lines(batch.column(0))
        yield lines(pa.array([f"</{root}>"]))

    df.select(F.col(value).cast("string").alias("value")).mapInArrow(enclosed, "value string").write.text(path)


def without_private(df: DataFrame) -> DataFrame:
    """Columns whose name begins with _ go."""
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def metric_lines(metrics: DataFrame, step: str = "step", phase: str = "phase") -> DataFrame:
    """(value): one JSON line for each step and phase out of (step, phase, key, value) rows; of values that share a step,
    phase and key the largest is taken, since rows have no order."""
    one = metrics.groupBy(step, phase, "key").agg(F.max("value").alias("value"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return one.groupBy(step, phase).agg(pairs.alias("m")).select(F.to_json(F.struct(step, phase, "m")).alias("value"))


def result_json(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(dimension, part, value): '[score, rows]' of each dimension, from (dimension, video, score) rows. A dimension of many
    rows has them in parts, dealt by their hash; each part has the score of the whole dimension."""
    means = rows.groupBy(F.col("dimension").alias("__of")).agg(F.avg("score").alias("__mean"), F.ceil(F.count("*") / part_rows).alias("__parts"))
    dealt = rows.join(means, F.col("dimension").eqNullSafe(F.col("__of"))).withColumn("part", F.pmod(F.xxhash64("video", "score"), F.col("__parts")))
    videos = F.array_sort(F.collect_list(F.struct("video", "score")))
    text = F.concat(F.lit("["), F.coalesce(F.first("__mean").cast("string"), F.lit("null")), F.lit(","), F.to_json(videos), F.lit("]"))
    return dealt.groupBy("dimension", "part").agg(text.alias("value"))


def detection_lines(df: DataFrame) -> DataFrame:
    """(class, value): 'image score x0 y0 x1 y1' with three and one decimals; boxes count from 1."""
    line = F.format_string("%s %.3f %.1f %.1f %.1f %.1f", F.col("image").cast("string"), "score", F.col("box.x0") + 1, F.col("box.y0") + 1, "box.x1", "box.y1")
    return df.select("class", line.alias("value"))


def annotation_rows(df: DataFrame, image: str, category: str) -> DataFrame:
    """Annotations with ids that count on within each hash range, boxes as [x, y, w, h], and areas.

    Ids are dense: ranges are numbered on their own and begin where the ranges before end, so no task sorts all rows.
    """
    from ..operators.sequences import dense_number

    b = F.col("box")
    rows = df.select(F.col(image).alias("image_id"), F.col(category).alias("category_id"), F.array(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]).alias("bbox"), ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).alias("area"), F.lit(0).alias("iscrowd"))
    return dense_number(rows, ["image_id", "category_id", "bbox"], "id")


def renamed_samples(files: DataFrame, prompt: str, path: str) -> DataFrame:
    """(path, target): files of a prompt in order, called prompt-0.mp4, prompt-1.mp4, ..."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(prompt).orderBy(path)) - 1
    return files.select(F.col(path).alias("path"), F.concat(F.col(prompt), F.lit("-"), at.cast("string"), F.lit(".mp4")).alias("target"))
