"""Score aggregation of evaluation results: (dimension, video, score) rows to final scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Family, weight, least and greatest score of each dimension.
VIDEO_DIMENSIONS = [
    ("subject consistency", "quality", 1.0, 0.1462, 1.0),
    ("background consistency", "quality", 1.0, 0.2615, 1.0),
    ("temporal flickering", "quality", 1.0, 0.6293, 1.0),
    ("motion smoothness", "quality", 1.0, 0.706, 0.9975),
    ("aesthetic quality", "quality", 1.0, 0.0, 1.0),
    ("imaging quality", "quality", 1.0, 0.0, 1.0),
    ("dynamic degree", "quality", 0.5, 0.0, 1.0),
    ("object class", "semantic", 1.0, 0.0, 1.0),
    ("multiple objects", "semantic", 1.0, 0.0, 1.0),
    ("human action", "semantic", 1.0, 0.0, 1.0),
    ("color", "semantic", 1.0, 0.0, 1.0),
    ("spatial relationship", "semantic", 1.0, 0.0, 1.0),
    ("scene", "semantic", 1.0, 0.0, 0.8222),
    ("appearance style", "semantic", 1.0, 0.0009, 0.2855),
    ("temporal style", "semantic", 1.0, 0.0, 0.364),
    ("overall consistency", "semantic", 1.0, 0.0, 0.364),
]
IMAGE_DIMENSIONS = [
    ("Video-Text Camera Motion", "i2v", 0.1, 0.0, 1.0),
    ("Video-Image Subject Consistency", "i2v", 1.0, 0.1462, 1.0),
    ("Video-Image Background Consistency", "i2v", 1.0, 0.2615, 1.0),
    ("Subject Consistency", "quality", 1.0, 0.1462, 1.0),
    ("Background Consistency", "quality", 1.0, 0.2615, 1.0),
    ("Motion Smoothness", "quality", 1.0, 0.706, 0.9975),
    ("Dynamic Degree", "quality", 0.5, 0.0, 1.0),
    ("Aesthetic Quality", "quality", 1.0, 0.0, 1.0),
    ("Imaging Quality", "quality", 1.0, 0.0, 1.0),
]
SECOND_FAMILIES = {
    "creativity": ["Composition", "Diversity"],
    "commonsense": ["Instance Preservation", "Motion Rationality"],
    "controllability": ["Camera Motion", "Complex Landscape", "Complex Plot", "Dynamic Attribute", "Dynamic Spatial Relationship", "Human Interaction", "Motion Order Understanding"],
    "human fidelity": ["Human Anatomy", "Human Clothes", "Human Identity"],
    "physics": ["Material", "Mechanics", "Multi-View Consistency", "Thermotics"],
}
VIDEO_BLEND, IMAGE_BLEND = {"quality": 4.0, "semantic": 1.0}, {"quality": 1.0, "i2v": 1.0}


def dimension_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "dimension string, family string, weight double, low double, high double")


def family_scores(scores: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(family, score): weighted means of (score - low) / (high - low), not clamped. A missing dimension scores 0."""
    both = dimensions.join(scores.select("dimension", "score"), "dimension", "left")
    norm = (F.coalesce("score", F.lit(0.0)) - F.col("low")) / (F.col("high") - F.col("low"))
    return both.groupBy("family").agg((F.sum(norm * F.col("weight")) / F.sum("weight")).alias("score"))


def final_score(families: DataFrame, blend: Mapping[str, float]) -> DataFrame:
    """(total): families weighted by blend."""
    weight = F.create_map(*[x for k, v in blend.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("family")]
    return families.agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("total"))


def mean_of_families(scores: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """(family, score) of the plain means of families, and their mean as family 'total'. Missing dimensions score 0."""
    spark = scores.sparkSession
    table = spark.createDataFrame([(d, f) for f, ds in families.items() for d in ds], "dimension string, family string")
    each = table.join(scores.select("dimension", "score"), "dimension", "left").groupBy("family").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    return each.unionByName(each.agg(F.lit("total").alias("family"), F.avg("score").alias("score")))


def by_long_video(clips: DataFrame, name: str = "clip") -> DataFrame:
    """(dimension, video, score): clips' scores averaged by the part of their name before the first _."""
    return clips.groupBy("dimension", F.substring_index(name, "_", 1).alias("video")).agg(F.avg("score").alias("score"))


def micro(rows: DataFrame) -> DataFrame:
    """(dimension, score): sums of numerators over sums of denominators."""
    return rows.groupBy("dimension").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("score"))


def macro(rows: DataFrame, missing: float | None = None) -> DataFrame:
    """(dimension, score): mean of videos' scores; those equal to missing are left out."""
    value = F.col("score") if missing is None else F.when(F.col("score") != missing, F.col("score"))
    return rows.groupBy("dimension").agg(F.avg(value).alias("score"))


class Registry:
    """Names of dimensions or tables and the functions that make them; a name can be given once."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str) -> Callable:
        def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self._known:
                raise ValueError(f"{name!r} is taken")
            self._known[name] = f
            return f

        return put

    def names(self) -> list[str]:
        return sorted(self._known)

    def make(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"{name!r} is not one of {self.names()}")
        return self._known[name](*args, **kwargs)


def evaluate(registry: Registry, names: Sequence[str], *args) -> DataFrame:
    """Union of the results of several dimensions; a name may be asked for once."""
    if len(set(names)) != len(names):
        raise ValueError("a dimension is asked for twice")
    out = None
    for n in names:
        part = registry.make(n, *args).withColumn("dimension", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out  # type: ignore[return-value]


def best_runs(history: DataFrame, keys: Sequence[str], score: str, step: str, k: int, lower_is_better: bool) -> DataFrame:
    """The k best rows of each key; of equal scores the earlier step."""
    from ..operators.sequences import first_n

    order = F.col(score).asc_nulls_last() if lower_is_better else F.col(score).desc_nulls_last()
    return first_n(history, keys, [order, F.col(step)], k)


def lower_is_better(metric: str, names: Sequence[str] = ("loss", "fid", "fvd", "lpips", "mse", "error")) -> bool:
    return any(x in metric.lower() for x in names)
