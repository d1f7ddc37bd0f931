"""Filters: field selectors, cascades, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

TYPES = {"int": (int, (ShortType, IntegerType, LongType)), "float": (float, (FloatType, DoubleType)), "str": (str, (StringType,))}


def selector(df: DataFrame, spec: str) -> Column:
    """The predicate of a selector: '*', or clauses 'field[:type]=value' or '=min-max' joined by commas.

    Types are int, float and str, the default. Values aren't converted to the field's type: equality with a field of
    another type holds for no row, and a range over one is an error, as is a spec that can't be read. A range is a
    hyphen after the first character; both ends count.
    """
    if spec.strip() == "*":
        return F.lit(True)
    out: Column | None = None
    for clause in spec.split(","):
        left, eq, right = clause.partition("=")
        name, colon, kind = left.partition(":")
        name, kind = name.strip(), kind.strip() if colon else "str"
        if not eq or not name or not right or kind not in TYPES:
            raise ValueError(f"can't read the selector clause {clause!r}")
        if name not in df.columns:
            raise ValueError(f"there is no field {name!r}")
        make, accepted = TYPES[kind]
        same = isinstance(df.schema[name].dataType, accepted) or kind == "float" and isinstance(df.schema[name].dataType, TYPES["int"][1])
        cut = right.find("-", 1)
        if cut > 0:
            if not same:
                raise TypeError(f"{name} is not of type {kind}")
            part = F.col(name).between(make(right[:cut]), make(right[cut + 1 :]))
        else:
            part = F.col(name) == make(right) if same else F.lit(False)
        out = part if out is None else out & part
    return out  # type: ignore[return-value]


def select(df: DataFrame, spec: str, max_entries: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows that a selector accepts, of the first max_entries rows by order: the limit counts rows read, not matched."""
    scanned = df if max_entries is None else df.orderBy(*order).limit(max_entries)
    return scanned.where(selector(df, spec))


def is_true(column: Column) -> Column:
    return F.coalesce(F.lower(column.cast("string")) == "true", F.lit(False))


def accept_entailment(positive: Column, negative: Column, low: float = 0.65, high: float = 0.40, margin: float = 0.25) -> Column:
    """Arrays of entailment scores of hypotheses for and against."""
    p, n = F.array_max(positive), F.array_max(negative)
    return (p >= low) & (n <= high) & (p - n >= margin)


def accept_answer(match: Column, occlusion: Column, multiple: Column | None = None) -> Column:
    """Some sources also ask that there are not several persons."""
    ok = match & ~occlusion
    return ok if multiple is None else ok & ~multiple


def size_ok(width: Column, height: Column, least: Column, low: Column, high: Column) -> Column:
    """Short side and aspect ratio within a category's limits; a category without limits passes."""
    return F.coalesce((F.least(width, height) >= least) & F.try_divide(width, height).between(low, high), F.lit(True))


def cascade(df: DataFrame, stages: Sequence[tuple[str, Column]], to: str = "stage") -> DataFrame:
    """Adds the name of the first stage whose condition a row fails, or null. A null condition fails."""
    found = F.lit(None).cast("string")
    for name, ok in reversed(stages):
        found = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(found)
    return df.withColumn(to, found)


def diagnosed(df: DataFrame, stages: Sequence[tuple[str, Column, Sequence[str]]], to: str = "stage", measured: str = "measured") -> DataFrame:
    """cascade that also tells what the stage has measured: a map from the names of its columns to their values as
    doubles. Rows that pass have a null stage and no map."""
    found, values = F.lit(None).cast("string"), F.lit(None).cast("map<string, double>")
    for name, ok, columns in reversed(stages):
        fails = ~F.coalesce(ok, F.lit(False))
        told = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))
        found, values = F.when(fails, name).otherwise(found), F.when(fails, told).otherwise(values)
    return df.withColumns({to: found, measured: values})


def shares_dimension(dimensions: Column, wanted: Sequence[str]) -> Column:
    """True where an entry has one of the wanted dimensions; a null list has none."""
    return F.coalesce(F.arrays_overlap(dimensions, F.array(*map(F.lit, wanted))), F.lit(False))


def outcome(df: DataFrame, cases: Sequence[tuple[str, Column]], rest: str = "ok", to: str = "status") -> DataFrame:
    """Adds the name of the first case that holds."""
    found = F.lit(rest)
    for name, holds in reversed(cases):
        found = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(found)
    return df.withColumn(to, found)


def known_dimensions(asked: Sequence[str], known: Sequence[str]) -> None:
    if unknown := sorted(set(asked) - set(known)):
        raise ValueError(f"unknown dimensions: {unknown}")


def top_label(df: DataFrame, keys: Sequence[str], probability: str, label: str, truth: Column, k: int = 5, least: float = 0.85) -> DataFrame:
    """(keys, hit): whether the true label is among the k likeliest with a probability, to 4 digits, of least or more."""
    from .sequences import first_n

    best = first_n(df, keys, [F.desc(probability), label], k)
    return best.groupBy(*keys).agg(F.coalesce(F.bool_or((F.bround(F.col(probability), 4) >= least) & (F.col(label) == truth)), F.lit(False)).alias("hit"))
