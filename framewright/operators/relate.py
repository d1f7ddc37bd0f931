"""Joins and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running


def enrich(df: DataFrame, attributes: DataFrame, key: str, column: str) -> DataFrame:
    """Fills column from attributes (key, column) only where it is null or empty."""
    given = attributes.select(key, F.col(column).alias("__new")).dropDuplicates([key])
    own = F.nullif(F.col(column), F.lit("")) if column in df.columns else F.lit(None).cast("string")
    return df.join(given, key, "left").withColumn(column, F.coalesce(own, F.nullif("__new", F.lit("")))).drop("__new")


def pending(df: DataFrame, key: str, *ledgers: DataFrame) -> DataFrame:
    """Rows whose key no ledger has."""
    done = ledgers[0].select(key)
    for x in ledgers[1:]:
        done = done.union(x.select(key))
    return df.join(done.distinct(), key, "left_anti")


def select_pending(df: DataFrame, key: str, done: Sequence[DataFrame], failed: DataFrame, order: Sequence[str], retry_failed: bool = False, limit: int = 0) -> DataFrame:
    """Rows that no ledger in done has, without those that failed before unless retry_failed, and of them the first limit
    in order; all, if limit is 0."""
    left = pending(df, key, *done, *([] if retry_failed else [failed]))
    return left.orderBy(*order).limit(limit) if limit > 0 else left


def count_report(found: DataFrame, expected: int, suffix: str = ".mp4", name: str = "name") -> DataFrame:
    """(expected, found, missing, extra, complete) for the files of a kind, whatever the case of their suffix."""
    n = found.where(F.lower(F.col(name)).endswith(suffix)).agg(F.count("*").alias("found"))
    e = F.lit(expected).cast("bigint")
    return n.select(e.alias("expected"), "found", F.greatest(e - F.col("found"), F.lit(0)).alias("missing"), F.greatest(F.col("found") - e, F.lit(0)).alias("extra"), (F.col("found") == e).alias("complete"))


def substitutions(df: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """df with own, the first of names that the text holds, and for each of names a row with place and prompt, the text with
    own replaced by it. Texts that hold none of them are left out."""
    own = F.lit(None).cast("string")
    for n in reversed(names):
        own = F.when(F.contains(F.col(text), F.lit(n)), n).otherwise(own)
    each = F.posexplode(F.array(*map(F.lit, names))).alias("place", "__n")
    rows = df.withColumn("own", own).where("own IS NOT NULL").select("*", each)
    return rows.withColumn("prompt", F.replace(F.col(text), F.col("own"), F.col("__n"))).drop("__n")


def counterfactual_scores(scored: DataFrame, key: str, names: Sequence[str], score: str = "score", merged: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, own, value): 1 where the best of a row's substitutions, the first of equals, is its own name, or one of the same
    group in merged, else 0; and (own, mean) by group, with null for groups of names that no row has."""
    group = F.col("own")
    names_of = F.element_at(F.array(*[F.lit((merged or {}).get(n, n)) for n in names]), F.col("best") + 1)
    for old, new in (merged or {}).items():
        group = F.when(F.col("own") == old, new).otherwise(group)
    best = scored.groupBy(key, "own").agg(F.max_by("place", F.struct(F.col(score), -F.col("place"))).alias("best"))
    each = best.select(key, group.alias("own"), (names_of == group).cast("double").alias("value"))
    groups = list(dict.fromkeys((merged or {}).get(n, n) for n in names))
    all_ = scored.sparkSession.createDataFrame([(g,) for g in groups], "own string")
    return each, all_.join(each.groupBy("own").agg(F.avg("value").alias("mean")), "own", "left")


def expected_samples(prompts: DataFrame, prompt: str, n: int, extension: str = ".mp4", special: str = "") -> DataFrame:
    """(prompt, i, name) of the n files that each prompt should have."""
    rows = prompts.select(F.col(prompt), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return rows.withColumn("name", F.concat(F.col(prompt), F.lit(special), F.lit("-"), F.col("i").cast("string"), F.lit(extension)))


def require_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join; a row of left without a partner fails the job when it is read."""
    hit = right.withColumn("__hit", F.lit(True))
    checked = left.join(hit, key, "left")
    fail = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string")))
    return checked.where(F.when(F.col("__hit").isNull(), fail.cast("boolean")).otherwise(F.lit(True))).drop("__hit")


def prefix_join(df: DataFrame, text: str, prompts: DataFrame, prompt: str) -> DataFrame:
    """Rows with every prompt that their text begins with.

    Prompts are joined by equality with the text's prefixes of the lengths that prompts have, so that it is no theta
    join; a table of lengths is as small as the longest prompt.
    """
    own = prompts.select(F.col(prompt)).where(F.col(prompt).isNotNull()).distinct()
    lengths = own.select(F.length(prompt).alias("__n")).distinct()
    heads = df.join(F.broadcast(lengths), F.length(text) >= F.col("__n")).withColumn(prompt, F.expr(f"left(`{text}`, __n)")).drop("__n")
    return heads.join(own, prompt)


def zip_in_order(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """The k-th row of left with the k-th row of right."""
    from .sequences import dense_number

    return dense_number(left, left_order, "k").join(dense_number(right, right_order, "k"), "k")


def interpolate(df: DataFrame, x: str, mapping: DataFrame, to: str = "y") -> DataFrame:
    """Adds the linear interpolation of x in mapping (key, mapped), clamped at its ends; null x gives null.

    mapping becomes one sorted array, so it must be small: a table of steps of 0.01 has 101 rows.
    """
    table = mapping.agg(F.array_sort(F.collect_list(F.struct(F.col("key").cast("double").alias("key"), F.col("mapped").cast("double").alias("mapped")))).alias("__m"))
    rows = df.crossJoin(F.broadcast(table))
    v = F.col(x).cast("double")
    low = F.element_at(F.filter("__m", lambda p: p["key"] <= v), -1)
    below = F.when(F.exists("__m", lambda p: p["key"] <= v), low).otherwise(F.get("__m", 0))
    above = F.coalesce(F.get(F.filter("__m", lambda p: p["key"] >= v), 0), F.element_at("__m", -1))
    y = F.when(below["key"] == above["key"], below["mapped"]).otherwise(below["mapped"] + (v - below["key"]) / (above["key"] - below["key"]) * (above["mapped"] - below["mapped"]))
    inside = F.when(v.isNull(), F.lit(None).cast("double")).when(v <= F.get("__m", 0)["key"], F.get("__m", 0)["mapped"]).when(v >= F.element_at("__m", -1)["key"], F.element_at("__m", -1)["mapped"]).otherwise(y)
    return rows.withColumn(to, inside).drop("__m")


def pairs_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every unordered pair of a key's rows, as a_ and b_ columns. Groups must be bounded, as boxes of a frame are."""
    side = lambda p: df.select(*keys, F.struct(*order).alias(f"{p}_order"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side("a").join(side("b"), list(keys)).where("a_order < b_order").drop("a_order", "b_order")


def union_all(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all parts with the part's name and the offset at which its rows begin in the whole."""
    out, before = None, None
    for name, df in parts.items():
        size = df.agg(F.count("*").alias("__size"))
        offset = size.limit(0).select(F.lit(0).alias("offset")) if before is None else before
        start = F.lit(0).cast("bigint")
        rows = df.withColumn("dataset", F.lit(name))
        rows = rows.withColumn("offset", start) if before is None else rows.crossJoin(F.broadcast(offset))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        before = size.select(F.col("__size").alias("offset")) if before is None else before.crossJoin(size).select((F.col("offset") + F.col("__size")).alias("offset"))
    return out  # type: ignore[return-value]


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of each key's first place."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def fuse(inner: DataFrame, across: DataFrame, key: str, weight: float) -> DataFrame:
    """(key, score): weight * inner + (1 - weight) * across; where across is absent or 0, inner alone."""
    both = inner.select(key, F.col("score").alias("__in")).join(across.select(key, F.col("score").alias("__ac")), key, "left")
    lone = F.coalesce("__ac", F.lit(0.0)) == 0
    return both.select(key, F.when(lone, F.col("__in")).otherwise(weight * F.col("__in") + (1 - weight) * F.col("__ac")).alias("score"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows on both sides, on the left only and on the right only, by distinct key; nulls count as one key."""
    l, r = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))  # noqa: E741
    both = l.join(r, l[key].eqNullSafe(r[key]), "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def best_by(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest value; order breaks ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value.desc(), *order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def pair_distance(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, n, size, distance): the mean L1 distance of all pairs of a key's n vectors of size components, without pairs.

    Of sorted values, the k-th is subtracted from by all before it and from all after it: the sum over pairs is that of
    value times 2 k - n - 1. Sums run over ranges, so that keys may be few and large. Null distance for a single vector.
    """
    flat = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("__c", "__x"))
    placed = running(flat, [*keys, "__c"], ["__x"], {"__k": F.lit(1)})
    part = F.col("__x") * (2 * F.col("__k") - F.col("__k_all") - 1)
    sums = placed.groupBy(*keys).agg(F.max("__k_all").alias("n"), (F.max("__c") + 1).alias("size"), F.sum(part).alias("__sum"))
    n = F.col("n")
    return sums.select(*keys, "n", "size", F.try_divide("__sum", n * (n - 1) / 2).alias("distance"))


def diversity(content: DataFrame, styles: DataFrame, keys: Sequence[str], layer: str, vector: str, style_weight: float = 1000.0, greatest: float = 17.712) -> DataFrame:
    """(keys, content, style, score): how much samples of a prompt differ, between 0 and 1. content has a vector a sample,
    styles one for each layer of a sample, such as a Gram matrix. Both are mean differences by component over all pairs,
    style's also over layers and weighted; the score is half their sum, by the greatest one known (a fixed value)."""
    mean = lambda df: df.select(*keys, (F.col("distance") / F.col("size")).alias("d"))
    c = mean(pair_distance(content, keys, vector)).withColumnRenamed("d", "content")
    s = mean(pair_distance(styles, [*keys, layer], vector)).groupBy(*keys).agg((F.avg("d") * style_weight).alias("style"))
    score = F.least(F.greatest((F.col("content") + F.col("style")) / 2 / greatest, F.lit(0.0)), F.lit(1.0))
    both = F.col("content").isNotNull() & F.col("style").isNotNull()
    return c.join(s, list(keys), "left").select(*keys, "content", "style", F.when(both, score).alias("score"))


def routes(files: DataFrame, name: str, catalogue: DataFrame, key: str, caption: str, dimensions: str, apart: str, cut: int = 180, first: int = 3) -> DataFrame:
    """(name, dimension): the folders that a video is copied to, one for each dimension of the catalogue's entry whose key
    its name begins with, to cut characters. Entries with the dimension apart and others have many samples: all of them go
    to apart, and only the first ones, named by the caption and 0 to first - 1, to the other dimensions."""
    prefix = F.substring(F.split(name, r"-\d+\.mp4")[0], 1, cut)
    entries = catalogue.select(F.substring(key, 1, cut).alias("__key"), F.substring(caption, 1, cut).alias("__caption"), F.col(dimensions).alias("__all")).dropDuplicates(["__key"])
    both = files.select(name, prefix.alias("__key")).join(entries, "__key").select(name, "__caption", "__all", F.explode("__all").alias("dimension"))
    early = F.col(name).isin([]) if first < 1 else F.array_contains(F.array(*[F.concat("__caption", F.lit(f"-{i}.mp4")) for i in range(first)]), F.col(name))
    several = F.array_contains("__all", apart) & (F.size("__all") > 1)
    return both.where(~several | early | (F.col("dimension") == apart)).select(name, "dimension")


def gathered(df: DataFrame, group: str, rank: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(group, rows): what the ranks of a group have, rank after rank, each in its order, as one list of structs; a group's
    list is one row and so bounded, as results of a step are."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("__rank"), F.col(order).alias("__order"), F.struct(*columns).alias("__row"))))
    return df.groupBy(group).agg(F.transform(rows, lambda r: r["__row"]).alias("rows"))
