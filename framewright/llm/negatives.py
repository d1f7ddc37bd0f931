"""Operator 12, hard negatives by product quantisation with residual norms.

Vectors become integers, floor(256 x). Each is stored as codes of short pieces, with the norm of what the codes miss. A
table of products of an anchor's pieces with all codewords gives a row's score up to norm(anchor) * norm(residual), which
is a bound and no estimate: rows whose bounds exclude them from an anchor's best, or from a window of scores, are dropped
with certainty, and the others get their exact integer score. The codebooks are fitted on a bounded sample; a bad fit
costs time, never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Components of a piece, codewords of a piece, rows and rounds that the codebooks are fitted by.
PIECE, WORDS, SAMPLE, ROUNDS = 2, 256, 8192, 8
#: Numbers in the anchors of a block, which is broadcast; rows and anchors compared in one go; exact scores computed at once.
ANCHOR_NUMBERS, ROWS, ANCHORS, PAIRS = 1 << 22, 4096, 256, 1 << 16
SCALE = 256.0
#: Sums in double precision are off by less than this share of the product of two norms.
SLACK = 1e-11
#: Components from which on squares may leave the doubles.
LARGEST = 1e100


class Codebook(NamedTuple):
    """words [pieces, WORDS, PIECE]"""

    words: np.ndarray
    dim: int


class Anchors(NamedTuple):
    """A block of anchors, one a row; norm is theirs."""

    key: np.ndarray
    label: np.ndarray
    x: np.ndarray
    norm: np.ndarray


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of the vectors as doubles, which hold it exactly; short vectors end in zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    if (np.abs(out) > LARGEST).any():
        raise OverflowError("a component is too large")
    return out


def pieces(x: np.ndarray) -> np.ndarray:
    """[pieces, rows, PIECE]"""
    short = -x.shape[1] % PIECE
    x = np.pad(x, ((0, 0), (0, short))) if short else x
    return x.reshape(len(x), -1, PIECE).transpose(1, 0, 2)


def nearest(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1) - 2 * part @ words.T, axis=1)


def fit(sample: np.ndarray, seed: int = 11) -> Codebook:
    """k-means for each piece, by ROUNDS of Lloyd's steps from sampled rows."""
    rng = np.random.default_rng(seed)
    out = []
    for part in pieces(sample):
        words = part[rng.choice(len(part), WORDS, replace=len(part) < WORDS)].astype(float)
        for _ in range(ROUNDS):
            at = nearest(part, words)
            n = np.bincount(at, minlength=WORDS)
            for c in range(PIECE):
                words[:, c] = np.where(n > 0, np.bincount(at, part[:, c], WORDS) / np.maximum(n, 1), words[:, c])
        out.append(words)
    return Codebook(np.array(out), sample.shape[1])


def encode(df: DataFrame, key: str, label: str, vector: str, book) -> DataFrame:
    """(key, label, x, codes, residual): x as little-endian doubles, a byte for each piece, and the norm of the rest."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dim = book.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = integers(part.column("x"), dim)
                codes, left = np.empty((len(x), len(words)), np.uint8), np.zeros(len(x))
                for p, piece in enumerate(pieces(x)):
                    codes[:, p] = nearest(piece, words[p])
                    left += ((piece - words[p][codes[:, p]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(np.sqrt(left))],
                    ["key", "label", "x", "codes", "residual"],
                )

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("x"))
    return rows.mapInArrow(coded, "key bigint, label bigint, x binary, codes binary, residual double")


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows as 64-bit integers; in Python's integers where doubles might round. Beyond 64 bits: an error."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max()) < 1 << 52:
        return np.einsum("nd,nd->n", x, y).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(x.tolist(), y.tolist())], np.int64)


class Best:
    """The k rows of highest score, then smallest key, of each group, as arrays that grow no further than that."""

    def __init__(self, groups: int, k: int):
        self.k, self.rows = k, [np.zeros(0, np.int64)] * 3
        self.floor = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(group):
            return
        group, score, key = (np.concatenate(p) for p in zip(self.rows, (group, score, key)))
        order = np.lexsort((key, -score, group))
        group, score, key = group[order], score[order], key[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.k
        self.rows = [group[keep], score[keep], key[keep]]
        last = place == self.k - 1
        self.floor[group[last]] = score[last] - np.abs(score[last]) * 1e-12 - 1  # as a double that surely isn't above it


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every column, -inf where there are fewer rows."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -np.inf)


class Block:
    """Rows of the table next to some anchors: bounds of all scores, and exact ones where asked for."""

    def __init__(self, rows: pa.RecordBatch, words: np.ndarray, dim: int):
        self.key, self.label = rows.column("key").to_numpy(), rows.column("label").to_numpy()
        self.x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<f8").reshape(-1, dim)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, len(words))
        norm = np.sqrt((self.x * self.x).sum(1))
        self.reach = rows.column("residual").to_numpy() * (1 + 1e-9) + SLACK * norm
        self.words = words

    def bounds(self, anchors: Anchors, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible scores [rows, anchors], by one look-up a piece."""
        guess = np.zeros((len(self.key), len(anchors.key[at])))
        for p, piece in enumerate(pieces(anchors.x[at])):
            guess += (self.words[p] @ piece.T)[self.codes[:, p]]
        off = self.reach[:, None] * anchors.norm[at]
        return guess - off, guess + off

    def pairs(self, anchors: Anchors, at: slice, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor within the slice, exact score) of the wanted ones, a bounded number at a time."""
        r, c = np.nonzero(wanted)
        for i in range(0, len(r), PAIRS):
            rows, cols = r[i : i + PAIRS], c[i : i + PAIRS]
            yield rows, cols, exact(self.x[rows], anchors.x[at][cols])


def blocks_of(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield Block(batch.slice(at, ROWS), book.words, book.dim)


def slices(n: int) -> Iterator[slice]:
    return (slice(i, min(i + ANCHORS, n)) for i in range(0, n, ANCHORS))


def positives(rows: DataFrame, book, anchors, k: int) -> DataFrame:
    """(anchor, score, key): each task's k best rows of an anchor's own label; anchor is its place in the broadcast block."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = anchors.value, Best(len(anchors.value.key), k)
        for block in blocks_of(batches, book.value):
            for at in slices(len(own.key)):
                low, high = block.bounds(own, at)
                same = (block.label[:, None] == own.label[at]) & (block.key[:, None] != own.key[at])
                floor = np.maximum(kth(np.where(same, low, -np.inf), k), found.floor[at])
                for r, c, score in block.pairs(own, at, same & (high >= floor)):
                    found.add(c + at.start, score, block.key[r])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in found.rows], ["anchor", "score", "key"])

    return rows.mapInArrow(best, "anchor bigint, score bigint, key bigint")


class Windows(NamedTuple):
    """slots [anchors, positives] of the keys and scores of positives, and the scores that their negatives may have;
    where there is no positive, or no such score, least is above most."""

    key: np.ndarray
    score: np.ndarray
    least: np.ndarray
    most: np.ndarray


def windows(found: pa.Table, anchors: int, k: int, low: int, high: int) -> Windows:
    """low and high are percentages of the positive's score, compared as integers: low * p <= 100 * n <= high * p."""
    key, score = np.zeros((anchors, k), np.int64), np.zeros((anchors, k), np.int64)
    least, most = np.ones((anchors, k), np.int64), np.zeros((anchors, k), np.int64)
    for a, r, p, s in zip(*(found[c].to_pylist() for c in ("anchor", "rank", "key", "score"))):
        key[a, r - 1], score[a, r - 1] = p, s
        least[a, r - 1], most[a, r - 1] = -(-low * s // 100), high * s // 100
    return Windows(key, score, least, most)


def negatives(rows: DataFrame, book, anchors, limits, k: int) -> DataFrame:
    """(anchor, slot, score, key): each task's k best rows of other labels within the window of an anchor's positive."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = anchors.value, limits.value
        n = w.key.shape[1]
        found = Best(w.key.size, k)
        for block in blocks_of(batches, book.value):
            for at in slices(len(own.key)):
                low, high = block.bounds(own, at)
                other = block.label[:, None] != own.label[at]
                wanted = np.zeros(other.shape, bool)
                for s in range(n):
                    least, most = w.least[at, s].astype(float) - 1, w.most[at, s].astype(float) + 1  # a little wider than the integers
                    open_ = w.least[at, s] <= w.most[at, s]
                    if not open_.any():
                        continue
                    inside = other & (low >= least + 2) & (high <= most - 2)
                    floor = np.maximum(kth(np.where(inside, low, -np.inf), k), found.floor[np.arange(at.start, at.stop) * n + s])
                    wanted |= other & open_ & (low <= most) & (high >= np.maximum(least, floor))
                for r, c, score in block.pairs(own, at, wanted):
                    for s in range(n):
                        fits = (score >= w.least[at, s][c]) & (score <= w.most[at, s][c])
                        found.add((c[fits] + at.start) * n + s, score[fits], block.key[r[fits]])
        group, score, key = found.rows
        anchor, slot = group // n, group % n
        named = (own.key[anchor], w.key[anchor, slot], w.score[anchor, slot])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (anchor, slot, *named, score, key)], ["anchor", "slot", "anchor_id", "positive_id", "positive_score", "score", "key"])

    return rows.mapInArrow(best, "anchor bigint, slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, key bigint")


def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def mine(df: DataFrame, key: str, label: str, vector: str, is_anchor: Column, k_positive: int = 5, k_negative: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows of df for which is_anchor holds; they are taken in blocks of bounded size, each against all rows.
    Rows without key, label or vector, or with a null or non-finite component, take no part. Short vectors are filled with
    zeros. A row is never the partner of a row of its own key; rows that repeat a key count each, as anchors too. Ties go to
    smaller keys. Integer products that 64 bits cannot hold fail the job, and so do components beyond LARGEST.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    dim = rows.agg(F.max(F.size(vector))).first()[0]
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not dim:
        return spark.createDataFrame([], empty)
    sample = rows.select(F.col(key).alias("key"), F.col(vector).alias("x")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
    book = spark.sparkContext.broadcast(fit(integers(sample, dim)))
    coded = cut(encode(rows, key, label, vector, book))
    chosen = cut(encode(rows.where(is_anchor), key, label, vector, book).select("key", "label", "x"))
    per_block = max(ANCHORS, ANCHOR_NUMBERS // dim)
    blocks = max(1, -(-chosen.count() // per_block))
    found = None
    for b in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
        x = np.frombuffer(b"".join(own["x"].to_pylist()), "<f8").reshape(-1, dim)
        anchors = Anchors(own["key"].to_numpy(), own["label"].to_numpy(), x, np.sqrt((x * x).sum(1)) * (1 + 1e-9))
        if not len(x):
            continue
        sent = spark.sparkContext.broadcast(anchors)
        near = ranked(positives(coded, book, sent, k_positive), ["anchor"], k_positive).select("anchor", "rank", "key", "score").toArrow()
        limits = spark.sparkContext.broadcast(windows(near, len(x), k_positive, low, high))
        one = ranked(negatives(coded, book, sent, limits, k_negative), ["anchor", "slot"], k_negative)
        one = cut(one) if blocks > 1 else one
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], empty)
    return found.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
