"""Operator 10, LM scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary and one form: interpolation of the bigram's relative
frequency with the smoothed unigram. A document's score is the mean over its tokens of the target's loss less the
background's (in nats): the lower, the more it is like the target.

Counts cover every word and every bigram of both corpora; none is too rare. Texts are read once, into blocks of
documents whose words are numbered. A block asks for the counts of its different words and bigrams, each once, and gets
them back in the order in which it asked: what moves is a code each way, never a row for each word of a document, and
nothing is broadcast or sent to the driver but three totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Tokens from which a block is full.
GATHERED = 2_000_000
#: Weight of the bigram against the unigram, and the unigram's added count.
BLEND, ADDED = 0.6, 0.1
#: The mark before a text's first word, and behind its last.
START, END = 0, 0
#: Gains are whole numbers of this part of a nat, so that sums don't depend on the order of rows.
UNIT = 2.0**-32
#: The block of the totals that a part of the codes sends.
TOTALS = -1


class Model(NamedTuple):
    """The two corpora, with the column text. They are counted together with the texts that are scored."""

    background: DataFrame
    target: DataFrame


def tokens(text: str | None) -> list[str]:
    """Lower-cased words between white space; null and empty texts have none."""
    return text.lower().split() if text else []


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, the 64-bit hash of each token of all texts)."""
    found = [tokens(t) for t in texts]
    codes, unique = pd.factorize(np.array([*chain.from_iterable(found), ""], object)[:-1])
    own = pd.util.hash_array(unique, categorize=False) if len(unique) else np.empty(0, np.uint64)
    return np.array([len(x) for x in found], np.int64), own[codes]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of one kind, compressed byte by byte of equal place."""
    kind = numbers.dtype
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, kind.itemsize).T)
    return pa.compress(planes, codec="zstd", asbytes=True) if len(numbers) else b""


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of x."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def returned(kind: pa.DataType) -> pa.DataType:
    """The type as Spark wants it of what a task returns: UTC for the session's time zone, and nulls allowed inside."""
    if pa.types.is_timestamp(kind) and kind.tz:
        return pa.timestamp(kind.unit, "UTC")
    if pa.types.is_struct(kind):
        return pa.struct([f.with_type(returned(f.type)).with_nullable(True) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(kind.value_field.with_type(returned(kind.value_type)).with_nullable(True))
    if pa.types.is_map(kind):
        return pa.map_(returned(kind.key_type), kind.item_field.with_type(returned(kind.item_type)).with_nullable(True))
    return kind


def word_code(word: np.ndarray) -> np.ndarray:
    """Odd."""
    return mixed(word) | np.uint64(1)


def pair_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Even."""
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD1342543DE82EF95)) & ~np.uint64(1)


class Block:
    """Documents whose words are numbered: lengths, and for each token the place of its hash in words, of which the last
    is START. first and then: places of the words of each different bigram; pair: the place among these of each token's.
    START and END are a bigram too, which is in each text that has words."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, second: np.ndarray):
        self.words = np.append(words, np.uint64(START))
        self.lengths, self.second = lengths, second.astype(np.int64)
        self.full = np.flatnonzero(lengths)
        self.stop = np.cumsum(lengths)[self.full]
        first = np.roll(self.second, 1)
        first[self.stop - lengths[self.full]] = len(words)
        m = len(self.words)
        keys, self.pair = np.unique(first * m + self.second, return_inverse=True)
        self.first, self.then = np.divmod(keys, m)
        codes = np.concatenate([word_code(words), pair_code(self.words[self.first], self.words[self.then]), pair_code(self.words[-1:], np.uint64(END))])
        #: Different codes in order, and each item's place among them: words, then bigrams, then that of START and END.
        self.codes, self.place = np.unique(codes, return_inverse=True)

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """[2, codes]: how often each code is in the documents, each of them so many times, and as a text's last word."""
        whole = lambda at, w, n: np.bincount(at, w, n).astype(np.int64)
        own, n, m = weight[self.full], len(self.words) - 1, len(self.codes)
        token = np.repeat(weight, self.lengths)
        each = np.concatenate([whole(self.second, token, n), whole(self.pair, token, len(self.first)), own.sum(keepdims=True)])
        ends = whole(self.second[self.stop - 1], own, n)
        return np.stack([whole(self.place, each, m), whole(self.place[:n], ends, m)])

    def gains(self, counts: np.ndarray, mass: float) -> np.ndarray:
        """Logarithm of each different bigram's chance by a model with these counts of codes."""
        n = len(self.words) - 1
        each = counts[0, self.place].astype(float)
        second, pair = each[:n], each[n:-1]
        before = np.append(second - counts[1, self.place[:n]], each[-1])[self.first]
        chance = (second[self.then] + ADDED) / mass
        return np.log(np.where(before > 0, BLEND * pair / np.maximum(before, 1) + (1 - BLEND) * chance, chance))


def _blocks(rows: DataFrame, kept: list[str]) -> DataFrame:
    """(block, and what makes it) of rows with __text, __back, __target and __asked, and the columns kept."""
    schema = "n int, n_words int, n_tokens int, lengths binary, words binary, tokens binary, back binary, target binary, asked binary, kept binary"

    def block(held: list[tuple[pa.Table, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        table = pa.concat_tables([t for t, _, _ in held])
        codes, words = pd.factorize(np.concatenate([h for _, _, h in held]))
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words have small numbers
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        column = lambda c, kind: packed(table[c].to_numpy().astype(kind))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(kept).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.select(kept))
        one = [
            len(table), len(words), len(codes), packed(np.concatenate([n for _, n, _ in held])), packed(words[order]), packed(number[codes]),
            column("__back", np.int64), column("__target", np.int64), column("__asked", np.uint8), sink.getvalue().to_pybytes(),
        ]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths, own = hashes(table["__text"].to_pylist())
            held.append((table.drop_columns("__text"), lengths, own))
            n += len(own)
            if n >= GATHERED:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return cut(rows.mapInArrow(gather, schema).withColumn("block", F.monotonically_increasing_id()))


def _opened(r: dict) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block, and how often each of its documents is in the background and in the target."""
    b = Block(unpacked(r["words"], r["n_words"], np.uint64), unpacked(r["lengths"], r["n"], np.int64), unpacked(r["tokens"], r["n_tokens"], np.uint32))
    return b, unpacked(r["back"], r["n"], np.int64), unpacked(r["target"], r["n"], np.int64)


def _answers(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, n, back, target): the counts in both corpora of the codes of a block that fall in a part of all
    codes, in their order. Block TOTALS has a part's number of words that occur, and sums of their counts."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                b, *weights = _opened(r)
                counts = [b.counts(w) for w in weights]
                part = ((b.codes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                out = [(int(part[i]), r["block"], j - i, packed(np.diff(b.codes[i:j], prepend=np.uint64(0))), *(packed(c[:, i:j].ravel()) for c in counts)) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)])]
                yield pd.DataFrame(out, columns=["part", "block", "n", "codes", "back", "target"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["n"].tolist()
        codes, place = np.unique(np.concatenate([np.cumsum(unpacked(x, n, np.uint64)) for x, n in zip(pdf["codes"], sizes)]), return_inverse=True)
        sums = []
        for c in ("back", "target"):
            sums.append(np.zeros((2, len(codes)), np.int64))
            found = np.concatenate([unpacked(x, 2 * n, np.int64).reshape(2, n) for x, n in zip(pdf[c], sizes)], axis=1)
            for own, more in zip(sums[-1], found):
                np.add.at(own, place, more)
        back, target = (s[0] for s in sums)
        word = (codes & np.uint64(1)).astype(bool)
        out = pdf[["block", "part", "n"]].assign(**{c: [packed(s[:, x].ravel()) for x in np.split(place, np.cumsum(sizes)[:-1])] for c, s in zip(("back", "target"), sums)})
        out = out.assign(words=0, in_back=0, in_target=0)
        out.loc[len(out)] = [TOTALS, pdf["part"].iloc[0], 0, b"", b"", int((word & (back + target > 0)).sum()), int(back[word].sum()), int(target[word].sum())]
        return out

    asked = blocks.mapInPandas(ask, "part int, block long, n int, codes binary, back binary, target binary")
    return cut(asked.groupBy("part").applyInPandas(count, "block long, part int, n int, back binary, target binary, words long, in_back long, in_target long"))


def _scored(rows: DataFrame, kept: DataFrame, to: str, count: str) -> DataFrame:
    """The columns of kept with to and count, of rows (see _blocks) that are asked for."""
    spark = rows.sparkSession
    small_batches(spark)
    names = kept.columns
    blocks = _blocks(rows, names)
    answers = _answers(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()))
    seen = answers.where(F.col("block") == TOTALS).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "in_back", "in_target")]).first()
    masses = [float(n + ADDED * (seen[0] + 1)) for n in seen[1:]]

    def finish(one: pa.Table, found: pa.Table) -> pa.Table:
        r = one.to_pylist()[0]
        b = _opened(r)[0]
        found = sorted(found.to_pylist(), key=lambda x: x["part"])
        chances = [b.gains(np.concatenate([unpacked(x[c], 2 * x["n"], np.int64).reshape(2, -1) for x in found], axis=1), mass) for c, mass in zip(("back", "target"), masses)]
        units = np.rint((chances[0] - chances[1]) / UNIT).astype(np.int64)
        value = np.zeros(r["n"])
        if len(b.full):
            value[b.full] = np.add.reduceat(units[b.pair], b.stop - b.lengths[b.full]) * UNIT / b.lengths[b.full]
        table = pa.ipc.open_stream(r["kept"]).read_all()
        table = table.cast(pa.schema([f.with_type(returned(f.type)) for f in table.schema]))
        out = pa.Table.from_arrays([*table.columns, pa.array(value), pa.array(b.lengths)], names=[*names, to, count])
        return out.filter(pa.array(unpacked(r["asked"], r["n"], np.uint8).astype(bool)))

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", " * bool(names) + f"`{to}` double, `{count}` long"
    own = answers.where(F.col("block") != TOTALS).select("block", "part", "n", "back", "target")
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(finish, schema)


def train(background: DataFrame, target: DataFrame, text: str) -> Model:
    """Both tables have the column text; either may be empty. Words and bigrams are counted by score, for the texts that
    it is given: so no table of all of them is kept."""
    whole = F.col(text).cast("string").alias("__text")
    return Model(background.select(whole), target.select(whole))


def score(docs: DataFrame, text: str, model: Model, to: str = "ce_diff", count: str = "n_tokens") -> DataFrame:
    """Adds to (double) and count (long) to every row and leaves text out; other columns stay.

    Null and empty texts have no tokens and score 0; texts are scored whole. Repeated rows get equal scores; an empty
    table stays empty. Columns of docs named like the new ones are replaced. A word's identity is a 64-bit hash, a
    bigram's one of 63 bits of two of them.
    """
    kept = docs.drop(to, count, text)
    marks = lambda rows, *n: rows.withColumns({c: F.lit(x) for c, x in zip(("__back", "__target", "__asked"), n)})
    asked = marks(docs.drop(to, count).withColumn("__text", F.col(text).cast("string")).drop(text), 0, 0, True)
    corpora = marks(model.background, 1, 0, False).unionByName(marks(model.target, 0, 1, False))
    return _scored(asked.unionByName(corpora, allowMissingColumns=True), kept, to, count)


def score_own(docs: DataFrame, text: str, target: str, to: str = "ce_diff", count: str = "n_tokens") -> DataFrame:
    """As score, where docs are the background themselves and those with target (boolean) the target: each text is read
    and counted once. The column target is left out."""
    kept = docs.drop(to, count, text, target)
    rows = docs.withColumns({"__text": F.col(text).cast("string"), "__back": F.lit(1), "__target": F.coalesce(F.col(target).cast("int"), F.lit(0)), "__asked": F.lit(True)})
    return _scored(rows.select(*kept.columns, "__text", "__back", "__target", "__asked"), kept, to, count)
