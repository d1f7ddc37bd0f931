"""Operator 13, ranked lexical search: MaxScore over shards of documents, for a whole table of queries.

A shard is a bounded run of one task's documents, held as postings by term. A query's terms are sorted by the most that
each can add to a score in the shard. Terms are essential as long as what they and all later ones can add reaches the
lowest score in the running result; only their lists are read whole. The others are probed, and only for documents that
can still qualify. All scores are exact integers, so that nothing is lost; ties go to the smaller document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small_batches

#: Pairs of an item and one of its terms that a block of items has on average: what is broadcast at once.
BLOCK_PAIRS = 1_000_000
#: Documents and postings from which on a shard is searched.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: Weight of a document's length, in hundredths, and how fast repeats of a term lose weight, in hundredths of 1000/12.
LENGTH, REPEAT = 25, 12

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: Bytes of terms, with A-Z as a-z; all others are spaces. Bytes from 0x80 on are part of characters beyond ASCII.
FOLD = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return (text or b"").translate(FOLD).split()


def terms(text: Column) -> Column:
    """The same as an expression; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


class Items(NamedTuple):
    """A block of items: keys [items], their terms as numbers from start[i] to start[i + 1], how often each occurs."""

    keys: pa.Array
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: dict[bytes, int]


class Stats(NamedTuple):
    """Documents with terms, all their terms, and the weight of each term of the block."""

    docs: int
    length: int
    weight: np.ndarray


def block_of(rows: DataFrame) -> Items:
    """A block of (item, term, times) rows, bounded by BLOCK_PAIRS, as arrays."""
    t = rows.select("item", "term", "times").toArrow()
    item, term = (t[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("item", "term"))
    at = item.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    vocabulary = {w.encode(): i for i, w in enumerate(term.dictionary.to_pylist())}
    start = np.searchsorted(at[order], np.arange(len(item.dictionary) + 1))
    return Items(item.dictionary, start, term.indices.to_numpy()[order], t["times"].to_numpy()[order], vocabulary)


def postings(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """(doc, n, terms, times) of every document with terms: n counts them all, the others are those of the broadcast
    vocabulary, as little-endian 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            keep, n, own, times = [], [], [], []
            for i, data in enumerate(batch.column("text").cast(pa.binary())):
                found = words(data.as_py())
                if found:
                    ids, count = np.unique(np.fromiter((t for t in map(number.get, found) if t is not None), np.int32), return_counts=True)
                    keep.append(i)
                    n.append(len(found))
                    own.append(ids.astype("<i4").tobytes())
                    times.append(count.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(times, pa.binary())], ["doc", "n", "terms", "times"])

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(extract, f"doc {kind}, n bigint, terms binary, times binary")


def stats(index: DataFrame, terms_in_block: int) -> Stats:
    """One aggregation: every task sends a count for each term of the block, and its documents and their lengths."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, length = np.zeros(terms_in_block, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=terms_in_block)
            docs += batch.num_rows
            length += pc.sum(batch.column("n")).as_py() or 0
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(held[some], [docs, length]))], ["term", "n"])

    found = index.select("n", "terms").mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number = dict(zip(found["term"].to_pylist(), found["n"].to_pylist()))
    n = number.get(-1, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * number.get(t, 0) + 1))) for t in range(terms_in_block)], np.int64)
    return Stats(n, number.get(-2, 0), weight)


class Shard:
    """Postings of a run of documents: term t has the documents doc[start[t]:start[t + 1]], ascending, and what it adds
    to their scores; most[t] is the largest of these."""

    def __init__(self, keys: pa.Array, n: np.ndarray, own: bytes, times: bytes, sizes: np.ndarray, s: Stats):
        self.keys, self.size = keys, len(n)
        term, tf = np.frombuffer(own, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        wide = LENGTH * int(n.max(initial=0)) * s.docs >= 1 << 63
        norm = 100 - LENGTH + (LENGTH * n.astype(object if wide else np.int64) * s.docs // max(s.length, 1)).astype(np.int64)
        doc = np.repeat(np.arange(self.size, dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        tf, self.doc = tf[order], doc[order]
        self.start = np.searchsorted(term[order], np.arange(len(s.weight) + 1))
        self.adds = s.weight[term[order]] * (1_000_000_000 * tf // (1000 * tf + REPEAT * norm[self.doc]))
        self.most = np.zeros(len(s.weight), np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds, self.start[held])
        place = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        self.place = np.empty(self.size, np.int64)
        self.place[place] = np.arange(self.size)
        self.score = np.zeros(self.size, np.int64)

    def search(self, term: np.ndarray, times: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, document) with scores above 0 and of floor at least: MaxScore."""
        most = times * self.most[term]
        order = np.argsort(-most, kind="stable")
        order = order[: np.count_nonzero(most)]
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what terms from the i-th on can add
        score, i = self.score, 0
        while i < len(order) and rest[i] >= floor:  # essential terms
            t = order[i]
            own = slice(self.start[term[t]], self.start[term[t] + 1])
            docs = self.doc[own]
            score[docs] += times[t] * self.adds[own]
            if len(docs) >= k:
                floor = max(floor, int(np.partition(score[docs], len(docs) - k)[len(docs) - k]))
            i += 1
        found = np.flatnonzero(score)
        for j in range(i, len(order)):  # the others, for documents that can still qualify
            found = found[score[found] + rest[j] >= floor]
            if not len(found):
                break
            t = order[j]
            own = slice(self.start[term[t]], self.start[term[t] + 1])
            docs = self.doc[own]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[at] == found
            score[found[hit]] += times[t] * self.adds[own][at[hit]]
            if len(found) >= k:
                floor = max(floor, int(np.partition(score[found], len(found) - k)[len(found) - k]))
        found = found[score[found] >= max(floor, 1)]
        best = found[np.lexsort((self.place[found], -score[found]))[:k]]
        out = [(int(score[d]), int(d)) for d in best]
        score[:] = 0
        return out


def search_block(index: DataFrame, block, numbers, k: int, item_kind: str) -> DataFrame:
    """(item, doc, score): the k best documents of each task for each item of the broadcast block."""
    doc_type = index.schema["doc"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, s = block.value, numbers.value
        best: list[list[tuple]] = [[] for _ in items.keys]
        held: list[pa.RecordBatch] = []
        size = 0
        key_type = None

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            own, times = (b"".join(rows[c].to_pylist()) for c in ("terms", "times"))
            sizes = pc.binary_length(rows["terms"]).to_numpy() // 4
            shard = Shard(rows["doc"].combine_chunks(), rows["n"].to_numpy(), own, times, sizes, s)
            for i, mine in enumerate(best):
                span = slice(items.start[i], items.start[i + 1])
                floor = -mine[-1][0] if len(mine) == k else 0
                got = shard.search(items.term[span], items.times[span], k, floor)
                if got:
                    keys = shard.keys.take(pa.array([d for _, d in got])).to_pylist()
                    mine += [(-score, key is None, key) for (score, _), key in zip(got, keys)]
                    mine.sort(key=lambda r: r if not r[1] else r[:2])
                    del mine[k:]

        for batch in batches:
            key_type = batch.schema.field("doc").type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                size += (pc.sum(pc.binary_length(part.column("terms"))).as_py() or 0) // 4
                if size >= SHARD_POSTINGS or sum(b.num_rows for b in held) >= SHARD_DOCS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if key_type is not None:
            of = pa.array([i for i, mine in enumerate(best) for _ in mine], pa.int64())
            yield pa.RecordBatch.from_arrays([items.keys.take(of), pa.array([r[2] for mine in best for r in mine], key_type), pa.array([-r[0] for mine in best for r in mine], pa.int64())], ["item", "doc", "score"])

    return index.mapInArrow(searched, f"item {item_kind}, doc {doc_type}, score bigint")


def search(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, k: int = 20) -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score above 0 for each item, equal scores by ascending doc.

    Items are taken in blocks of bounded size; a block's terms are broadcast, and postings of these terms are kept in the
    shared folder, so that each block reads the texts once. Tasks send their k best. Null and empty texts have no terms:
    such items have no rows, such documents count nowhere. Rows that share an item's key are one item, whose terms are
    those of all its texts; every row of docs is a document, repeats too; null keys of documents come last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = items.select(F.col(item_key).alias("item"), F.explode(terms(F.col(item_text))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    pairs = cut(pairs)
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    kind = items.schema[item_key].dataType.simpleString()
    found = None
    for b in range(blocks):
        block = block_of(pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b))
        index = cut(postings(docs, doc_key, doc_text, spark.sparkContext.broadcast(block.vocabulary)))
        numbers = stats(index, len(block.vocabulary))
        one = search_block(index, spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(numbers), k, kind)
        one = cut(one) if blocks > 1 else one
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item", "rank", "doc", "score")


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM len),
norm AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // length) AS m FROM len, total),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
wanted AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""
