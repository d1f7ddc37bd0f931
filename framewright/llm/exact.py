"""Operator 7, exact dedup against a minimal perfect hash over the distinct digests seen before.

The history's distinct digests are dealt to parts of about PART_KEYS; each part gets a minimal perfect hash by
displacement: a digest falls into a small bucket, and the bucket's pilot sends its digests to slots of their own. If a
part's digests find no slots, they are read as other numbers, by the next seed, which is stored with the pilots. A
slot holds the full digest and the locator of the winner. A new row finds its slot by two equi-joins (pilot, then
slot) and is a member only if the slot's digest equals its own byte for byte; the others are grouped among
themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_from

#: Distinct digests of a part on average, and buckets of every part.
PART_KEYS, BUCKETS = 4096, 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, digest) of every row: hexadecimal SHA-256 of the normalised whole text."""
    return docs.select(F.col(key).alias("doc"), F.sha2(normalised(F.col(text)), 256).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, winner, n) of each distinct digest; the winner is the smallest key that is not null."""
    return rows.groupBy("digest").agg(F.min("doc").alias("winner"), F.count("*").alias("n"))


#: Shares of a hot digest's rows at the last join.
SALTS = 64
#: Ways in which a part's digests are read as numbers, tried in turn; the slot's places are drawn from all 256 bits.
SEEDS, TURNS = 64, 4096


def _field(column: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(column, at, digits), 16, 10).cast("bigint")


def _placed(rows: DataFrame, parts: int) -> DataFrame:
    """Adds the part of a digest."""
    return rows.withColumn("part", _field(F.col("digest"), 1, 8) % parts)


def _numbers(seed: Column) -> tuple[Column, Column, Column]:
    """Three numbers of a digest for its bucket and slot. They follow from the whole digest and the seed of its part, so
    that digests that can't be told apart under one seed are under another."""
    drawn = F.md5(F.concat("digest", F.lit("/"), seed.cast("string")))
    return _field(drawn, 1, 8), _field(drawn, 9, 8), _field(drawn, 17, 7)


def _pilots(h0: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray | None:
    """The pilot of each bucket, so that all digests have different slots of len(h0); None where there are none: two
    digests of a bucket that agree modulo len(h0) in both numbers meet at every pilot."""
    n = len(h0)
    of = h0 % BUCKETS
    pilots, free = np.zeros(BUCKETS, np.int64), np.ones(n, bool)
    sizes = np.bincount(of, minlength=BUCKETS)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(sizes)
    places = np.arange(n)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = order[ends[b] - sizes[b] : ends[b]]
        a, c = h1[own] % n, h2[own] % n
        if len({*zip(a.tolist(), c.tolist())}) < len(own):
            return None
        if sizes[b] == 1:
            shift, turn = int((np.flatnonzero(free)[0] - a[0]) % n), 0
        else:
            for turn in range(TURNS):
                at = (a + turn * c) % n
                if len(np.unique(at)) < len(at):
                    continue
                good = free[(at[0] + places) % n]
                for x in at[1:]:
                    good &= free[(x + places) % n]
                if good.any():
                    shift = int(good.argmax())
                    break
            else:
                return None
        pilots[b] = turn * n + shift
        free[(a + turn * c + shift) % n] = False
    return pilots


def _drawn(digests: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _numbers gives, in a task."""
    found = [hashlib.md5(f"{d}/{seed}".encode()).hexdigest() for d in digests]
    h0, h1, h2 = (np.array([int(x[i:j], 16) for x in found], np.int64) for i, j in ((0, 8), (8, 16), (16, 23)))
    return h0, h1, h2


def place_part(digests: list[str]) -> tuple[int, np.ndarray]:
    """(seed, pilots) of a part's distinct digests: the first seed under which all find slots of their own. A seed fails
    with a chance of about 1 in 2,000, so that SEEDS of them fail together practically never."""
    for seed in range(SEEDS):
        pilots = _pilots(*_drawn(digests, seed))
        if pilots is not None:
            return seed, pilots
    raise ValueError(f"no seed of {SEEDS} separates the {len(digests)} digests of a part")


def build_index(history: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The perfect hash over history, a (digest, winner, n) table of distinct digests: (pilots, slots, number of parts).

    pilots: part, bucket, pilot, size (slots of the part), seed. slots: part, slot, member (the full digest), winner, n;
    there are as many slots as digests. An empty history gives empty tables.
    """
    history = cut(history)
    parts = max(1, -(-history.count() // PART_KEYS))
    placed = _placed(history, parts)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, pilots = place_part(pdf["digest"].tolist())
        return pd.DataFrame({"part": pdf["part"].iloc[0], "bucket": np.arange(len(pilots)), "pilot": pilots, "size": len(pdf), "seed": seed})

    schema = "part long, bucket long, pilot long, size long, seed long"
    pilots = cut(placed.select("part", "digest").groupBy("part").applyInPandas(build, schema))
    slots = _slotted(placed, pilots).select("part", "slot", F.col("digest").alias("member"), "winner", "n")
    return pilots, slots, parts


def _slotted(placed: DataFrame, pilots: DataFrame) -> DataFrame:
    """Adds the slot: the part's seed gives the digest's bucket, whose pilot moves the digest to its slot."""
    seeds = pilots.where("bucket = 0").select("part", "seed")
    h0, h1, h2 = _numbers(F.col("seed"))
    numbered = placed.join(seeds, "part").withColumns({"bucket": h0 % BUCKETS, "__h1": h1, "__h2": h2}).drop("seed")
    size, pilot = F.col("size"), F.col("pilot")
    turn, shift = (pilot - pilot % size) / size, pilot % size
    slot = (F.col("__h1") % size + turn.cast("bigint") % size * (F.col("__h2") % size) + shift) % size
    found = numbered.join(pilots.drop("seed"), ["part", "bucket"]).withColumn("slot", slot)
    return found.drop("__h1", "__h2", "bucket", "pilot", "size")


def lookup(rows: DataFrame, index: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """Adds winner and n to rows (digest, ...), null where the digest isn't in the index. Rows of one digest come as one."""
    pilots, slots, parts = index
    found = _slotted(_placed(rows, parts), pilots).join(slots, ["part", "slot"]).where("digest = member")
    return rows.join(found.select("digest", "winner", "n"), "digest", "left")


def dedup(rows: DataFrame, index: tuple[DataFrame, DataFrame, int], history_first: bool = True) -> DataFrame:
    """(digest, keep, group_size, known) of each distinct digest of rows (doc, digest), and how many rows hold it.

    Digests that the index knows keep the history's winner (history_first) or the smaller key of both sides; the
    rest are grouped separately and keep their smallest key. group_size counts both sides' rows.
    """
    fresh = winners(rows)
    known = lookup(fresh.select("digest"), index)
    both = fresh.withColumnsRenamed({"winner": "own", "n": "own_n"}).join(known, "digest")
    keep = F.coalesce("winner", "own") if history_first else F.least("winner", "own")
    return both.select("digest", keep.alias("keep"), (F.col("own_n") + F.coalesce("n", F.lit(0))).alias("group_size"), F.col("n").isNotNull().alias("known"))


def dedup_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, keep_id, group_size, kept, text_sha256) of every row of docs, dropped ones too.

    Half of the digests' rows, those whose key has an even CRC-32, are the history that the perfect hash is built
    over; the other half is looked up, and nonmembers are grouped separately. Of equal texts the smallest key stays;
    null keys lose to others and keep null if a group has no other. Of rows that repeat the winning key all count as
    kept. Null texts count as empty. An empty table gives an empty one.
    """
    rows = digests(docs, key, text)
    rows = cut(rows)
    past = F.pmod(F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit(""))), F.lit(2)) == 0
    history = winners(rows.where(past))
    index = build_index(history)
    new = dedup(rows.where(~past), index, history_first=False)
    old = index[1].select(F.col("member").alias("digest"), F.col("winner").alias("keep"), F.col("n").alias("group_size"))
    groups = cut(old.join(new.where("known"), "digest", "left_anti").unionByName(new.drop("known")))
    return _joined(rows, groups).select(
        "doc", F.col("keep").alias("keep_id"), "group_size", F.col("keep").eqNullSafe(F.col("doc")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the answer of their digest. The answer of a hot digest is repeated for SALTS shares, which the key of a
    row picks, so that the copies of one text are not one task's."""
    hot = F.col("group_size") >= hot_from(rows.count())
    shares = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    answers = groups.withColumn("share", F.explode(shares))
    marks = groups.where(hot).select("digest", F.lit(True).alias("hot"))
    share = F.when(F.col("hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    # hot_from bounds the marks.
    dealt = rows.join(F.broadcast(marks), "digest", "left").withColumn("share", share).drop("hot")
    return dealt.join(answers, ["digest", "share"]).drop("share")


ORACLE_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)"""
