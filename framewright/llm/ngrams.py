"""Operator 4, similarity join of word n-gram sets by PartEnum signatures.

A set falls into a size band. In a band the domain of n-grams is partitioned by hash, each part into PIECES pieces, and
for each part all subsets of PIECES - 1 pieces are enumerated; the set's n-grams in such a subset make one signature.
Two sets of similarity t differ in few n-grams, so that in some part all differences fall into one piece, and the
subset without it gives both sets the same signature. Sets that share a signature are compared exactly.

Large groups under a signature are not expanded into pairs: all members are compared with one of them, the hub, which
puts near copies into one component; only members whose components still differ are compared further, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, worker_cache
from .graph import connected_components

#: Pieces of each part; subsets leave out one of them.
PIECES = 3
#: Sizes of a band grow by this factor; it must exceed 1 / threshold.
BAND = 1.5
#: Chance, over the hash that deals n-grams to parts, that two linked sets share no signature.
MISS = 1e-12
#: Hashes that are tried before signatures of no n-gram are used, and largest groups that are expanded into all pairs.
TRIES, SMALL = 3, 6
#: Bytes of text that are hashed in one go at most (one text is never cut), and members compared with a hub by one task.
SLICE, CHUNK = 1 << 18, 256
#: Members of a large group that are compared with one another, or with as many others, by one task.
BLOCK, CLASSES = 4096, 16
#: Counters of a sketch; bits of the map that lets most texts without candidates stay where they are.
BINS, MAP_BITS = 128, 1 << 26

_rng = np.random.default_rng(20_240_607)
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _STEP = _odd(256), _odd(64)
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters all bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))  # type: ignore[return-value]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of texts that lie one behind another in data and end at ends. Bytes A-Z are lowered."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[ends] = True
    start = ~white
    start[1:] &= white[:-1] | first[1:-1]
    stop = ~white
    stop[:-1] &= white[1:] | first[1:-1]
    at, to = np.flatnonzero(start), np.flatnonzero(stop) + 1
    low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    up, down = _powers(1 << max(10, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(data)], out=total[1:])
    return mix((total[to] - total[at]) * down[at] + (to - at).astype(np.uint64)), np.searchsorted(ends, at, side="right")


def shingles(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct n-grams, by text and hash; a text of fewer words has its whole sequence as one."""
    words, of = word_hashes(data, ends)
    many = np.bincount(of, minlength=len(ends))
    found, owner = [], []
    if len(words) >= n:
        value = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            value += words[j : len(words) - n + 1 + j] * _STEP[j]
        whole = of[: len(value)] == of[n - 1 :]
        found.append(mix(value[whole]))
        owner.append(of[: len(value)][whole])
    few = np.flatnonzero((many > 0) & (many < n))
    begin = np.cumsum(many) - many
    for size in range(1, n):
        own = few[many[few] == size]
        if len(own):
            value = np.full(len(own), size, np.uint64)
            for j in range(size):
                value += words[begin[own] + j] * _STEP[j]
            found.append(mix(value))
            owner.append(own)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, of = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]


@lru_cache(4096)
def band_of(size: int) -> int:
    j = 0
    while BAND ** (j + 1) <= size:
        j += 1
    return j


@lru_cache(4096)
def parts_of(band: int, threshold: int) -> tuple[int, int]:
    """(parts, difference): the most n-grams in which linked sets can differ whose smaller is of this band, and the
    parts that make a shared signature certain, or miss it by a chance of MISS at most."""
    top = math.ceil(BAND ** (band + 1)) - 1
    worst = (100 - threshold) * (top + 100 * top // threshold) // (100 + threshold)
    sure = worst // 2 + 1
    for parts in range(max(1, worst // 12), sure):
        p = 1 - (1 - 1 / (PIECES * parts)) ** worst
        if parts * math.log(max(PIECES * p * p * (1 - p) + p**3, 1e-300)) <= math.log(MISS):
            return parts, worst
    return sure + (worst > 0), worst


def signatures(value: np.ndarray, of: np.ndarray, n_texts: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of sets given as (hash, text). A set has signatures of its own band and of the band of the
    smallest set that it may be linked with.

    Two sets share 2 * parts - difference signatures at least where those are certain. Signatures of no n-gram are left
    out, unless a set has so many of them that these might be all it shares; such sets repeat with other hashes.
    """
    sizes = np.bincount(of, minlength=n_texts)
    band = np.array([band_of(s) if s else -1 for s in sizes.tolist()], np.int64)
    least = np.array([band_of(-(-s * threshold // 100)) if s else -1 for s in sizes.tolist()], np.int64)
    out_sig, out_of = [], []
    for role in (0, 1):
        use = band if role == 0 else np.where(least < band, least, -1)
        live = use >= 0
        for seed in range(TRIES):
            if not live.any():
                break
            picked = np.flatnonzero(live)
            both = [parts_of(b, threshold) for b in use[picked].tolist()]
            parts, worst = np.array([x for x, _ in both], np.int64), np.array([x for _, x in both], np.int64)
            base = np.zeros(n_texts, np.int64)
            count = np.zeros(n_texts, np.int64)
            count[picked] = parts
            base[picked] = (np.cumsum(parts) - parts) * PIECES
            mine = live[of]
            h, t = mix(value[mine] + _STEP[40 + seed]), of[mine]
            part = ((h >> np.uint64(32)) * count[t].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            at = base[t] + part * PIECES + ((h & np.uint64(0xFFFFFF)) % np.uint64(PIECES)).astype(np.int64)
            n = int(parts.sum()) * PIECES
            content = np.zeros(n, np.uint64)
            np.add.at(content, at, mix(h + _STEP[50]))
            held = np.bincount(at, minlength=n).reshape(-1, PIECES)
            content = content.reshape(-1, PIECES)
            text = np.repeat(picked, parts)
            place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
            # Without one piece: what the other pieces hold, marked by band, hash, part and the piece left out.
            without = content.sum(1, keepdims=True) - content
            mark = (((use[text] * TRIES + seed) * (1 << 24) + place)[:, None] * PIECES + np.arange(PIECES)).astype(np.uint64)
            sig = mix(without + mix(mark + _STEP[60]))
            empty = held.sum(1, keepdims=True) == held
            hollow = np.bincount(text, weights=empty.sum(1), minlength=n_texts)[picked]
            certain = 2 * parts - worst
            # By chance parts are so many that sets have hundreds of signatures; a few hollow ones don't matter.
            weak = np.where(certain > 0, hollow >= certain, hollow > PIECES * parts // 20)
            live = np.zeros(n_texts, bool)
            live[picked[weak]] = True
            keep = ~empty if seed < TRIES - 1 else ~empty | live[text][:, None]
            out_sig.append(sig[keep])
            out_of.append(np.broadcast_to(text[:, None], sig.shape)[keep])
    return np.concatenate([np.zeros(0, np.uint64), *out_sig]), np.concatenate([np.zeros(0, np.int64), *out_of])


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, ends) of runs of texts of a string column of about SLICE bytes; nulls are empty."""
    worker_cache("ngrams")  # drops what operators before this one kept in the worker
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc, sid, n) of every row of docs (doc, sid, text): the number of distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, ends in _slices(b.column("text")):
                _, of = shingles(data, ends, n)
                many = pa.array(np.bincount(of, minlength=j - i).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc")[i:j], b.column("sid")[i:j], many], names=["doc", "sid", "n"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "sid", "text").mapInArrow(run, f"doc {kind}, sid long, n long")


def signature_rows(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """(sig, sid) of the texts of docs (sid, text); a task leaves out texts that it has seen, which pre-aggregates copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sids = b.column("sid").to_numpy()
            fresh = np.zeros(len(sids), bool)
            for k, s in enumerate(sids.tolist()):
                if s not in seen:
                    fresh[k] = True
                    seen.add(s)
            if len(seen) > 1_000_000:
                seen.clear()
            b, sids = b.filter(pa.array(fresh)), sids[fresh]
            for i, j, data, ends in _slices(b.column("text")):
                sig, of = signatures(*shingles(data, ends, n), j - i, threshold)
                yield _batch(sig=sig.view(np.int64), sid=sids[i:j][of])

    return docs.select("sid", "text").mapInArrow(run, "sig long, sid long")


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, sig) of sets that share a signature, given (sig, sid): all pairs a < b of groups of SMALL sets at most,
    with null sig, and the pairs of a larger group's smallest member, its hub, with each other one, with its sig.

    Rows are sorted by signature and streamed, so that no group is ever held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig, last_sid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hub: tuple[int, int] | None = None  # signature and hub of a large group that goes on

        def out(a, b, sig, known):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sig, mask=~known)], names=["a", "b", "sig"])

        def small(sig, sid):
            found = [(sid[:-d][same], sid[d:][same]) for d in range(1, min(SMALL, len(sig))) if (same := sig[:-d] == sig[d:]).any()]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield out(a, b, np.zeros(len(a), np.int64), np.zeros(len(a), bool))

        def starred(sig, a, b):
            if len(b):
                yield out(a, b, sig, np.ones(len(b), bool))

        for batch in batches:
            sig = np.concatenate([last_sig, batch.column(0).to_numpy()])
            sid = np.concatenate([last_sid, batch.column(1).to_numpy()])
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
            sig, sid = sig[new], sid[new]
            if hub is not None:
                run_on = int(np.searchsorted(sig != hub[0], True)) if sig[0] == hub[0] else 0
                run_on = run_on if run_on or sig[0] != hub[0] else len(sig)
                own = sid[:run_on][sid[:run_on] != hub[1]]
                yield from starred(np.full(len(own), hub[0]), np.full(len(own), hub[1]), own)
                sig, sid = sig[run_on:], sid[run_on:]
                last_sig, last_sid = sig[:0], sid[:0]
                if not len(sig):
                    continue
                hub = None
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(begin, len(sig)))
            large = np.repeat(size > SMALL, size)
            done = begin[-1] if size[-1] <= SMALL else len(sig)
            fit = ~large[:done]
            yield from small(sig[:done][fit], sid[:done][fit])
            hubs = np.repeat(sid[begin], size)
            members = large & (sid != hubs)
            yield from starred(sig[members], hubs[members], sid[members])
            last_sig, last_sid = sig[done:], sid[done:]
            if size[-1] > SMALL:
                hub = (int(sig[-1]), int(hubs[-1]))
        yield from small(last_sig, last_sid)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "sig").sortWithinPartitions("sig", "sid").mapInArrow(run, "a long, b long, sig long")


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(sid, n, sketch, grams) of docs (sid, text): counters of n-grams by hash, and 48 bits of each n-gram's hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, ends in _slices(b.column("text")):
                value, of = shingles(data, ends, n)
                many = np.bincount(of, minlength=j - i)
                bins = np.bincount(of * BINS + (value % np.uint64(BINS)).astype(np.int64), minlength=(j - i) * BINS)
                bins = np.minimum(bins, 65535).astype("<u2").reshape(j - i, BINS)
                stop = np.cumsum(many)
                cut6 = (value >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                grams = [cut6[e - m : e].tobytes() for e, m in zip(stop.tolist(), many.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("sid")[i:j], pa.array(many.astype(np.int64)), pa.array([x.tobytes() for x in bins], pa.binary()), pa.array(grams, pa.binary())], names=["sid", "n", "sketch", "grams"])

    return docs.select("sid", "text").mapInArrow(run, "sid long, n long, sketch binary, grams binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values of the sorted distinct b are in the sorted distinct a."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _grams(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def linked(pairs: DataFrame, vectors: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is threshold percent or more, by exact comparison.

    A pair whose sketches differ by more than linked sets can is not compared. The members of a hub a come to the hub's
    n-grams in chunks of about CHUNK, so that a hub of many members is spread over many tasks.
    """
    size = vectors.select("sid", "n", "sketch")
    of = lambda side: size.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(len(pdf), BINS).astype(np.int32) for c in ("s_a", "s_b"))
                na, nb = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
                far = np.abs(a - b).sum(1)
                ok = (far * (100 + threshold) <= (100 - threshold) * (na + nb)) & (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb))
                yield pdf.loc[ok, ["a", "b"]]

    close = cut(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(near, "a long, b long"))
    chunks = close.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k"))
    grams = vectors.select("sid", "grams")
    members = close.join(chunks, "a").join(grams.select(F.col("sid").alias("b"), "grams"), "b").select(F.col("a").alias("of"), F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("chunk"), "b", F.col("grams").alias("own"))
    hubs = chunks.join(grams.select(F.col("sid").alias("a"), "grams"), "a").select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"), F.col("grams").alias("all"))

    def compare(hub: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(hub) or not len(own):
            return pd.DataFrame({"a": [], "b": []}).astype(np.int64)
        x = _grams(hub["all"].iloc[0])
        good = []
        for y in own["own"]:
            y = _grams(y)
            both = common(x, y)
            good.append(100 * both >= threshold * (len(x) + len(y) - both))
        return own.loc[good, ["of", "b"]].set_axis(["a", "b"], axis=1)

    return hubs.groupBy("hub", "chunk").cogroup(members.groupBy("of", "chunk")).applyInPandas(compare, "a long, b long")


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts (sid, ...) whose sid is in ids; first by a map of MAP_BITS bits, so that few others are shuffled."""
    bit = F.pmod(F.col("sid"), F.lit(MAP_BITS)).cast("bigint") + 1
    bits = ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    held = F.expr("pmod(shiftright(cast(conv(hex(substring(bits, cast(floor(__at / 8) + 1 as int), 1)), 16, 10) as int), cast(pmod(__at, 8) as int)), 2) = 1")
    # A row for each 32,768 bits: 2,048 rows of 4 KB at most.
    some = texts.withColumns({"bucket": F.bitmap_bucket_number(bit), "__at": F.bitmap_bit_position(bit)}).join(F.broadcast(bits), "bucket").where(held).drop("bucket", "bits", "__at")
    return some.join(ids, "sid", "left_semi")


def components(docs: DataFrame, key: str, text: str, n: int = 5, threshold: int = 80) -> DataFrame:
    """(doc, sid, n, component): every row of docs, its number of distinct n-grams of words, and the smallest key that
    links reach from it. sid is the text's 64-bit hash.

    Words are what ASCII white space separates, with A-Z lowered. A text of fewer than n words has its whole sequence as
    one n-gram. Null, empty and blank texts have no n-gram, link with nothing and are components of their own; so is a
    row whose key is null unless linked to others, and then it has their smallest key. Equal texts are one set and
    meet again at the end, repeated rows too. Whole texts of any length count. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("sid", F.xxhash64("text"))
    sized = cut(set_sizes(rows, n))
    sets = sized.where("n > 0").groupBy("sid").agg(F.min("doc").alias("least"))
    found = cut(candidates(signature_rows(rows, n, threshold)))
    pairs = cut(found.select("a", "b").distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    # One row for each text: that of its smallest key. Copies have keys of their own, so that a hot text is no hot key.
    ids = cut(ids.join(sets, "sid"))
    marked = _wanted(rows, ids.select("sid")) if not ids.isEmpty() else rows.limit(0)
    one = _first_copies(marked, ids)
    vectors = cut(sketches(one, n))
    links = _all_links(found, pairs, vectors, threshold)
    joined = connected_components(links)
    home = joined.join(sets.withColumnRenamed("sid", "node"), "node").groupBy("component").agg(F.min("least").alias("first"))
    answer = joined.join(home, "component").select(F.col("node").alias("sid"), "first")
    own = sets.join(answer, "sid", "left").select("sid", F.coalesce("first", "least").alias("component"))
    linked_rows = sized.where("n > 0").join(own, "sid").select("doc", "sid", "n", "component")
    return linked_rows.unionByName(sized.where("n = 0").select("doc", "sid", "n", F.col("doc").alias("component")))


def _first_copies(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts (doc, sid, text) that hold the smallest doc of their sid, one for each sid."""
    least = ids.select("sid", "least")
    joined = rows.join(least, (rows["sid"] == least["sid"]) & rows["doc"].eqNullSafe(least["least"])).select(rows["sid"], "text")
    return joined.dropDuplicates(["sid"])


def _all_links(found: DataFrame, pairs: DataFrame, vectors: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that give the components of all links.

    First each set is compared with its smallest candidate, then with all others that it isn't connected with yet.
    Then members of large groups that still are in different components are compared by their sketches, in blocks, so
    that only pairs that may be linked become rows.
    """
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut(linked(first, vectors, threshold))
    rest = cut(_apart(pairs, cut(connected_components(links))).join(first, ["a", "b"], "left_anti"))
    links = cut(links.unionByName(linked(rest, vectors, threshold)))
    homes = cut(connected_components(links))
    large = found.where("sig is not null")
    # Only groups with a member that its hub isn't connected with can have links left; all else stays unjoined.
    open_sigs = large.join(_apart(pairs, homes), ["a", "b"], "left_semi").select("sig").distinct()
    members = large.join(open_sigs, "sig", "left_semi").select("sig", F.col("b").alias("sid")).distinct()
    parts = homes.select(F.col("node").alias("sid"), "component")
    group = members.join(parts, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    live = group.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), (F.min("component") < F.max("component")).alias("live")).where("live")
    group = cut(group.join(live, "sig").select("sig", "sid", "component", "blocks"))
    late = cut(close_pairs(group, vectors, threshold).distinct())
    return links.unionByName(linked(late, vectors, threshold))


def close_pairs(group: DataFrame, vectors: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of members of a group (sig, sid, component, blocks) in different components that their sketches let be linked.

    A group's members are dealt to its blocks of about BLOCK, and each pair of blocks is compared by one task. Members
    often share many groups. Groups fall into CLASSES; if the least group of some class is the same for two members, the
    first such group reports the pair and the other groups of this and later classes leave it out.
    """
    kind = lambda: F.pmod(F.col("sig"), F.lit(CLASSES))
    marks = group.groupBy("sid").agg(F.array(*[F.coalesce(F.min(F.when(kind() == k, F.col("sig"))), F.lit(0).cast("bigint")) for k in range(CLASSES)]).alias("marks"))
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("p"), F.greatest(F.col("block"), j).alias("q")))
    dealt = group.withColumn("block", block).join(vectors.select("sid", "n", "sketch").join(marks, "sid"), "sid").withColumn("at", F.explode(mates))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sig", "n"], kind="stable")
        sig, sid, n, part, of, p, q = (pdf[c].to_numpy() for c in ("sig", "sid", "n", "component", "block", "p", "q"))
        fine = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(len(pdf), BINS).astype(np.int32)
        coarse = fine.reshape(len(pdf), -1, 8).sum(2)
        marks, of_class = np.stack(pdf["marks"].to_list()), sig % CLASSES
        ends = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig))
        found = [np.zeros((0, 2), np.int64)]
        begin = 0
        for end in ends.tolist():
            # Sizes grow: all that may be linked with a row come soon after it.
            stops = begin + np.searchsorted(n[begin:end], n[begin:end] * 100 // threshold, side="right")
            for i, stop in enumerate(stops.tolist(), begin):
                if stop - i < 2:
                    continue
                most = (100 - threshold) * (n[i] + n[i + 1 : stop]) // (100 + threshold)
                ok = (np.abs(coarse[i + 1 : stop] - coarse[i]).sum(1) <= most) & (part[i + 1 : stop] != part[i])
                if p[i] != q[i]:
                    ok &= of[i + 1 : stop] != of[i]
                j = np.flatnonzero(ok)
                if len(j):
                    j = j[np.abs(fine[i + 1 + j] - fine[i]).sum(1) <= most[j]] + i + 1
                    c = of_class[i]
                    same = (marks[j] == marks[i]) & (marks[i] != 0)
                    j = j[~(same[:, :c].any(1) | same[:, c] & (marks[i, c] != sig[i]))]
                    found.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], 1))
            begin = end
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    tasks = 4 * int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("sig", "at.p", "at.q", "sid", "n", "component", "block", "sketch", "marks").withColumn("task", F.pmod(F.xxhash64("sig"), F.lit(tasks)))
    return dealt.groupBy("task", "p", "q").applyInPandas(compare, "a long, b long")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")


def join_documents(docs: DataFrame, key: str, text: str, n: int = 5, threshold: int = 80) -> DataFrame:
    """Every row of docs with n_shingles and component_id (see components); columns of docs named so are replaced.

    Rows are found again by key and text, so that rows that share a key keep apart.
    """
    found = components(docs, key, text, n, threshold).dropDuplicates(["doc", "sid"])
    found = found.select(F.col("doc").alias("__doc"), F.col("sid").alias("__found"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rows = docs.drop("n_shingles", "component_id").withColumn("__sid", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    same = (rows["__sid"] == found["__found"]) & rows[key].eqNullSafe(found["__doc"])
    return rows.join(found, same).drop("__sid", "__found", "__doc")


def keep_one(docs: DataFrame, key: str, text: str, n: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that lead their component: those whose key is its smallest. All columns of docs stay as they are.

    Rows without n-grams are kept all; so are rows that repeat the leading row's key and text. Rows with a null key stay only where no linked row has a key.
    """
    columns = docs.columns
    found = join_documents(docs, key, text, n, threshold)
    return found.where((F.col("n_shingles") == 0) | F.col(key).eqNullSafe(F.col("component_id"))).select(*[f"`{c}`" for c in columns])


#: The same over documents in DuckDB: all pairs of sets that share a shingle, and all that a document reaches by links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""
