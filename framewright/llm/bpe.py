"""Operator 9, byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap. Every chunk is pre-tokenised on its own, in parallel. Where two
neighbours share a pre-token boundary inside their overlap, they have resynchronised: the pattern looks only ahead, so
that from a common boundary on both find the same pre-tokens. Chunks are stitched at the first such boundary, and the
pieces between the stitches are encoded, again in parallel. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

#: Code points of a chunk and of the overlap with the next; the pattern never looks more than MARGIN past a match that
#: ends before a chunk's end.
CHUNK, OVERLAP, MARGIN = 32768, 2048, 3
#: Distinct pieces whose tokens a Python worker remembers: so many of late, and as many of before.
REMEMBERED = 200_000
#: Bytes from which a piece is merged by a heap, and code points of the longest piece that is remembered.
LONG, SHORT = 96, 64


class Codec:
    """Ranks of byte strings, and the pattern that splits text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # All tokens behind one another, and where each rank's begins and how long it is; -1: no such rank.
        self.lengths = np.full(max(self.ranks.values()) + 1, -1, np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        held = np.maximum(self.lengths, 0)
        self.starts = np.cumsum(held) - held
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.__getitem__)), np.uint8)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.pattern.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self.ids(pieces[at])
        return b"".join(found)

    def ids(self, piece: str) -> bytes:
        """The ids of one pre-token; the most frequent ones are remembered."""
        ids = self.known.get(piece) or self.before.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = np.array(self.merged(raw) if len(raw) >= LONG else self.merged_short(raw), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.before, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def merged_short(self, piece: bytes) -> list[int]:
        """As merged, for few bytes: the list of the neighbours' ranks is searched anew after each merge."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        none = 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[x] for x in parts]

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        """The raw bytes of the tokens of each list of ids; the bytes of about a million tokens are gathered at once."""
        out: list[bytes] = []
        begin = 0
        while begin < len(ids):
            end, held = begin, 0
            while end < len(ids) and (held < 1 << 22 or end == begin):
                held += len(ids[end] or b"")
                end += 1
            out += self._gathered([x or b"" for x in ids[begin:end]])
            begin = end
        return out

    def _gathered(self, ids: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        if len(flat) and (flat.max() >= len(self.lengths) or self.lengths[flat].min() < 0):
            raise ValueError("an id has no token")
        many = self.lengths[flat]
        ends = np.cumsum(many)
        at = np.repeat(self.starts[flat] - (ends - many), many)
        at += np.arange(len(at))
        raw = self.bytes[at].tobytes()
        stops = np.append(0, ends)[np.cumsum([len(x) // 4 for x in ids])].tolist()
        return [raw[i:j] for i, j in zip([0, *stops], stops)]

    def merged(self, piece: bytes) -> list[int]:
        """Merges the neighbours of least rank, leftmost first, until none is left; n log n by a heap."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop:
                continue
            end[i], live[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]

    def boundaries(self, text: str, last: bool) -> list[int]:
        """Ends of pre-tokens that more text after this could not move."""
        return [m.end() for m in self.pattern.finditer(text) if last or m.end() <= len(text) - MARGIN]


def codec(path: str, pattern: str) -> Codec:
    kept = worker_cache("bpe")
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(path, pattern)
    return kept[path, pattern]


def _mapped(df: DataFrame, column: str, to: str, kind: str, f) -> DataFrame:
    """df with column replaced by f of it, batch by batch; f takes and returns lists."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.drop(column).dtypes) + f", `{to}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                yield part.drop(columns=column).assign(**{to: f(part[column].tolist())})

    return df.mapInPandas(run, schema)


def _cuts(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, cuts) of each long text: where its pieces begin, in code points; null where chunks don't resynchronise."""
    chunks = long.select("__row", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil((F.char_length("__text") - overlap) / chunk).cast("int") - 1), lambda i: F.struct((i * chunk).alias("at"), F.substring(F.col("__text"), i * chunk + 1, F.lit(chunk + overlap)).alias("part")))).alias("i", "c"), F.char_length("__text").alias("n"))
    chunks = chunks.select("__row", "i", "c.at", "n", "c.part").withColumn("last", F.col("at") + chunk + overlap >= F.col("n"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[at + e for e in codec(path, pattern).boundaries(t, last)] for t, at, last in zip(pdf["part"], pdf["at"], pdf["last"])]
            head = [[e for e in x if e < at + overlap] for x, at in zip(found, pdf["at"])]
            tail = [[e for e in x if e >= at + chunk] for x, at in zip(found, pdf["at"])]
            yield pdf[["__row", "i"]].assign(head=head, tail=tail)

    # A boundary's two sides come from the chunk before it (its tail) and the one after it (its head).
    found = chunks.mapInPandas(ends, "__row string, i int, head array<long>, tail array<long>")
    sides = found.select("__row", F.explode(F.array(F.struct("i", F.col("head").alias("head"), F.lit(None).cast("array<long>").alias("tail")), F.struct((F.col("i") + 1).alias("i"), F.lit(None).cast("array<long>").alias("head"), F.col("tail").alias("tail")))).alias("s"))
    both = sides.groupBy("__row", F.col("s.i").alias("i")).agg(F.max("s.head").alias("head"), F.max("s.tail").alias("tail")).where("head is not null and tail is not null")
    stitched = both.select("__row", F.array_min(F.array_intersect("tail", "head")).alias("at"))
    return stitched.groupBy("__row").agg(F.when(F.count("at") == F.count("*"), F.array_sort(F.collect_list("at"))).alias("__cuts"))


def encode(docs: DataFrame, text: str, path: str, pattern: str, to: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Replaces column text by to: binary, the ids of the whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Special tokens are ordinary text. Texts longer than chunk + overlap
    code points take the way over chunks; those whose chunks find no common boundary (one run of letters or white
    space that fills an overlap) are encoded as one piece. Repeated rows stay; an empty table stays empty. A column of
    docs named like to is replaced. path is that of the rank file on every worker.
    """
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("__text", whole).drop(text, to)
    encoder = lambda xs: [codec(path, pattern).encode(x) for x in xs]
    is_long = F.char_length("__text") > chunk + overlap
    short = _mapped(rows.where(~is_long), "__text", to, "binary", encoder)
    long = rows.where(is_long).withColumn("__row", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)])), 256))
    texts = long.select("__row", "__text").dropDuplicates(["__row"])
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("__cuts", F.array().cast("array<bigint>")))
    pieces = texts.join(_cuts(texts, path, pattern, chunk, overlap), "__row", "left").withColumn("__from", bounds)
    stop = lambda i: F.coalesce(F.get(F.col("__from"), i + 1), F.char_length("__text").cast("bigint"))
    pieces = pieces.select("__row", F.posexplode(F.transform("__from", lambda a, i: F.substring(F.col("__text"), (a + 1).cast("int"), (stop(i) - a).cast("int")))).alias("__i", "__piece"))
    joined = _mapped(pieces, "__piece", "__ids", "binary", encoder).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__i", "__ids"))).alias("__all"))
    glued = joined.select("__row", F.unhex(F.array_join(F.transform("__all", lambda x: F.hex(x["__ids"])), "")).alias(to))
    return short.unionByName(long.drop("__text").join(glued, "__row").drop("__row"))


def decode(df: DataFrame, ids: str, path: str, pattern: str, to: str = "bytes") -> DataFrame:
    """Replaces column ids (as encode writes them) by to: binary, the raw bytes of the tokens; null ids give none.

    An id without a token fails the job. Repeated rows stay; an empty table stays empty.
    """

    def bytes_of(xs: list) -> list[bytes]:
        return codec(path, pattern).decode(xs)

    return _mapped(df.drop(to) if to != ids else df, ids, to, "binary", bytes_of)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("bigint")
