"""Operator 3, toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two strings sums over their common subsequences of ORDER characters, each weighted by DECAY to the power
of the lengths it spans, and is normalised. Gaps only lessen it, so an insult with characters put in between, or with
another ending, still is near its landmark. A sentence is as near to a landmark as the nearest of its words, a
document as toxic as its most toxic sentence. Landmarks are character n-grams of words that tell toxic from other
documents, and clean words close to these; their kernel matrix gives the Nystroem map, on which a linear machine is
trained by labelled sentences.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, give_back_memory, small_batches, worker_cache

ORDER, DECAY = 3, 0.6
#: Longer words are read in overlapping windows of this many characters.
WIDTH = 16
#: Lengths of landmarks, how many each telling word is given, and landmarks that are clean words at most.
GRAMS, COVER, COUNTER = (4, 5, 6, 7, 8), 2, 32
#: Toxic documents that must hold a telling word, at any size, and how much more often than others they do.
SUPPORT, LIFT = 3, 20
#: Toxic documents that the classifier is fitted on for each telling word at least, if there are so many.
EACH = 10
#: Cost of a clean sentence on the wrong side against that of a toxic one.
CLEAN_COST = 1.5
#: Sentences of a document that the classifier is fitted on at most: of a clean one the nearest to landmarks, of a toxic
#: one the first that hold telling words.
PER_TEXT, PER_TOXIC = 5, 50
#: Share of a landmark's neighbouring characters that a word must hold, in order and not far apart, to be compared.
SHARED = 0.5
#: Labelled documents of either label that the classifier is fitted on, besides those for telling words.
MAX_TRAIN = 3000
#: Labels (a key and a flag) that are broadcast at most, some 50 MB.
FEW_LABELS = 1_000_000
#: Tokens whose kernels a Python worker remembers: so many of late, and as many of before.
REMEMBERED = 100_000
#: Bytes of kernels from which a worker forgets older ones.
HELD_BYTES = 1 << 26
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n")
SIGNS = re.compile(r"[\W_]+")
SPELLED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
TRIM = ".,;:!?\"'()[]{}<>«»„“”…"


class Machine(NamedTuple):
    landmarks: list[str]
    weights: np.ndarray  # of the landmarks' kernels: the Nystroem map is folded in
    bias: float
    slope: float
    shift: float


def prepared(text: str) -> str:
    """Lower case, with words that are spelled out by spaces joined."""
    if SPELLED.search(text):
        text = SPELLED.sub(lambda m: re.sub(r"\s", "", m[0]), text)
    return text.lower()


#: Stands between the tokens of lines; in texts it counts as white space.
LINE = "\x00"


def tokens_of(text: str) -> list[str]:
    """prepared(text).split() with LINE between the lines, in one pass where no word is spelled out."""
    low = text.replace(LINE, " ").lower()
    tokens = low.replace("\n", f" {LINE} ").split()
    try:
        spelled = b"\1\1\1" in bytes(map(len, tokens)) or "i\u0307" in low  # the only character that lower case makes two
    except ValueError:  # a token of more than 255 characters
        spelled = True
    if spelled and SPELLED.search(text):
        tokens = prepared(text.replace(LINE, " ")).replace("\n", f" {LINE} ").split()
    return tokens


def numbered(tokens: list[str]) -> tuple[np.ndarray, list[str]]:
    """The number of each token, and the different tokens in the order of their numbers."""
    number: dict[str, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    return codes, list(number)


def words_of(token: str) -> list[str]:
    """A token of a prepared text as a word marked at both ends, without outer punctuation; one with signs inside also
    comes without them."""
    w = token.strip(TRIM)
    if not w:
        return []
    out = ["^" + w + "$"]
    if not w.isalnum() and (bare := SIGNS.sub("", w)):
        out.append("^" + bare + "$")
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Character codes of strings of width characters at most, padded with 0."""
    out = np.zeros((len(strings), width), np.int32)
    many = np.array([len(s) for s in strings], np.int64)
    out[np.arange(width) < many[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


@cache
def _reach(n: int) -> np.ndarray:
    """[i, j]: DECAY to the power of the characters between j and a later i, else 0."""
    gap = np.arange(n)[:, None] - np.arange(n) - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32)


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel of a[i] with b[i], rows of character codes padded with 0. A common subsequence that ends at a pair of
    equal characters goes on at a later such pair; all rows take each step in two matrix products. Rows are the last
    axis: words and landmarks are short, so that any other layout spends its time between the inner loops."""
    (n, la), lb = a.shape, b.shape[1]
    left, right = _reach(la), _reach(lb)
    out = np.empty(n, np.float32)
    for at in range(0, n, 512):
        x, y = np.ascontiguousarray(a[at : at + 512].T), np.ascontiguousarray(b[at : at + 512].T)
        same = (x[:, None] == np.where(y > 0, y, -1)) * np.float32(DECAY * DECAY)  # [la, lb, rows]
        ended = same
        for _ in range(ORDER - 1):
            ended = (left @ (right @ ended).reshape(la, -1)).reshape(same.shape)
            ended *= same
        out[at : at + 512] = ended.reshape(la * lb, -1).sum(0)
    return out


def _pair_bits(codes: np.ndarray, reach: int) -> np.ndarray:
    """[rows, 4] of 64 bits: hashes of the characters that stand up to reach places apart, in order."""
    out = np.zeros((len(codes), 256), np.uint8)
    row = np.arange(0, out.size, 256)[:, None]
    for d in range(1, reach + 1):
        a, b = codes[:, :-d].astype(np.int64), codes[:, d:].astype(np.int64)
        out.reshape(-1)[(row + ((a * 40503 + b * 30011 >> 3) & 255))[b > 0]] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def kernels(words: list[str], landmarks: list[str]) -> np.ndarray:
    """[words, landmarks]: normalised kernels, however small; 0 where SHARED is not met. A long word's is the largest of
    its windows'."""
    windows, of = [], []
    for i, w in enumerate(words):
        for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
            windows.append(w[at : at + WIDTH])
            of.append(i)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not windows or not landmarks:
        return out
    a, b = _codes(windows, WIDTH), _codes(landmarks, max(map(len, landmarks)))
    bits, marks = _pair_bits(a, 3), _pair_bits(b, 1)
    need = np.ceil(SHARED * np.bitwise_count(marks).sum(1))
    step = max(1, 2**16 // len(landmarks))
    near = []
    for at in range(0, len(a), step):
        own = bits[at : at + step]
        held = sum(np.bitwise_count(own[:, k, None] & marks[:, k]) for k in range(4))
        near.append(np.argwhere(held >= need) + [at, 0])
    i, j = np.concatenate(near).T
    long, short = (a > 0).sum(1), (b > 0).sum(1)
    by_length = np.lexsort((long[i], short[j]))
    i, j = i[by_length], j[by_length]
    self_b = subsequence_kernel(b, b)
    compared = np.zeros(len(a), bool)
    compared[i] = True
    rows = np.flatnonzero(compared)
    rows = rows[np.argsort(long[rows], kind="stable")]
    self_a = np.ones(len(a), np.float32)
    for at in range(0, len(rows), 512):
        own = rows[at : at + 512]
        x = a[own, : long[own[-1]]]
        self_a[own] = subsequence_kernel(x, x)
    value = np.empty(len(i), np.float32)
    for at in range(0, len(i), 512):
        p, q = i[at : at + 512], j[at : at + 512]
        value[at : at + 512] = subsequence_kernel(a[p, : long[p].max()], b[q, : short[q[-1]]])
    value /= np.sqrt(np.maximum(self_a[i] * self_b[j], 1e-12))
    if len(windows) == len(words):
        out[i, j] = value
    else:
        np.maximum.at(out, (np.array(of)[i], j), value)
    return out


class Features:
    """Kernels of tokens, remembered, and the features of sentences. Tokens are known without outer punctuation, which no
    kernel looks at."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.known: dict[str, int] = {}  # the row of a token's kernels; -1 if it is near no landmark
        self.rows = np.zeros((0, len(landmarks)), np.float32)
        self.before = self.known, self.rows

    def learn(self, tokens: set[str]) -> None:
        """Kernels of tokens without outer punctuation. When there are too many, those that don't come again for as long
        are forgotten."""
        if len(self.known) > REMEMBERED or self.rows.nbytes > HELD_BYTES:
            self.before = self.known, self.rows
            self.known, self.rows = {}, self.rows[:0]
        known, rows = self.before
        new = tokens.difference(self.known)
        again = list(new.intersection(known))
        own = np.array([known[x] for x in again], np.int64)
        grown = [self.rows]
        self._add(again, own >= 0, rows[own[own >= 0]], grown)
        fresh = sorted(new.difference(known))
        for at in range(0, len(fresh), 4_000):
            part = fresh[at : at + 4_000]
            words = [["^" + t + "$"] if t.isalnum() else words_of(t) for t in part]
            own = kernels([*chain.from_iterable(x[:1] for x in words), *chain.from_iterable(x[1:] for x in words)], self.landmarks)
            found = np.zeros((len(part), len(self.landmarks)), np.float32)
            one, two = (np.array([k for k, x in enumerate(words) if len(x) > n], int) for n in (0, 1))
            found[one] = own[: len(one)]
            found[two] = np.maximum(found[two], own[len(one) :])
            near = found.any(axis=1)
            self._add(part, near, found[near], grown)
        self.rows = np.concatenate(grown)

    def _add(self, tokens: list[str], near: np.ndarray, rows: np.ndarray, grown: list[np.ndarray]) -> None:
        begin = sum(map(len, grown))
        self.known.update(zip(tokens, np.where(near, begin + np.cumsum(near) - 1, -1).tolist()))
        grown.append(rows)

    def sentences(self, texts: list[str | None], told: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each row, features, holds a word of told) of the sentences that hold a word near a landmark; all
        others are all 0."""
        own = [tokens_of(t) if t else [] for t in texts]
        codes, unique = numbered([LINE, *chain.from_iterable(own)])
        codes = codes[1:]
        bare = [x.strip(TRIM) for x in unique]
        self.learn(set(bare[1:]))
        row = np.array([-1, *map(self.known.__getitem__, bare[1:])], np.int64)[codes]
        text = np.repeat(np.arange(len(texts)), [len(x) for x in own])
        # A sentence ends with a line, with a text, and behind a token that ends with one of these signs.
        ends = np.array([x[-1] in ".!?" for x in unique], bool)[codes] | (codes == 0)
        new = np.append(True, ends[:-1] | (text[1:] != text[:-1])) if len(codes) else np.zeros(0, bool)
        sentence = np.cumsum(new) - 1
        hit = np.flatnonzero(row >= 0)
        found, first = np.unique(sentence[hit], return_index=True)
        features = np.zeros((len(found), len(self.landmarks)), np.float32)
        last = np.append(first[1:], len(hit))
        at = 0
        while at < len(found):  # a bounded number of kernels at once
            stop = max(at + 1, int(np.searchsorted(last, first[at] + 20_000, side="right")))
            features[at:stop] = np.maximum.reduceat(self.rows[row[hit[first[at] : last[stop - 1]]]], first[at:stop] - first[at])
            at = stop
        marked = np.zeros(int(sentence[-1]) + 1 if len(codes) else 0, bool)
        if told and len(codes):
            says = np.array([x != LINE and any(w in told for w in words_of(x)) for x in unique], bool)
            marked[sentence[says[codes]]] = True
        return text[hit[first]], features, marked[found]


def remembered(landmarks: list[str]) -> Features:
    """The Python worker's kernels with these landmarks; those with others are forgotten."""
    kept, key = worker_cache("toxicity"), tuple(landmarks)
    if key not in kept:
        kept.clear()
        kept[key] = Features(landmarks)
    return kept[key]


def _document_counts(labelled: DataFrame) -> DataFrame:
    """(item, bad, good): how many toxic and other documents hold each word."""

    def told(number: dict[str, int], seen: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"item": pd.Series(list(number), dtype=object), "bad": seen[1], "good": seen[0]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")  # drops what operators before this one kept in the worker
        known: dict[str, tuple[int, int]] = {}  # the numbers of a token's words; of one that comes once the second is -1
        number: dict[str, int] = {}
        seen = np.zeros((2, 0), np.int64)
        for pdf in batches:
            texts = [tokens_of(t) for t in pdf["text"]]
            codes, unique = numbered([*chain.from_iterable(texts)])
            for x in unique:
                if x not in known:
                    own = [number.setdefault(w, len(number)) for w in words_of(x)] if x != LINE else []
                    known[x] = (*own, -1, -1)[:2]
            words = np.array([known[x] for x in unique], np.int64).reshape(-1, 2)[codes]
            doc, n = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(number)
            pairs = np.unique(np.concatenate([(doc * n + w)[w >= 0] for w in words.T]))
            bad = pdf["y"].to_numpy(bool)[pairs // n] if n else np.zeros(0, bool)
            more = np.stack([np.bincount(pairs[bad == y] % max(n, 1), minlength=n) for y in (False, True)])
            more[:, : seen.shape[1]] += seen
            seen = more
            if n > REMEMBERED:  # what is remembered is bounded; a word may be told again
                yield told(number, seen)
                known, number, seen = {}, {}, seen[:, :0]
        if number:
            yield told(number, seen)
        del known, number, seen
        give_back_memory()

    counts = labelled.select("text", "y").mapInPandas(run, "item string, bad long, good long")
    return counts.groupBy("item").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _gram_counts(words: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(item, bad, good): documents that hold each n-gram in wanted, counted once for each word that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")  # drops what operators before this one kept in the worker
        for pdf in batches:
            found: dict[str, list[int]] = {}
            for w, bad, good in zip(pdf["item"], pdf["bad"].tolist(), pdf["good"].tolist()):
                for g in grams_of(w) & wanted:
                    own = found.setdefault(g, [0, 0])
                    own[0] += bad
                    own[1] += good
            yield pd.DataFrame({"item": pd.Series(list(found), dtype=object), "bad": np.array([x[0] for x in found.values()], np.int64), "good": np.array([x[1] for x in found.values()], np.int64)})

    counts = words.mapInPandas(run, "item string, bad long, good long")
    return counts.groupBy("item").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _marks(text: str, words: frozenset[str]) -> dict[str, int]:
    """For each of words that the text holds the least hash of two neighbouring tokens that are not this word: copies of
    a text, and most of its near copies, have the same; other texts with the word don't."""
    tokens = np.array(prepared(text).split(), object)
    holders: dict[str, list[str]] = defaultdict(list)
    for x in set(tokens.tolist()):
        for w in words_of(x):
            if w in words:
                holders[w].append(x)
    if not holders:
        return {}
    h = pd.util.hash_array(tokens)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = {}
    for w, own in holders.items():
        other = ~np.isin(h, pd.util.hash_array(np.array(own, object)))
        rest = pair[other[:-1] & other[1:]]
        out[w] = int(rest.min().view(np.int64)) if len(rest) else 0
    return out


def _holders(toxic: DataFrame, key: str, words: frozenset[str]) -> DataFrame:
    """(key, w, mark): the toxic documents that hold each of words, with their marks."""
    kind = dict(toxic.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")  # drops what operators before this one kept in the worker
        for pdf in batches:
            own = [_marks(t, words) for t in pdf["text"]]
            w, mark = [w for x in own for w in x], [m for x in own for m in x.values()]
            yield pd.DataFrame({"k": pdf[key].repeat([len(x) for x in own]), "w": pd.Series(w, dtype=object).to_numpy(), "mark": np.array(mark, np.int64)})

    return toxic.select(key, "text").mapInPandas(run, f"k {kind}, w string, mark long").distinct()


def _examples(held: DataFrame, key: str) -> DataFrame:
    """(key): for each word of held EACH documents with different marks, by the order of the key's CRC-32."""
    order = [F.crc32(F.col("k").cast("string")), F.col("k")]
    one = held.groupBy("w", "mark").agg(F.min_by("k", F.struct(*order)).alias("k"))
    place = F.row_number().over(Window.partitionBy("w").orderBy(*order))
    return one.withColumn("place", place).where(F.col("place") <= EACH).select(F.col("k").alias(key)).distinct()


def grams_of(word: str) -> set[str]:
    return {word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1)}


def _telling(counts: DataFrame, n_bad: int, n_good: int, n: int = 1) -> dict[str, int]:
    """Items that SUPPORT toxic documents hold, LIFT times as often as others do; each with its toxic documents.

    By Chernoff's bound on the chance that labels dealt at random give an item so many toxic documents, at most one of n
    items is here by chance. With n = 1 nothing is tested: n-grams of tested words need no test of their own.
    """
    p = n_bad / (n_bad + n_good)
    both = F.col("bad") + F.col("good")
    surprise = F.col("bad") * F.log(F.col("bad") / both / p) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / both / (1 - p))).otherwise(0.0)
    lifted = F.col("bad") / n_bad > LIFT * (F.col("good") + 0.1) / n_good
    told = counts.where((F.col("bad") >= SUPPORT) & lifted & (surprise >= F.lit(float(np.log(max(1, n))))))
    return {r["item"]: r["bad"] for r in told.collect()}


def _telling_words(counts: DataFrame, toxic: DataFrame, key: str, n_bad: int, n_good: int) -> tuple[dict[str, int], DataFrame]:
    """The words that tell toxic documents from others, and the documents that hold them (see _holders).

    Copies are no evidence of their own: a word that only one text and its copies hold is in as many toxic documents as
    there are copies. So words that pass by all documents are tested again with the documents of one mark as one. That
    lessens only the count of toxic documents, so that no word that would pass is lost in the first test.
    """
    n = counts.where(F.col("bad") >= SUPPORT).count()
    first = frozenset(_telling(counts, n_bad, n_good, n))
    held = cut(_holders(toxic, key, first))
    apart = held.groupBy(F.col("w").alias("item")).agg(F.countDistinct("mark").alias("bad"))
    again = apart.join(counts.select("item", "good"), "item")
    words = _telling(again, n_bad, n_good, n)
    return words, held.where(F.col("w").isin(list(words))) if words else held.limit(0)


def pick_landmarks(words: dict[str, int], grams: dict[str, int]) -> list[str]:
    """n-grams that cover every telling word COVER times, where it has so many, those that cover most toxic documents
    first. Gains only fall, so that the best of the heap is the best of all if its gain still holds."""
    holders = defaultdict(list)
    for w in sorted(words):
        for g in grams_of(w) & grams.keys():
            holders[g].append(w)
    left = dict.fromkeys(words, COVER)
    gain = lambda g: sum(words[w] * len(g) for w in holders[g] if left[w] > 0)
    heap = [(-gain(g), g) for g in holders]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap:
        old, best = heapq.heappop(heap)
        now = gain(best)
        if now != -old:
            if now:
                heapq.heappush(heap, (-now, best))
            continue
        chosen.append(best)
        for w in holders[best]:
            left[w] -= 1
    return chosen


def _sentence_rows(sample: DataFrame, landmarks: list[str], words: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, toxic) of labelled sentences: those of toxic documents that hold a telling word, and of each other
    document the PER_TEXT sentences nearest to landmarks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = remembered(landmarks)
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                y = part["y"].to_numpy(bool)
                of, x, told = features.sentences(part["text"].tolist(), words)
                order = np.lexsort((-x.max(axis=1, initial=0), of))
                place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
                rank = np.empty(len(of), int)
                rank[order] = place
                seen = np.cumsum(told) - told  # telling sentences before each one, of its own text and of texts before
                nth = seen - seen[np.searchsorted(of, of)] if len(of) else seen
                use = np.where(y[of], told & (nth < PER_TOXIC), rank < PER_TEXT) if len(of) else np.zeros(0, bool)
                yield pd.DataFrame({"y": y[of[use]] if len(of) else np.zeros(0, bool), "x": pd.Series([r.tobytes() for r in x[use].astype(np.float32)], dtype=object)})

    rows = sample.select("text", "y").mapInPandas(run, "y boolean, x binary").collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), len(landmarks))
    return x, np.array([r["y"] for r in rows], bool)


def _near_misses(sample: DataFrame, machine: Machine) -> list[str]:
    """Words of clean documents that look most toxic, most common first among equals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = remembered(machine.landmarks)
        for pdf in batches:
            found: Counter[str] = Counter()
            value: dict[str, float] = {}
            for t in pdf["text"]:
                own = set(prepared(t).split())
                features.learn({x.strip(TRIM) for x in own})
                for x in own:
                    row = features.known[x.strip(TRIM)]
                    if row < 0:
                        continue
                    m = float(features.rows[row] @ machine.weights + machine.bias)
                    if m > -0.5:
                        w = words_of(x)[-1]
                        found[w] += 1
                        value[w] = max(m, value.get(w, m))
            yield pd.DataFrame({"w": pd.Series(list(found), dtype=object), "m": np.array([value[w] for w in found], float), "n": np.array(list(found.values()), np.int64)})

    rows = sample.where("not y").select("text").mapInPandas(run, "w string, m double, n long").groupBy("w").agg(F.max("m").alias("m"), F.sum("n").alias("n"))
    worst = rows.where("n > 1").orderBy(F.desc((F.col("m") + 1) * F.sqrt("n")), "w").limit(COUNTER).collect()
    return [r["w"][:WIDTH] for r in worst]


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_train: int = MAX_TRAIN) -> Machine:
    """Fits on docs (key, text) whose labels (key, label) are 0 or 1. Words and n-grams are counted over all of them; the
    machine is fitted on max_train documents of each label or hardly more, by the order of the key's CRC-32, and on
    EACH toxic ones for every telling word. Null labels, keys and texts are left out. Without both labels the machine
    says 0 for all.

    Labels are of documents. A toxic document's sentences count as toxic if they hold a word that tells toxic documents
    from others, so that wrong labels teach little; sentences of other documents count as clean. After a first fit the
    clean words that look most toxic become landmarks as well.
    """
    crc = F.crc32(F.col(key).cast("string"))
    keys = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key), (F.col(label) == 1).alias("y"), crc.alias("o"))
    last = {y: keys.where("y" if y else "not y").select("o").orderBy("o").limit(max_train).agg(F.max("o"), F.count("*")).first() for y in (True, False)}
    nothing = Machine([], np.zeros(0), -1.0, 1.0, 3.0)
    if not last[True][1] or not last[False][1]:
        return nothing
    own = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).cast("string").alias("text"))
    told = keys.select(key, "y").distinct()
    # Few labels go to the texts; with more of them labelled texts are moved once and written.
    few = told.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    labelled = own.join(F.broadcast(told), key) if few else cut(own.join(told, key))
    sizes = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    if not n_bad or not n_good:
        return nothing
    counts = cut(_document_counts(labelled))
    words, held = _telling_words(counts, labelled.where("y"), key, n_bad, n_good)
    grams = _telling(_gram_counts(counts, frozenset(g for w in words for g in grams_of(w))), n_bad, n_good)
    # 2 * max_train keys and EACH for a telling word: broadcast, so that no text but theirs is moved.
    picked = keys.where(F.when(F.col("y"), F.col("o") <= last[True][0]).otherwise(F.col("o") <= last[False][0])).select(key, "y")
    picked = picked.unionByName(_examples(held, key).withColumn("y", F.lit(True))).distinct()
    sample = cut(own.join(F.broadcast(picked), key).select("text", "y").repartition(16, F.xxhash64("text")))
    chosen = pick_landmarks(words, grams)
    if not chosen:
        return nothing
    telling = frozenset(words)
    machine = _fitted(sample, chosen, telling)
    counter = [w for w in _near_misses(sample, machine) if w not in chosen]
    if counter:
        machine = _fitted(sample, chosen + counter, telling)
    margins = score(sample, "text", machine._replace(slope=1.0, shift=0.0)).select("y", F.ln(F.col("score") / (1 - F.col("score"))).alias("m")).toPandas()
    slope, shift = platt(margins["m"].to_numpy(float), margins["y"].to_numpy(bool))
    return machine._replace(slope=slope, shift=shift)


def _fitted(sample: DataFrame, landmarks: list[str], told: frozenset[str]) -> Machine:
    x, y = _sentence_rows(sample, landmarks, told)
    gram = kernels_between(landmarks)
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    z = np.zeros((len(x) + 1, len(landmarks)))
    for at in range(0, len(x), 1024):
        z[at : at + 1024][: len(x) - at] = x[at : at + 1024].astype(float) @ root
    del x
    sign = np.append(np.where(y, 1.0, -1.0), -1.0)
    cost = np.append(np.where(y, 1.0, CLEAN_COST), max(1.0, float(len(y))) / 4)
    w, b = fit_svm(z, sign, cost)
    return Machine(landmarks, root @ w, b, 1.0, 0.0)


def kernels_between(landmarks: list[str]) -> np.ndarray:
    codes = _codes(landmarks, max(map(len, landmarks)))
    i, j = np.indices((len(landmarks),) * 2).reshape(2, -1)
    own = subsequence_kernel(codes, codes)
    return (subsequence_kernel(codes[i], codes[j]) / np.sqrt(own[i] * own[j])).reshape(len(landmarks), -1)


def fit_svm(x: np.ndarray, sign: np.ndarray, cost: np.ndarray, penalty: float = 1e-5, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Weighted squared-hinge linear machine by full-batch accelerated gradient steps."""
    cost = cost / cost.sum()
    parts = (np.hstack([x[at : at + 1024], np.ones((len(x[at : at + 1024]), 1))]) * np.sqrt(cost[at : at + 1024, None]) for at in range(0, len(x), 1024))
    top = np.linalg.eigvalsh(sum(a.T @ a for a in parts))[-1]
    step = 1 / (2 * top + penalty)
    w = v = np.zeros(x.shape[1] + 1)
    for k in range(rounds):
        pull = cost * sign * np.maximum(0, 1 - sign * (x @ v[:-1] + v[-1]))
        grad = -2 * np.append(x.T @ pull, pull.sum()) + penalty * np.append(v[:-1], 0)
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift of the logistic curve that turns margins into chances, by Newton steps on smoothed labels."""
    n1, n0 = y.sum(), (~y).sum()
    aim = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        t = t - np.linalg.solve(h, x.T @ (p - aim) + 1e-3 * (t - [1.0, 0.0]))
    return max(0.1, float(t[0])), float(t[1])


def score_texts(machine: Machine, features: Features, texts: list[str | None]) -> np.ndarray:
    margin = np.full(len(texts), machine.bias)
    if machine.landmarks:
        of, x, _ = features.sentences(texts)
        np.maximum.at(margin, of, x @ machine.weights + machine.bias)
    return 1 / (1 + np.exp(-np.clip(machine.slope * margin + machine.shift if machine.landmarks else np.full(len(texts), -3.0), -30, 30)))


def score(docs: DataFrame, text: str, machine: Machine, to: str = "score", keep_text: bool = False) -> DataFrame:
    """Adds to (double, 0 to 1) to every row, from its whole text alone; leaves text out unless keep_text.

    Null and empty texts get the score of a text without any suspect word. Repeated rows get equal scores; an empty
    table stays empty. A column of docs named like to is replaced.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(to)
    kept = rows if keep_text else rows.drop(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + f", `{to}` double"
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        features = remembered(m.landmarks)
        try:
            for pdf in batches:
                for at in range(0, len(pdf), 500):
                    part = pdf.iloc[at : at + 500]
                    out = part if keep_text else part.drop(columns=text)
                    yield out.assign(**{to: score_texts(m, features, part[text].tolist())})
        finally:  # tasks take turns with all workers that an executor ever started: those at rest are to hold nothing
            del features
            forget()

    return rows.mapInPandas(run, schema)
