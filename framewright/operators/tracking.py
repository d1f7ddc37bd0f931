"""Tracks of objects through long videos, in ranges of frames that are followed side by side.

What a frame does to the frames after it is held in a small state: the objects that may still be continued. Rows are dealt
to ranges of (video, frame), and a range streams through one task, which holds some frames and the state. A range is two
pieces: its head, the first frames of its first video, and the rest. It begins from nothing; where the piece before it
ends in another state, a piece is done again from that one, until all seams agree; so the result is that of one pass over
the whole video. Heads are short and kept, and after them the state is most often the right one, so that heads are all
that is done again.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .ranges import few

#: Frames that a task works on at once, and frames of a head.
PIECE, BEFORE = 1024, 64
#: Pairs of objects that a task compares at once, and bytes of the pixels that it marks at once.
PAIRS, MARKS = 250_000, 16_000_000
#: What a row tells of a piece: one of the head's rows, objects of the state at the beginning and at the end, and the
#: first and the last video with the numbers of tracks that begin in it.
ROW, BEGIN, END, FIRST, LAST = range(5)

#: Overlaps of the objects at some places with those at others.
Overlaps = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _box_overlaps(mine: list[tuple], others: list[tuple]) -> np.ndarray:
    a, b = np.array(mine, float), np.array(others, float)
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    return _overlaps_of_corners(a[i], b[j]).reshape(len(a), len(b))


def _overlaps_of_corners(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    union = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _boxes(shapes: pa.ListArray) -> Overlaps:
    corners = shapes.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)
    return lambda i, j: _overlaps_of_corners(corners[i], corners[j])


def _masks(shapes: pa.ListArray) -> Overlaps:
    """Masks are rows of bits, one for each pixel that any of them has; common pixels are counted some pixels at a time."""
    pixels = shapes.flatten().dictionary_encode()
    n = len(pixels.dictionary)
    of = np.repeat(np.arange(len(shapes)), pc.list_value_length(shapes).to_numpy(zero_copy_only=False).astype(int))
    code = pixels.indices.fill_null(n).to_numpy()
    step = max(64, MARKS // max(1, len(shapes)) // 64 * 64)

    def marked(begin: int) -> np.ndarray:
        mine = slice(None) if n < step else (code >= begin) & (code < begin + step)
        marks = np.zeros((len(shapes), min(step, -(-(n + 1 - begin) // 64) * 64)), bool)
        marks[of[mine], code[mine] - begin] = True
        return np.packbits(marks, axis=1).view(np.uint64)

    begins = range(0, n + 1, step)
    whole = marked(0) if len(begins) == 1 else None
    sizes = sum(np.bitwise_count(whole if whole is not None else marked(b)).sum(1, dtype=np.int64) for b in begins)

    def overlaps(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = np.zeros(len(i), np.int64)
        for b in begins:
            bits = whole if whole is not None else marked(b)
            for word in bits.T:
                both += np.bitwise_count(word[i] & word[j])
        return both / np.maximum(1, sizes[i] + sizes[j] - both)

    return overlaps


def _dumped(state: list[tuple]) -> bytes:
    """Equal states give equal bytes: pickle tells one string that occurs twice from two equal ones."""
    names: dict = {}
    return pickle.dumps([(t, key, names.setdefault(label, label), shape, left) for t, key, label, shape, left in state])


def advance(state: list[tuple], frame: list[tuple], threshold: float, patience: int, overlaps) -> tuple[list[tuple], list[int | None]]:
    """The rule, which _Follower applies to many frames at once: the state after a frame, and for each of its objects the
    place in state of the object that it continues.

    state: (frame, id, label, shape, left) in order; frame: (frame, id, label, shape). In order, each object of the state
    takes the object of its label that it overlaps most, the first of equals, if by more than threshold and if none has
    taken that one; else it stays for the next frame, patience times less one.
    """
    found: list[int | None] = [None] * len(frame)
    missed = []
    most, bests = [0.0] * len(state), [0] * len(state)
    if state and frame:
        kinds = [f[2] for f in frame]
        v = np.where([[s[2] == kind for kind in kinds] for s in state], overlaps([s[3] for s in state], [f[3] for f in frame]), 0.0)
        most, bests = v.max(1).tolist(), v.argmax(1).tolist()
    for i, (t, key, label, shape, left) in enumerate(state):
        if frame and most[i] > threshold and found[bests[i]] is None:
            found[bests[i]] = i
            continue
        if left > 1:
            missed.append((t, key, label, shape, left - 1))
    return [(*f, patience) for f in frame] + missed, found


def _new(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for name in names:
        c = rows[name]
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


class _Follower:
    """Follows the objects of one piece, some whole frames at a time."""

    def __init__(self, piece: int, held: pa.Table, left: np.ndarray, threshold: float, patience: int, prepare: Callable[[pa.ListArray], Overlaps]):
        self.piece, self.threshold, self.patience, self.prepare = piece, threshold, patience, prepare
        # The objects that may be continued, for how many frames, and their tracks: numbers from 0 in a video, or below 0
        # the places of objects that the piece began with.
        self.held, self.left, self.ref = held, left, -1 - np.arange(len(held))
        self.video = held["video"][0] if len(held) else None
        # The first video and frame, and the tracks that begin in that video and in the last one.
        self.first, self.first_begun, self.begun = None, None, 0

    def _edges(self, frame: np.ndarray, labels: np.ndarray, old: int, overlaps: Overlaps) -> tuple[np.ndarray, np.ndarray]:
        """For each object and each frame that may continue it, the object there that it overlaps most, if enough."""
        begin = np.maximum(np.searchsorted(frame, frame, side="right"), old)
        n = np.maximum(np.searchsorted(frame, frame + self.patience, side="right") - begin, 0)
        total, at, found = np.append(0, np.cumsum(n)), 0, []
        while at < len(frame):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(at, to), n[at:to])
            j = np.arange(len(i)) + np.repeat(begin[at:to] - total[at:to] + total[at], n[at:to])
            same = labels[i] == labels[j]
            i, j = i[same], j[same]
            v = overlaps(i, j)
            near = v > self.threshold
            i, j, v = i[near], j[near], v[near]
            if len(i):
                first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (frame[j[1:]] != frame[j[:-1]])))
                group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i))))
                top = np.flatnonzero(v == np.maximum.reduceat(v, first)[group])
                top = top[np.append(True, group[top[1:]] != group[top[:-1]])]
                found.append((i[top], j[top]))
            at = to
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        i, j = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((i, -frame[i], frame[j]))
        return i[order], j[order]

    def feed(self, rows: pa.Table) -> np.ndarray:
        """The tracks of the objects of some whole frames, which follow those before."""
        old, video = len(self.left), _new(rows, ["video"])
        video[0] = self.video is None or rows["video"][0] != self.video
        gap = np.where(video, self.patience + 1, _new(rows, ["video", "t"]).astype(int))
        frame = np.concatenate([self.left - self.patience, np.cumsum(gap)])
        both = pa.concat_tables([self.held, rows]).combine_chunks()
        labels = both["label"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        used, owner = [False] * len(both), list(range(len(both)))
        edges = self._edges(frame, labels, old, self.prepare(both["shape"].combine_chunks()))
        for s, d in zip(*(x.tolist() for x in edges)):
            if not used[s] and owner[d] == d:
                used[s], owner[d] = True, s
        root, own = np.array(owner), np.arange(len(both))
        begins = (root == own)[old:]
        while (root[root] != root).any():
            root = root[root]
        count = np.cumsum(begins)
        starts = np.flatnonzero(video)
        before = np.append(-self.begun, (count - begins)[starts])[np.cumsum(video)]  # tracks of videos before, in these rows
        ref = np.append(self.ref, count - 1 - before)[root]
        for at in starts[(starts > 0) | (self.first is not None)][:1].tolist():
            if self.first_begun is None:
                self.first_begun = int((count - before)[at - 1]) if at else self.begun
        self.first = self.first or (rows["video"][0], rows["t"][0])
        self.last, self.video, self.begun = (rows["video"][-1], rows["t"][-1]), rows["video"][-1], int((count - before)[-1])
        left = self.patience - (frame[-1] - frame)
        stay = np.flatnonzero(~np.array(used) & (left > 0))
        self.held, self.left, self.ref = both.take(stay), left[stay], ref[stay]
        return ref[old:]

    def bounds(self) -> list[tuple]:
        """The first video with its first frame and the last one with its last, and the tracks that begin in them."""
        return [(*self.first, self.begun if self.first_begun is None else self.first_begun), (*self.last, self.begun)] if self.first else []


def _frames(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Some whole frames of one piece, size of them at most, or objects that it begins with."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        rows = [x for x in (rest, pa.Table.from_batches([batch]) if batch is not None else None) if x is not None and len(x)]
        if not rows:
            continue
        rows = pa.concat_tables(rows).combine_chunks()
        seeds = pc.is_valid(rows["left"]).to_numpy(zero_copy_only=False)
        apart = _new(rows, ["piece"])
        apart[1:] |= seeds[1:] != seeds[:-1]
        starts = np.flatnonzero(apart | (_new(rows, ["video", "t"]) & ~seeds))
        end = len(rows) if batch is None else starts[-1]
        cuts = np.union1d(np.append(starts[::size], end), np.flatnonzero(apart))
        cuts = cuts[cuts <= end]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield rows.slice(a, b - a)
        rest = rows.slice(end)


def _follow(batches: Iterator[pa.RecordBatch], head: int | None, piece: int, threshold: float, patience: int, prepare: Callable[[pa.ListArray], Overlaps]) -> Iterator[pa.RecordBatch]:
    """What track writes of its pieces. With head, rows are a range, the first head frames of which are a piece of their own."""
    now: _Follower | None = None

    def told(rows: pa.Table, ref: np.ndarray, kind: int | None, left: np.ndarray | None = None, shapes: bool = True) -> pa.RecordBatch:
        n, one = len(rows), lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        label, shape = rows["label"], rows["shape"]
        if kind is None or not shapes:
            label, shape = pa.nulls(n, label.type), pa.nulls(n, shape.type)
        parts = [pa.array(np.full(n, kind or 0), pa.int32()), pa.array(np.zeros(n) if left is None else left, pa.int32()), one(label), one(shape)]
        held = pa.StructArray.from_arrays(parts, names=["kind", "left", "label", "shape"], mask=pa.array(np.full(n, kind is None)))
        own = [one(rows[c]) for c in ("video", "t", "id")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, now.piece)), *own, pa.array(ref), held], names=["piece", "video", "t", "id", "ref", "held"])

    def done() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        yield told(now.held, now.ref, END, now.left)
        for kind, (video, t, begun) in zip((FIRST, LAST), now.bounds()):
            at = pa.table({"video": pa.array([video.as_py()], video.type), "t": pa.array([t.as_py()], t.type), "id": pa.array([0]), "label": pa.nulls(1, now.held["label"].type), "shape": pa.nulls(1, now.held["shape"].type)})
            yield told(at, np.array([begun]), kind)

    def begin(at: int, held: pa.Table, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal now
        now = _Follower(at, held, left, threshold, patience, prepare)
        yield told(held, now.ref, BEGIN, left, shapes=False)

    for rows in _frames(batches, piece):
        at, seeds, rows = rows["piece"][0].as_py(), rows["left"][0].is_valid, rows.select(["video", "t", "id", "label", "shape", "left"])
        left, rows = rows["left"], rows.drop_columns("left")
        if seeds:
            yield from done()
            yield from begin(at, rows, left.to_numpy())
            continue
        if now is None or now.piece not in (at, at + (head is not None)):
            yield from done()
            yield from begin(at, rows.slice(0, 0), np.zeros(0, int))
            ahead = head
        if head is not None and now.piece == at:
            inside = np.cumsum(_new(rows, ["t"])) <= ahead
            inside &= pc.equal(rows["video"], now.video if now.video is not None else rows["video"][0]).to_numpy(zero_copy_only=False)
            mine, rows = rows.slice(0, inside.sum()), rows.slice(inside.sum())
            if len(mine):
                ref = now.feed(mine)
                yield told(mine, ref, None)
                yield told(mine, ref, ROW)
                ahead -= int(_new(mine, ["t"]).sum())
            if not len(rows):
                continue
            yield from done()
            yield from begin(at + 1, now.held, now.left)
        yield told(rows, now.feed(rows), None)
    yield from done()


def track(df: DataFrame, video: str, t: str, id_: str, label: str, shape: str = "box", threshold: float | None = None, patience: int = 8, piece: int = PIECE, before: int = BEFORE) -> DataFrame:
    """(video, t, id, track): objects of neighbouring frames that overlap are one track, numbered from 0 in each video by
    first frame and id; see advance for the rule.

    shape is a box, whose overlap must exceed 0.6, or an array of a mask's pixels, with 0.5. Frames are the values of t that
    a video has. id is an integer. A task holds piece frames and the objects that may be continued, however long a video
    is; before is the frames of a head.
    """
    masks = df.schema[shape].dataType.simpleString().startswith("array")
    threshold = threshold if threshold is not None else 0.5 if masks else 0.6
    form = F.col(shape) if masks else F.array(*[F.col(f"{shape}.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")])
    order, none = ["video", "t", "id"], F.lit(None).cast("int").alias("left")
    rows = df.select(F.col(video).alias("video"), F.col(t).alias("t"), F.col(id_).cast("bigint").alias("id"), F.col(label).alias("label"), form.alias("shape")).where("video is not null and t is not null")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"piece bigint, video {kind('video')}, t {kind('t')}, id bigint, ref bigint, held struct<kind: int, left: int, label: {kind('label')}, shape: {kind('shape')}>"
    follow = functools.partial(_follow, piece=piece, threshold=threshold, patience=patience, prepare=_masks if masks else _boxes)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "video", "t").sortWithinPartitions(*order)
    placed = ranged.select((F.spark_partition_id() * 2).cast("bigint").alias("piece"), *order, "label", "shape", none)
    # Written, so that all uses below see the same ranges.
    out = materialise(placed.mapInArrow(functools.partial(follow, head=before), schema))
    objects, told = out.where("held is null").drop("held"), out.where("held is not null").select("piece", *order, "ref", "held.*")
    heads, seams = told.where(F.col("kind") == ROW), materialise(told.where(F.col("kind") != ROW))
    while True:
        ahead, of = _ahead(seams), lambda k: seams.where(F.col("kind") == k)
        seeds = of(END).withColumnRenamed("piece", "from").join(ahead, ["from", "video"]).select("piece", *order, "label", "shape", "left")
        state = lambda d, to: d.groupBy("piece", "video").agg(F.sort_array(F.collect_list(F.struct("t", "id", "left"))).alias(to))
        both = ahead.join(state(seeds, "given"), ["piece", "video"], "left").join(state(of(BEGIN), "taken"), ["piece", "video"], "left")
        wrong = materialise(both.where(~F.col("given").eqNullSafe(F.col("taken"))).select("piece"))
        if wrong.isEmpty():
            break
        of_wrong = lambda d: d.join(F.broadcast(wrong), "piece", "left_semi")
        redone = of_wrong(seeds).unionByName(of_wrong(heads).select("piece", *order, "label", "shape", none))
        rest = of_wrong(of(FIRST).where("piece % 2 = 1"))
        if not rest.isEmpty():  # these are read again
            ends = rest.select("piece", F.struct("video", "t").alias("__low")).join(of(LAST).select("piece", F.struct("video", "t").alias("__high")), "piece")
            redone = redone.unionByName(rows.join(F.broadcast(ends), F.struct("video", "t").between(F.col("__low"), F.col("__high"))).select("piece", *order, "label", "shape", none))
        ordered = redone.repartition("piece").sortWithinPartitions("piece", F.col("left").isNull(), *order)
        again = materialise(ordered.mapInArrow(functools.partial(follow, head=None), schema))
        but_wrong = lambda d: d.join(F.broadcast(wrong), "piece", "left_anti")
        objects = but_wrong(objects).unionByName(again.where("held is null").drop("held"))
        seams = materialise(but_wrong(seams).unionByName(again.where("held is not null").select("piece", *order, "ref", "held.*")))
    numbers = _numbers(seams, kind("video"))
    # Below 0 stand tracks of the pieces before, from 0 on those that begin in this one.
    key = F.least("ref", F.lit(0))
    numbered = objects.withColumn("key", key).join(numbers, ["piece", "video", "key"], "left")
    return numbered.select(F.col("video").alias(video), F.col("t").alias(t), "id", (F.greatest("ref", F.lit(0)) + F.coalesce("add", F.lit(0))).alias("track"))


def _ahead(seams: DataFrame) -> DataFrame:
    """(piece, video, from): the pieces whose first video goes on from the piece named."""
    held = seams.where(F.col("kind").isin(FIRST, LAST)).groupBy("piece", "video").agg(F.min("kind").alias("kind"))
    found = held.withColumn("from", F.lag("piece").over(Window.partitionBy("video").orderBy("piece")))
    return found.where((F.col("kind") == FIRST) & F.col("from").isNotNull()).select("piece", "video", "from")


def _numbers(seams: DataFrame, kind: str) -> DataFrame:
    """(piece, video, key, add): what is added to numbers of tracks that begin in the piece (key 0), and the numbers of the
    tracks that it goes on with. The rows of a video are as many as ranges and objects of a state together."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, base, tracks = [], 0, np.zeros(0, np.int64)
        for piece, rows in pdf.groupby("piece"):
            out.append(pd.DataFrame({"piece": piece, "key": -np.arange(len(tracks) + 1), "add": np.append(base, tracks)}))
            ref = rows.loc[rows["kind"] == END].sort_values(["t", "id"])["ref"].to_numpy(np.int64)
            tracks = np.where(ref < 0, np.append(tracks, 0)[np.where(ref < 0, -1 - ref, -1)], ref + base)
            base += int(rows.loc[rows["kind"] != END, "ref"].max())
        return pd.concat(out).assign(video=pdf["video"].iloc[0])

    ends = seams.where(F.col("kind") != BEGIN).select("piece", "video", "t", "id", "ref", "kind")
    return few(ends.groupBy("video").applyInPandas(walk, f"piece bigint, key bigint, add bigint, video {kind}"))
