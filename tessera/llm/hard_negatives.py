"""Hard-negative mining: a secondary-sort shuffle of packed pair scores, read as a stream per anchor."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

ANCHOR_EVERY = 100
MOVED_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between so many hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Components saturate there, so that a hundred times an inner product fits a long (to 65,536 dimensions).
LIMIT = 1 << 20
#: Rows and anchors in a block: bounds of what a task holds.
ROWS, ANCHORS = 16_384, 1_024
#: Scores looked at in one go.
CELLS = 1 << 21

#: (block, place) of the anchor, descending score, positive or negative, id (null last): sorts as bytes.
_KEY = np.dtype([("block", ">u8"), ("place", ">u4"), ("down", ">u8"), ("kind", "u1"), ("no_id", "u1"), ("id", ">u8")])
_PACKED = struct.Struct(">QIQBBQ")
_SIGN = 1 << 63
_MASK = (1 << 64) - 1

_BLOCK = pa.schema([("ids", pa.binary()), ("no_id", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()),
                    ("vectors", pa.binary())])
BLOCK = "ids binary, no_id binary, labels binary, dims int, vectors binary"


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(ids, whether null, labels, row numbers, quantised components and their places) of the rows that take part."""
    lists = batch.column("vector")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = bad | ~np.isfinite(values)
    keep = (lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False))
    keep[row[bad]] = False
    no_id = batch.column("id").is_null().to_numpy(zero_copy_only=False)
    ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    labels = batch.column("label").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    labels = np.where(~no_id & (ids % MOVED_EVERY == 0), np.fmod(labels + 1, LABELS), labels)
    q = np.clip(np.floor(SCALE * np.where(bad, 0, values)), -LIMIT, LIMIT).astype(np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    dims = int(lengths[keep].max(initial=0))
    matrix = np.zeros((len(lengths), dims), np.int64)
    on = keep[row]
    matrix[row[on], place[on]] = q[on]
    return ids[keep], no_id[keep], labels[keep], matrix[keep]


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows ``(id, label, vector)`` packed into blocks of ``size`` at most, sorted by id inside a block.

    Rows that take no part are left out; labels are moved and components quantised. Shorter
    vectors are padded with zeros.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block(part: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            dims = max(p[3].shape[1] for p in part)
            vectors = np.concatenate([np.pad(p[3], ((0, 0), (0, dims - p[3].shape[1]))) for p in part])
            ids, no_id, labels = (np.concatenate([p[i] for p in part]) for i in range(3))
            order = np.lexsort((ids, no_id))
            data = [[ids[order].tobytes()], [no_id[order].tobytes()], [labels[order].tobytes()], [dims],
                    [vectors[order].astype(np.int32).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            got = _usable(batch)
            for at in range(0, len(got[0]), size):
                held.append(tuple(x[at:at + size] for x in got))
                while sum(len(p[0]) for p in held) >= size:
                    room = size - sum(len(p[0]) for p in held[:-1])
                    last = held.pop()
                    yield block([*held, tuple(x[:room] for x in last)])
                    held = [tuple(x[room:] for x in last)] if len(last[0]) > room else []
        if held:
            yield block(held)

    return df.mapInArrow(pack, BLOCK)


class Block:
    """A block's arrays."""

    def __init__(self, ids, no_id, labels, dims, vectors):
        self.ids, self.no_id = np.frombuffer(ids, np.int64), np.frombuffer(no_id, bool)
        self.labels = np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dims)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``; floating point where that is exact."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    top = lambda x: int(np.abs(x.astype(np.int64)).max(initial=0))
    kind = np.float64 if top(a) * top(b) * dims < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _keys(block: int, place: int, score: np.ndarray, kind: int, rows: Block, at: np.ndarray) -> list[bytes]:
    out = np.zeros(len(at), _KEY)
    out["block"], out["place"], out["kind"] = block, place, kind
    out["down"] = ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN))
    out["no_id"], out["id"] = rows.no_id[at], rows.ids[at].view(np.uint64) ^ np.uint64(_SIGN)
    raw = out.tobytes()
    return [raw[i:i + _KEY.itemsize] for i in range(0, len(raw), _KEY.itemsize)]


def unpack(key: bytes) -> tuple[bytes, int, int, int | None]:
    """(anchor, score, kind, id) of a packed key."""
    _, _, down, kind, no_id, row = _PACKED.unpack(key)
    return key[:12], (~down & _MASK) - _SIGN, kind, None if no_id else row - _SIGN


def _firsts(order: np.ndarray, score: np.ndarray, rows: Block, n: int) -> np.ndarray:
    """The first ``n`` of ``order``, rows of equal score and id once."""
    if len(order) == 0:
        return order
    new = np.ones(len(order), bool)
    same = (score[order][1:] == score[order][:-1]) & (rows.ids[order][1:] == rows.ids[order][:-1])
    new[1:] = ~(same & (rows.no_id[order][1:] == rows.no_id[order][:-1]))
    return order[new][:n]


def _tiles(anchors: Block, rows: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(place of an anchor, its scores with all rows of the block)."""
    step = max(1, CELLS // max(1, len(rows.ids)))
    for at in range(0, len(anchors.ids), step):
        for k, line in enumerate(scores(anchors.vectors[at:at + step], rows.vectors)):
            yield at + k, line


def best_positives(name: int, anchors: Block, rows: Block) -> Iterator[tuple[bytes, int]]:
    """The block's candidates for the first positives of each anchor: a key and the anchor's id."""
    for place, line in _tiles(anchors, rows):
        me = anchors.ids[place]
        at = np.flatnonzero((rows.labels == anchors.labels[place]) & (rows.no_id | (rows.ids != me)))
        at = _firsts(at[np.argsort(-line[at], kind="stable")], line, rows, POSITIVES)
        for key in _keys(name, place, line[at], 0, rows, at):
            yield key, int(me)


def best_negatives(name: int, anchors: Block, rows: Block, positives: dict[int, list[int]]) -> Iterator[tuple[bytes, int]]:
    """The block's candidates for the first negatives in the window of each positive score."""
    for place, line in _tiles(anchors, rows):
        at = np.flatnonzero(rows.labels != anchors.labels[place])
        at = at[np.argsort(-line[at], kind="stable")]
        falling = -line[at]
        found = []
        for p in sorted(set(positives.get(place, ()))):
            first, last = np.searchsorted(falling, -(HIGH * p // 100)), np.searchsorted(falling, (-LOW * p) // 100, "right")
            # Copies of a row are passed over; a second look is needed only where they fill the first.
            take = 2 * NEGATIVES
            while True:
                some = _firsts(at[first:min(last, first + take)], line, rows, NEGATIVES)
                if len(some) == NEGATIVES or first + take >= last:
                    break
                take *= 8
            found.append(some)
        if found:
            every = np.unique(np.concatenate(found))
            for key in _keys(name, place, line[every], 1, rows, every):
                yield key, int(anchors.ids[place])


def _sorted(pairs: RDD, parts: int) -> RDD:
    """Pairs of an anchor together, in the order of their packed keys."""
    return pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:12]))


def first_positives(pairs: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(block, place, score, key, id of the anchor) of the first ``POSITIVES`` keys of each anchor of a sorted stream."""
    anchor, last, n = None, None, 0
    for key, me in pairs:
        if key[:12] != anchor:
            anchor, n = key[:12], 0
        if key != last and n < POSITIVES:
            n += 1
            block, place = struct.unpack(">QI", anchor)
            yield block, place, unpack(key)[1], key, me
        last = key


def windows(pairs: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, int | None, int, int | None, int, int]]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from a sorted stream.

    Scores fall, and positives come before negatives of their score. A positive opens a window; a
    negative goes to every open window that it fits and that isn't full. Nothing of an anchor is
    kept but its ``POSITIVES`` windows.
    """
    anchor, last, open_ = None, None, []
    for key, me in pairs:
        name, score, kind, row = unpack(key)
        if name != anchor:
            anchor, open_ = name, []
        if key == last:
            continue
        last = key
        if kind == 0:
            if len(open_) < POSITIVES:
                open_.append([row, score, 0])
            continue
        for w in open_:
            if w[2] < NEGATIVES and LOW * w[1] <= 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield me, w[0], w[2], row, w[1], score


def mine(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives.

    Anchors are the rows whose id is divisible by 100. Anchors and rows are packed into blocks of
    bounded size; every anchor block meets every row block in a task of its own, by an equi-join on
    the row block's number. Two secondary-sort shuffles follow. The first brings each anchor's
    positives in order, and its first five stay. With their scores known, a task knows the windows
    of its anchors, so of a block only the first ten in each window are shuffled with the
    positives; the second shuffle's sorted stream opens the windows and emits the negatives. The
    pruning is exact: what comes after ten of its own block can't be among the first ten of all.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Rows
    with a null id do: they are no anchors, their label doesn't move, and they come last among
    equal scores. Vectors of unequal length count as padded with zeros; components beyond 4,096
    count as 4,096. Repeated rows count once: rows of one id with equal scores are one partner, and
    an anchor's other rows are those of other ids. Anchors with one id but different labels or
    vectors are anchors of their own. An empty table, and a table without anchors, gives an empty
    result. Only the three columns are read, so others may have any name.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vector_col).alias("vector"))
    chosen = rows.where((F.col("id") % ANCHOR_EVERY == 0)).dropDuplicates(["id", "label", "vector"])
    numbered = lambda d: checkpoint(d.select(F.monotonically_increasing_id().alias("block"), "*"))
    anchors, table = numbered(blocks(chosen, ANCHORS)), numbered(blocks(rows, ROWS))
    other = [F.col(c).alias(f"r_{c}") for c in ("ids", "no_id", "labels", "dims", "vectors")]
    side = table.select(F.col("block").alias("lane"), *other)
    # A block's number is (task that wrote it) * 2**33 + its place there, so the row blocks that an
    # anchor block meets come from a list per task.
    lanes = table.select("block", F.shiftright("block", 33).alias("task")).groupBy("task").agg(
        F.collect_list("block").alias("lanes"))
    tasks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, table.rdd.getNumPartitions() - 1)).cast("long")))
    meets = anchors.select("block", tasks.alias("task")).join(lanes, "task").select("block", F.explode("lanes").alias("lane"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pair(r) -> tuple[Block, Block]:
        return (Block(r.ids, r.no_id, r.labels, r.dims, r.vectors),
                Block(r.r_ids, r.r_no_id, r.r_labels, r.r_dims, r.r_vectors))

    def negatives(r) -> Iterator[tuple[bytes, int]]:
        by: dict[int, list[int]] = {}
        for place, score in r.positives:
            by.setdefault(place, []).append(score)
        return best_negatives(r.block, *pair(r), by)

    near = meets.join(anchors, "block").join(side, "lane").rdd.flatMap(lambda r: best_positives(r.block, *pair(r)))
    positives = checkpoint(spark.createDataFrame(
        _sorted(near, parts).mapPartitions(first_positives), "block long, place int, score long, key binary, me long"))
    levels = positives.groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("positives"))
    found = meets.join(anchors.join(levels, "block"), "block").join(side, "lane").rdd.flatMap(negatives)
    opened = positives.select("key", "me").rdd.map(lambda r: (bytes(r.key), r.me))
    mined = _sorted(opened.union(found), parts).mapPartitions(windows)
    return spark.createDataFrame(mined, "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")
