"""Suffix-array dedup: byte strings of a given length that stand anywhere else are removed, wherever they stand.

Suffixes are sorted in runs, one or a few a task; the runs go front-coded to the tasks of their range and are merged there
by loser trees that know how long a beginning two suffixes share and never compare it again. What stands side by side in
the merged order says which strings stand twice.

Not every suffix is sorted. The first 2/3 of every window of the length have one place of the smallest hash, its anchor;
equal windows have it at the same place. So suffixes are sorted from anchors on (every 64th byte), each with the bytes
before it as far back as a window with that anchor begins, and of those only suffixes whose beginning, up to where the
shortest window ends, stands twice in the corpus by its hash: others cannot have a window that does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, written

#: Filler behind the end of what is known of a suffix; no UTF-8 text has this byte.
FILLER = 0xFF
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """length: bytes of a string that may not stand twice. block_bytes: text in a block, but for texts that are longer.
    chunk: places whose anchors are found at once. run_bytes: suffixes that a task holds before it sorts them as a run.
    part_bytes: suffixes that are merged in one task, about. sample: beginnings from which the ranges of the merge are
    taken, at most about twice as many reach the driver; ranges: number of ranges at most (beyond it a range is dealt
    out further by the hash of the beginnings)."""

    length: int = 200
    block_bytes: int = 4 << 20
    chunk: int = 1 << 20
    run_bytes: int = 48 << 20
    part_bytes: int = 24 << 20
    sample: int = 16384
    ranges: int = 1024

    @property
    def reach(self) -> int:
        """Starts of a window among which its anchor is."""
        return max(1, self.length * 16 // 25)

    @property
    def depth(self) -> int:
        """Bytes from an anchor on that all its windows hold."""
        return self.length - self.reach + 1

    @property
    def width(self) -> int:
        """Bytes of a suffix that is sorted: those from the anchor on, then those before it, backwards."""
        return self.length + self.reach - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def _eights(text: np.ndarray, size: int) -> np.ndarray:
    """The number of the `size` bytes (8 at most) from every place on; text has 8 bytes more than there are places."""
    numbers = np.ndarray(len(text) - 8, "<u8", text, strides=1).copy()
    return numbers & np.uint64((1 << (8 * size)) - 1) if size < 8 else numbers


def anchors_of(text: bytes, lengths: np.ndarray, s: Settings) -> np.ndarray:
    """(anchor, first, last) of every anchor: windows that begin from first to last have it. Windows lie within one of the
    documents that make up the text; a document's windows may be cut between two rows of one anchor."""
    padded = np.frombuffer(text + bytes(8 + s.length), dtype=np.uint8)
    ends = np.cumsum(lengths)
    edge = np.zeros(len(text) + 2, dtype=np.int32)
    long_enough = lengths >= s.length
    np.add.at(edge, (ends - lengths)[long_enough], 1)
    np.add.at(edge, ends[long_enough] - s.length + 1, -1)
    begins = np.cumsum(edge)[: len(text)] > 0
    out = []
    for at in range(0, len(text), s.chunk):
        to = min(len(text), at + s.chunk)
        starts = np.flatnonzero(begins[at:to])
        if not len(starts):
            continue
        key = _mixed(_eights(padded[at : to + s.reach - 1 + 8], min(8, s.depth)) * _MIX[1])
        least = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
        span = 1
        while 2 * span <= s.reach:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < s.reach:
            least = np.minimum(least[: len(least) - (s.reach - span)], least[s.reach - span :])
        anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
        out.append(np.stack([anchor[new] + at, starts[new] + at, starts[last] + at], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def hashes_of(text: bytes, anchors: np.ndarray, s: Settings) -> np.ndarray:
    """A 64-bit hash of the `depth` bytes from each anchor on."""
    padded, size = np.frombuffer(text + bytes(8), dtype=np.uint8), min(8, s.depth)
    total = np.zeros(len(anchors), dtype=np.uint64)
    for step in [*range(0, s.depth - size, size), s.depth - size]:
        at = anchors + step
        number = np.zeros(len(anchors), dtype=np.uint64)
        for k in range(size):
            number |= padded[at + k].astype(np.uint64) << np.uint64(8 * k)
        total = _mixed(total * _MIX[1] + number + np.uint64(1))
    return total


def suffixes_of(text: bytes, rows: np.ndarray, s: Settings) -> np.ndarray:
    """The sorted strings of anchors as rows of bytes: from the anchor to the end of its last window, filled up to the
    length, then the bytes before it back to the start of its first window, filled up."""
    padded = np.frombuffer(bytes(s.reach) + text + bytes(s.length), dtype=np.uint8)
    anchor, first, last = (rows[:, k, None] for k in range(3))
    ahead, back = np.arange(s.length), np.arange(1, s.reach)
    right = np.where(ahead < last + s.length - anchor, padded[anchor + s.reach + ahead], FILLER)
    left = np.where(back <= anchor - first, padded[anchor + s.reach - back], FILLER)
    return np.concatenate([right, left], axis=1).astype(np.uint8)


def _strings(table: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that numpy sorts byte by byte."""
    return np.ascontiguousarray(table).view(f"S{table.shape[1]}").ravel()


def shared_with_next(table: np.ndarray) -> np.ndarray:
    """Bytes at the start that each row of a table, but the first, shares with the row before it."""
    differ = table[1:] != table[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])


_ENTRY = np.dtype([("block", "<i8"), ("anchor", "<i8"), ("low", "<u2"), ("high", "<u2"), ("done", "u1"), ("hot", "u1")])


def front_coded(table: np.ndarray, entries: np.ndarray) -> bytes:
    """A sorted run: of each suffix how many bytes it shares with the one before, and the rest, compressed."""
    shares = np.concatenate([[0], shared_with_next(table)]).astype("<u2")
    rests = table[np.arange(table.shape[1]) >= shares[:, None]].tobytes()
    return len(table).to_bytes(8, "little") + zstandard.ZstdCompressor(3).compress(entries.tobytes() + shares.tobytes() + rests)


def decoded(piece: bytes, width: int) -> tuple[np.ndarray, list[int], list[bytes]]:
    """entries, shares and rests of a front-coded run."""
    n, raw = int.from_bytes(piece[:8], "little"), zstandard.ZstdDecompressor().decompress(piece[8:])
    at = n * _ENTRY.itemsize
    entries, shares = np.frombuffer(raw, _ENTRY, n), np.frombuffer(raw, "<u2", n, at)
    ends = at + 2 * n + np.cumsum(width - shares.astype(np.int64))
    rests, lo = [], at + 2 * n
    for hi in ends.tolist():
        rests.append(raw[lo:hi])
        lo = hi
    return entries, shares.tolist(), rests


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, shared, suffix) in order, from front-coded sorted runs (shares, rests), by a loser tree.

    Of the head of each run the tree knows how many bytes it shares with the suffix that came out last. Of two heads the
    one that shares more is the smaller, without a look at their bytes; only if both share as many are they compared, from
    there on, and what they then turn out to share is what the loser keeps. A run's next head comes with the number of
    bytes it shares with the one before it, which has just come out.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [rests[0] if rests else None for _, rests in runs] + [None] * (k - len(runs))
    shares, places = [0] * k, [0] * k
    tree = [0] * k  # losers of the inner nodes; tree[0] is the winner of all

    def lower(a: int, b: int) -> bool:
        """Whether the head of a comes before that of b; the loser's share becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shares[a] != shares[b]:
            return shares[a] > shares[b]
        at = shares[a]
        differ = int.from_bytes(x[at:], "big") ^ int.from_bytes(y[at:], "big")
        both = len(x) - (differ.bit_length() + 7) // 8
        if not differ:
            shares[max(a, b)] = both
            return a < b
        first = x[both] < y[both]
        shares[b if first else a] = both
        return first

    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if lower(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        out = heads[best]
        yield best, shares[best], out
        run_shares, rests = runs[best]
        at = places[best] = places[best] + 1
        if at < len(rests):
            share = shares[best] = run_shares[at]
            heads[best] = out[:share] + rests[at]
        else:
            heads[best] = None
        node = (best + k) // 2
        while node:
            other = tree[node]
            if lower(other, best):
                tree[node], best = best, other
            node //= 2


def doubled(table: np.ndarray, shares: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, s: Settings) -> np.ndarray:
    """Which windows (row, bytes before the anchor) of sorted suffixes stand in another row too; rows that are `sure` stand
    elsewhere too with all their windows. shares: bytes that each row shares with the one before.

    Windows that begin l bytes before an anchor are equal if the suffixes share the `length` - l bytes from the anchor on,
    and so lie in one stretch of the sorted rows, and the l bytes before it, and so lie in one stretch of the rows sorted
    by what is before. So a window is a pair of stretches.
    """
    n = len(table)
    before = table[:, s.length :]
    order = np.argsort(_strings(before), kind="stable") if s.reach > 1 else np.arange(n)
    left = np.concatenate([[0], shared_with_next(before[order])]) if s.reach > 1 else np.zeros(n, dtype=np.int64)
    out = np.zeros((n, s.reach), dtype=bool)
    for back in range(s.reach):
        asked = np.flatnonzero((low <= back) & (back <= high))
        if len(asked) < 1:
            continue
        stretch = np.empty(n, dtype=np.int64)
        stretch[order] = np.cumsum(left < back)
        pair = (np.cumsum(shares < s.length - back) * (n + 1) + stretch)[asked]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out[asked[by], back] = twice
    return out | (sure[:, None] & (low[:, None] <= np.arange(s.reach)) & (np.arange(s.reach) <= high[:, None]))


def spans_of(windows: np.ndarray, anchors: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that stretches of windows cover."""
    edges = np.diff(np.pad(windows, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edges == 1)
    hi = np.nonzero(edges == -1)[1] - 1
    return row, anchors[row] - hi, anchors[row] - lo + s.length


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch as one, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[first], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(reach) - 1]])]


def _covered(block: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list, list]]:
    order = np.argsort(block, kind="stable")
    block, start, end = block[order], start[order], end[order]
    cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
    for lo, hi in zip(cut, cut[1:]):
        if hi > lo:
            yield int(block[lo]), *(x.tolist() for x in united(start[lo:hi], end[lo:hi]))


class _Rows:
    """Rows of the merge: spans that are known, pieces of runs, and windows that more than one task must count."""

    NAMES = ("part", "kind", "block", "starts", "ends", "piece")
    SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("piece", T.BinaryType())])
    KNOWN, PIECE, WINDOW = 0, 1, 2

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, part: int, kind: int, block: int = 0, starts: list | None = None, ends: list | None = None, piece: bytes | None = None) -> None:
        self.rows.append((part, kind, block, starts, ends, piece))

    def batches(self, size: int = 256) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for at in range(0, len(self.rows), size):
            part = self.rows[at : at + size]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*part), kinds)], names=self.NAMES)
        self.rows = []


def blocks_of(docs: DataFrame, id_col: str, text: str, s: Settings) -> DataFrame:
    """(block, ids, lengths, data, anchors, n): texts put together to blocks, compressed, with the anchors of their
    windows. The table is written once, bucketed by block, so that joins on blocks do not move it."""
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()), T.StructField("anchors", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        pack = zstandard.ZstdCompressor(3)

        def block() -> pa.RecordBatch:
            whole, lengths = b"".join(texts), np.array([len(x) for x in texts], dtype=np.int64)
            found = anchors_of(whole, lengths, s)
            slim = np.stack([np.diff(found[:, 0], prepend=0), found[:, 0] - found[:, 1], found[:, 2] - found[:, 1]]).astype("<i4")
            columns = [pa.array([(task << 32) + done], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(ids)), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([pack.compress(whole)], pa.binary()), pa.array([pack.compress(slim.tobytes())], pa.binary()), pa.array([len(found)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for at in range(len(batch)):
                body = batch.column(1)[at].as_buffer().to_pybytes()
                if texts and held + len(body) > s.block_bytes:
                    yield block()
                    ids, texts, held, done = [], [], 0, done + 1
                ids.append(batch.column(0).slice(at, 1))
                texts.append(body)
                held += len(body)
        if texts:
            yield block()

    spark = docs.sparkSession
    path = new_path(spark, "blocks")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept.mapInArrow(run, schema).write.bucketBy(buckets, "block").option("path", path).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def _unpacked(data: pa.BinaryScalar, anchors: pa.BinaryScalar | None = None):
    unpack = zstandard.ZstdDecompressor()
    text = unpack.decompress(data.as_buffer())
    if anchors is None:
        return text
    step, low, wide = np.frombuffer(unpack.decompress(anchors.as_buffer()), "<i4").reshape(3, -1).astype(np.int64)
    anchor = np.cumsum(step)
    return text, np.stack([anchor, anchor - low, anchor - low + wide], axis=1)


def doubtful(blocks: DataFrame, s: Settings) -> tuple[DataFrame, list[bytes], int]:
    """(block, hashes) of the beginnings that stand twice by their hash; a sample of them, in order; and their number."""
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    chosen = min(1.0, s.sample / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                text, anchors = _unpacked(batch.column(1)[at], batch.column(2)[at])
                hashes, first, times = np.unique(hashes_of(text, anchors[:, 0], s), return_index=True, return_counts=True)
                sampled = hashes / 2.0**64 < chosen
                begin = [text[a : a + s.depth] if take else None for a, take in zip(anchors[first, 0].tolist(), sampled.tolist())]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(n, batch.column(0)[at].as_py(), dtype=np.int64)), pa.array(times, pa.int32()), pa.array(begin, pa.binary())], names=["hash", "block", "times", "begin"])

    rows = written(blocks.select("block", "data", "anchors").mapInArrow(run, "hash long, block long, times int, begin binary"), "hashes")
    twice = rows.groupBy("hash").agg(F.sum("times").alias("t")).where("t > 1").select("hash")
    found = written(rows.join(twice, "hash").groupBy("block").agg(F.collect_list("hash").alias("hashes"), F.array_compact(F.collect_list("begin")).alias("begins")), "doubtful")
    sample = sorted(bytes(r["b"]) for r in found.select(F.explode("begins").alias("b")).collect())
    return found.select("block", "hashes"), sample, found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]


def repeated_spans(blocks: DataFrame, s: Settings) -> DataFrame:
    """(block, starts, ends): the bytes of each block that windows cover which stand anywhere else too."""
    found, sample, entries = doubtful(blocks, s)
    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries * s.width // s.part_bytes))
    ranges = max(1, min(parts, s.ranges, len(sample) // 8))
    sub = -(-parts // ranges)
    parts = ranges * sub
    splitters = np.array([sample[k * len(sample) // ranges] for k in range(1, ranges)], dtype=f"S{s.depth}")

    def sort_run(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], run_id: int, rows: _Rows) -> None:
        """Sorts the suffixes of a run, finds what stands twice within it, and cuts the rest into pieces for its parts."""
        table = np.concatenate([x[0] for x in held])
        entries = np.zeros(len(table), dtype=_ENTRY)
        entries["block"] = np.concatenate([np.full(len(x[0]), x[3]) for x in held])
        where, hashes = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        entries["anchor"], entries["low"], entries["high"] = where[:, 0], where[:, 0] - where[:, 2], where[:, 0] - where[:, 1]
        order = np.argsort(_strings(table), kind="stable")
        table, entries, hashes = table[order], entries[order], hashes[order]
        same = shared_with_next(table) == s.width
        again, twice = np.concatenate([[False], same]), np.concatenate([[False], same]) | np.concatenate([same, [False]])
        known = entries[twice]  # alike in all bytes: all their windows stand twice, and one of them stands for the others
        for block, starts, ends in _covered(known["block"], known["anchor"] - known["high"], known["anchor"] - known["low"] + s.length):
            rows.add(block % parts, _Rows.KNOWN, block, starts, ends)
        entries["done"] = twice
        table, entries, hashes = table[~again], entries[~again], hashes[~again]
        begin = _strings(table[:, : s.depth])
        low, part = np.searchsorted(splitters, begin, side="left"), np.searchsorted(splitters, begin, side="right")
        # a beginning that is so frequent that whole ranges hold nothing else is dealt out over them, run by run
        hot = part - low > 1
        part = np.where(hot, low + 1 + run_id % np.maximum(1, part - low - 1), part)
        entries["hot"] = hot
        part = part * sub + (hashes % np.uint64(sub)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = [0, *(np.flatnonzero(np.diff(part[order])) + 1), len(order)]
        for lo, hi in zip(cut, cut[1:]):
            if hi > lo:
                at = order[lo:hi]
                rows.add(int(part[at[0]]), _Rows.PIECE, piece=front_coded(table[at], entries[at]))

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, run_id, rows = [], 0, TaskContext.get().partitionId(), _Rows()
        for batch in batches:
            for at in range(len(batch)):
                text, anchors = _unpacked(batch.column(1)[at], batch.column(2)[at])
                hashes = hashes_of(text, anchors[:, 0], s)
                wanted = np.isin(hashes, batch.column(3)[at].values.to_numpy().view(np.uint64))
                if wanted.any():
                    table = suffixes_of(text, anchors[wanted], s)
                    held.append((table, anchors[wanted], hashes[wanted], batch.column(0)[at].as_py()))
                    size += table.nbytes
                if size > s.run_bytes:
                    sort_run(held, run_id, rows)
                    held, size, run_id = [], 0, run_id + 1
                    yield from rows.batches()
        if held:
            sort_run(held, run_id, rows)
            yield from rows.batches()

    def settle(pieces: list[bytes], part: int, rows: _Rows) -> None:
        """Merges the pieces of a part and finds the windows that stand in more than one suffix."""
        runs = [decoded(piece, s.width) for piece in pieces]
        offset = np.cumsum([0, *(len(x[0]) for x in runs)])
        entries = np.concatenate([x[0] for x in runs])
        place, taken = offset[:-1].tolist(), []
        shares, suffixes = [], []
        for run, share, suffix in merged([x[1:] for x in runs]):
            taken.append(place[run])
            place[run] += 1
            shares.append(share)
            suffixes.append(suffix)
        entries, shares = entries[taken], np.array(shares, dtype=np.int64)
        again = shares == s.width  # alike in all bytes
        group = np.cumsum(~again) - 1
        copies = np.bincount(group)
        sure = (copies[group] > 1) | (entries["done"] == 1)
        known = entries[(copies[group] > 1) & (entries["done"] == 0)]
        # one of those that are alike goes on, and only where another has the same beginning
        first = np.flatnonzero(~again)
        size = np.bincount(stretch := np.cumsum(shares[first] < s.depth) - 1)
        alone = (size[stretch] == 1) & (entries["hot"][first] == 0)
        some_sure = np.bincount(group, weights=sure) > 0
        first, some_sure = first[~alone], some_sure[~alone]
        spans = [(known["block"], known["anchor"] - known["high"], known["anchor"] - known["low"] + s.length)]
        if len(first):
            # the shares of rows that stay with one another: those left out share less than a beginning with them
            table = np.frombuffer(b"".join([suffixes[i] for i in first]), dtype=np.uint8).reshape(len(first), s.width)
            mine = entries[first]
            low, high = mine["low"].astype(np.int64), mine["high"].astype(np.int64)
            windows = doubled(table, shares[first], low, high, some_sure, s)
            asked = np.flatnonzero(~some_sure)
            row, start, end = spans_of(windows[asked], mine["anchor"][asked], s)
            spans.append((mine["block"][asked][row], start, end))
            for i in np.flatnonzero(mine["hot"]).tolist():
                text = table[i].tobytes()
                for back in range(low[i], high[i] + 1):
                    fingerprint = blake2b(text[: s.length - back] + b"|" + text[s.length : s.length + back], digest_size=16).digest()
                    start = int(mine["anchor"][i]) - back
                    rows.add(part, _Rows.WINDOW, int(mine["block"][i]), [] if windows[i, back] else [start], [] if windows[i, back] else [start + s.length], fingerprint)
        for block, starts, ends in _covered(*(np.concatenate(x) for x in zip(*spans))):
            rows.add(part, _Rows.KNOWN, block, starts, ends)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, rows = None, [], _Rows()
        for batch in batches:
            kind = batch.column(1).to_numpy()
            for i in np.flatnonzero(kind == _Rows.PIECE):
                part = batch.column(0)[i].as_py()
                if part != at and pieces:
                    settle(pieces, at, rows)
                    yield from rows.batches()
                    pieces = []
                at = part
                pieces.append(batch.column(5)[i].as_py())
            if len(passed := np.flatnonzero(kind != _Rows.PIECE)):
                yield batch.take(pa.array(passed))
        if pieces:
            settle(pieces, at, rows)
            yield from rows.batches()

    runs = blocks.select("block", "data", "anchors").join(found.hint("shuffle_hash"), "block").select("block", "data", "anchors", "hashes").mapInArrow(make_runs, _Rows.SCHEMA)
    settled = written(runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(merge, _Rows.SCHEMA), "spans")
    # windows of beginnings that were dealt out over several parts; a part has told each of them once at least
    counted = settled.where(F.col("kind") == _Rows.WINDOW).groupBy("piece", "part").agg(F.collect_list(F.struct("block", "starts", "ends")).alias("rows"))
    counted = counted.groupBy("piece").agg(F.count(F.lit(1)).alias("parts"), F.flatten(F.collect_list("rows")).alias("rows")).where("parts > 1")
    late = counted.select(F.explode("rows").alias("r")).select("r.block", "r.starts", "r.ends").where(F.size("starts") > 0)
    return settled.where(F.col("kind") == _Rows.KNOWN).select("block", "starts", "ends").unionByName(late)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings(), outputs: tuple[str, ...] = ("kept", "spans")) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and the columns `outputs` of every row of docs: kept (binary: the bytes that
    stay), spans (array of start and end of the bytes that go) or kept_sha256 (lowercase hex).

    Texts are UTF-8 bytes, null text is empty. A byte goes if a string of `length` bytes that holds it, within its text,
    also begins anywhere else, in the same text (overlapping or not) or another; so no copy stays. Null ids and repeated
    rows are rows like any other; an empty table gives an empty result; other columns are ignored. Equality is that of
    bytes; hashes only choose what is compared (but for beginnings so frequent that they are dealt out over several
    tasks, whose windows are compared by 128-bit fingerprints).

    Blocks of texts are written once. Three joins go over them, by block: none moves the texts. Shuffled are a hash of 64
    bits and the block for every anchor (about one in reach / 2 bytes), and the front-coded suffixes of those that are in
    doubt. Suffixes that are alike are one in a run, so a group of copies of any size is met once a run. To the driver
    come the sampled beginnings and three sums. Memory of a task: a run, a part, or a block and its numbers.
    """
    if s.length < 8:
        raise ValueError("length must be 8 or more")
    blocks = blocks_of(docs, id_col, text, s)
    spans = repeated_spans(blocks, s)
    of_block = written(spans.groupBy("block").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "repeats")
    kinds = {"kept": T.BinaryType(), "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), "kept_sha256": T.StringType()}
    unknown = [x for x in outputs if x not in kinds]
    if unknown:
        raise ValueError(f"no outputs {unknown}; there are {', '.join(kinds)}")
    schema = T.StructType([T.StructField(id_col, blocks.schema["ids"].dataType.elementType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), *(T.StructField(x, kinds[x]) for x in outputs)])
    arrow = {"kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_sha256": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                body = _unpacked(batch.column(2)[at])
                lengths = batch.column(1)[at].values.to_numpy()
                starts, ends = (batch.column(k)[at].values.to_numpy() if batch.column(k)[at].is_valid else np.zeros(0, dtype=np.int64) for k in (3, 4))
                if len(starts):
                    starts, ends = united(starts, ends)
                # spans end at the ends of texts: two that only touch there are two
                limits = np.cumsum(lengths)
                out: dict[str, list] = {x: [] for x in schema.names[1:]}
                lo_of, hi_of = np.searchsorted(ends, limits - lengths, side="right"), np.searchsorted(starts, limits, side="left")
                for size, limit, lo, hi in zip(lengths.tolist(), limits.tolist(), lo_of.tolist(), hi_of.tolist()):
                    begin = limit - size
                    gone = [(max(a, begin), min(b, limit)) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())] if size else []
                    kept, from_ = [], begin
                    for a, b in gone:
                        kept.append(body[from_:a])
                        from_ = b
                    kept.append(body[from_:limit])
                    rest = b"".join(kept)
                    made = {"n_bytes": size, "n_removed": size - len(rest), "n_spans": len(gone), "kept": rest}
                    made["spans"] = [{"start": a - begin, "end": b - begin} for a, b in gone]
                    if "kept_sha256" in out:
                        made["kept_sha256"] = sha256(rest).hexdigest()
                    for x in out:
                        out[x].append(made[x])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at].values, *(pa.array(v, arrow.get(x, pa.int64())) for x, v in out.items())], names=schema.names)

    joined = blocks.select("block", "ids", "lengths", "data").join(of_block.hint("shuffle_hash"), "block", "left")
    return joined.select("ids", "lengths", "data", "starts", "ends").mapInArrow(cut, schema)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs, for strings of 200 bytes."""
    return remove_repeats(docs, outputs=("kept_sha256",))
