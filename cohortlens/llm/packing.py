"""Packing documents into token sequences by Karmarkar-Karp multiway differencing.

A document's ids are those of the ``tokenizers`` library without special tokens added, then ``end_id``.
Ids beyond a multiple of ``capacity`` form the document's last piece; each full piece fills a sequence of
its own.  Pieces are dealt round-robin over the shuffle partitions, so no key can gather them, and each
partition's are taken in groups of ``GROUP``, in hash order.  In a group of k windows, every piece starts as a partial partition (its length, then zeros); the two partials of largest spread merge again and again,
the larger parts of one against the smaller of the other, until one is left.  k starts at the fewest
windows that could hold the group, or some hundredths more, and rises while a window exceeds the capacity.
Before it rises further, pieces are cut to at most 512 and then 128 ids (``CUTS``), so that equal lengths that do not
add up to a window are packed as well as mixed ones; a group whose pieces fit whole keeps them whole.

Null text counts as empty: the document is ``end_id`` alone.  Every row is packed, repeated rows and null
doc_ids too; an empty table gives no pieces.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffle_partitions
from .tokens import WordEncoder

CAPACITY = 4096
#: Pieces in a group; what its pieces are cut to when they do not fit whole.
GROUP, CUTS = 512, (512, 128)
#: Cut pieces that are differenced at once.
AT_ONCE = 3072


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each length, by multiway differencing; windows have near-equal sums."""
    n = len(lengths)
    if k == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    def single(i: int) -> None:  # made when first taken up, so that memory follows the partials at work
        sums[i], parts[i] = np.zeros(k, np.int32), np.zeros(k, np.int32)
        sums[i][0], parts[i][0] = lengths[i], i + 1

    sums, parts = {}, {}
    heap = [(-x, i) for i, x in enumerate(lengths.tolist())]
    heapq.heapify(heap)
    merged = []  # (first new part, left parts, right parts)
    made = n + 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        for i in (a, b):
            if i not in sums:
                single(i)
        s = sums[a] + sums.pop(b)[::-1]
        merged.append((made, parts[a], parts.pop(b)[::-1]))
        order = np.argsort(-s, kind="stable")
        sums[a], parts[a] = s[order] - s[order[-1]], (made + order).astype(np.int32)
        made += k
        heapq.heappush(heap, (-int(sums[a][0]), a))
    window = np.zeros(made, np.int64)
    if heap[0][1] not in parts:
        single(heap[0][1])
    window[parts[heap[0][1]]] = np.arange(k)
    for first, left, right in reversed(merged):
        own = window[first : first + k]
        window[left] = own
        window[right] = own
    return window[1 : n + 1]


def _fit(lengths: np.ndarray, k: int, capacity: int) -> np.ndarray | None:
    found = difference(lengths, k)
    return found if len(lengths) == 0 or np.bincount(found, lengths, k).max() <= capacity else None


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows of sums within the capacity; their count rises until that holds.  No length may exceed it."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while (found := _fit(lengths, k, capacity)) is None:
        k += 1
    return found


def cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whose they are, start and length of the pieces when every length is cut at multiples of ``most``."""
    count = -(-lengths // most)
    owner = np.repeat(np.arange(len(lengths)), count)
    start = most * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    return owner, start, np.minimum(most, lengths[owner] - start)


def cut_windows(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start, length and window of the pieces: whole ones if they fit with little padding, else cut ones."""
    least = max(1, -(-int(lengths.sum()) // capacity))
    whole = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), lengths
    for k in sorted({least, least + max(1, least // 64), least + max(1, least // 40)}):
        if (found := _fit(lengths, k, capacity)) is not None:
            return *whole, found
    for most in CUTS:
        owner, start, length = cut(lengths, most)
        windows_, used = [], 0
        for at in range(0, len(length), AT_ONCE):  # differencing costs the pieces times the windows
            part = length[at : at + AT_ONCE]
            least = max(1, -(-int(part.sum()) // capacity))
            found = _fit(part, least + max(1, least // 64), capacity)
            if found is None and most > CUTS[-1]:
                break
            windows_.append(used + (windows(part, capacity) if found is None else found))
            used = int(windows_[-1].max()) + 1
        else:
            break
    return owner, start, length, np.concatenate(windows_)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, little-endian 32-bit): each document cut at multiples of the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            owner, start, length, total, ids = [], [], [], [], []
            for k, found in enumerate(encoder.encode(batch.column("text"))):
                found = np.concatenate((found, end))
                for at in range(0, len(found), capacity):
                    part = found[at : at + capacity]
                    owner.append(k)
                    start.append(at)
                    length.append(len(part))
                    total.append(len(found))
                    ids.append(part.tobytes())
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, ids included, with sequence_id and offset; offsets in a sequence run gapless from 0."""
    rows = pieces(docs, tokenizer, end_id, capacity).repartition(shuffle_partitions(docs.sparkSession))
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id", "start"), "doc_id", "start", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def settle(size: int) -> Iterator[pa.RecordBatch]:
            nonlocal used, held
            rows = pa.Table.from_batches(held)
            for at in range(0, size, GROUP):
                group = rows.slice(at, min(GROUP, size - at))
                owner, start, length, window, offset = _placed(group.column("length").to_numpy(), capacity)
                ids = group.column("ids").to_pylist()
                pieces_ = [ids[i][4 * a : 4 * (a + n)] for i, a, n in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)]
                taken = group.select(["doc_id", "start", "doc_tokens"]).take(pa.array(owner)).combine_chunks().to_batches()[0]
                columns = [taken.column(0), pc.add(taken.column(1), pa.array(start)), pa.array(length), taken.column(2), pa.array(pieces_, pa.binary()), pa.array(used + window), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])
                used += int(window.max()) + 1
            held = rows.slice(size).to_batches()

        for batch in batches:
            held.append(batch)
            n = sum(b.num_rows for b in held)
            if n >= GROUP:
                yield from settle(n - n % GROUP)
        n = sum(b.num_rows for b in held)
        if n:
            yield from settle(n)

    return rows.mapInArrow(place, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def _placed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Owner, start, length, window and offset of the pieces of a group; full pieces have windows of their own, after the others."""
    full = np.flatnonzero(lengths == capacity)
    rest = np.flatnonzero(lengths < capacity)
    owner, start, length, window = cut_windows(lengths[rest], capacity)
    some = int(window.max()) + 1 if len(window) else 0
    owner, start = np.concatenate((rest[owner], full)), np.concatenate((start, np.zeros(len(full), np.int64)))
    length, window = np.concatenate((length, lengths[full])), np.concatenate((window, some + np.arange(len(full))))
    order = np.argsort(window, kind="stable")
    begin = np.concatenate(([0], np.cumsum(length[order])[:-1]))
    first = np.concatenate(([True], window[order][1:] != window[order][:-1]))
    offset = np.empty(len(length), np.int64)
    offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0))
    return owner, start, length, window, offset
