"""Periodic runs of words by online dyadic square catching.

A run is a longest possible stretch of words with smallest period q (words q apart are equal) that holds at
least one square, two equal neighbouring halves of q words.  Words are appended to ``Catchers`` in slabs of any size.
Every completed block of m = 2 ** k words at a multiple of m becomes a catcher for squares of period 2m - 1 to
4m - 2: the first half of such a square always holds one of these blocks whole, and its second half repeats
the block q words later.  So each window of m words that a slab completes is held against the two catchers that
lie at such a distance before it; where one is hit, suffix comparisons go back from the block
and forth to the newest word.  Stretches that reach the newest word stay open and advance with the next slab;
a stretch of 2q words reports a square, and squares of one period that overlap merge into one run.

Windows are compared by hashes of hashes (64 bits, multiplied and shifted at every level); every run is then
held word by word against itself, and what a collision may have joined is cut again, so runs are exact.  Windows
inside a known run of period m or less repeat that run and are left out, which bounds the work by
n log n for n words, also of texts that are one word repeated.  A text takes some 8 * log2(n) bytes a word while it is read.

Rows map one to one, repeated ones and null doc_ids too.  Null, empty and blank texts have no words and no
runs; an empty table gives no rows; of other columns only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run, at least.
LEAST = 12
#: Words appended at once, and bytes of text split at once.
SLAB, BYTES = 1 << 18, 8 << 20

#: (doc_id, number of words) -> the word that stands at each place, as numbers of the text's own words; None: as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Column:
    """A growing array."""

    def __init__(self, kind: type):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            grown = np.empty(2 * (self.n + len(more)), self.held.dtype)
            grown[: self.n] = self.held[: self.n]
            self.held = grown
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Catchers:
    """Squares in a stream of numbered words.  Several texts may be one stream, parted by numbers that occur once."""

    def __init__(self, longest: int | None = None):
        """``longest``: words of the longest text in the stream, which bounds the periods; else all words so far."""
        self.longest, self.words = longest, _Column(np.int64)
        self.hashes: list[_Column] = []
        self.seen: list[int] = []  # windows of each level that have met the catchers
        self.start = self.end = self.period = np.empty(0, np.int64)  # squares, merged; the open ones end at the newest word
        self.waiting = (self.start,) * 3  # open stretches that hold no square yet

    def append(self, words: np.ndarray) -> None:
        old = self.words.n
        self.words.add(words)
        n = self.words.n
        m = 1
        while 4 * m - 2 <= (n if self.longest is None else min(n, self.longest)):
            k = m.bit_length() - 1
            if k == len(self.hashes):
                self.hashes.append(_Column(np.uint64))
                self.seen.append(0)
            own = self.hashes[k]
            if k == 0:
                own.add(_mix(self.words.values[own.n :].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            elif n - m + 1 > own.n:
                below, half = self.hashes[k - 1].values, m // 2
                a, b = below[own.n : n - m + 1], below[own.n + half : n - half + 1]
                own.add(_mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)))
            m *= 2
        self._advance(old)
        for k in range(len(self.hashes)):
            self._catch(k)

    def runs(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and smallest period of all runs of at least ``least`` words, by start and period."""
        for step in (None, self._verified):  # no comparison for what is too short anyway
            start, end, period = step(start, end, period) if step else (self.start, self.end, self.period)
            keep = end - start >= least
            start, end, period = start[keep], end[keep], period[keep]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)  # a stretch that has a smaller period has it over its whole length
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def _common(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a on equal those from b on (those before a and b, if ``back``); a < b."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.hashes) - 1, -1, -1):
            m, h = 1 << k, self.hashes[k].values
            live = np.arange(len(a))
            while len(live):
                x, y = (a[live] - got[live] - m, b[live] - got[live] - m) if back else (a[live] + got[live], b[live] + got[live])
                live = live[(x >= 0) & (y < len(h))]
                x, y = (a[live] - got[live] - m, b[live] - got[live] - m) if back else (a[live] + got[live], b[live] + got[live])
                live = live[h[x] == h[y]]
                got[live] += m
        return got

    def _catch(self, k: int) -> None:
        """Hold the new windows of level k against their catchers."""
        m, h = 1 << k, self.hashes[k].values
        least = 2 * m - 1
        blocks = h[::m]
        first, upto = max(0, self.seen[k] - least), len(h) - least  # places where a catcher could start last
        self.seen[k] = len(h)
        found = [(np.empty(0, np.int64),) * 2]
        for away in (0, 1):
            low = max(first, away * m)
            if low >= upto:
                continue
            against = np.repeat(blocks[low // m - away : (upto - 1) // m - away + 1], m)[low % m :][: upto - low]
            at = low + np.flatnonzero(h[low + least : upto + least] == against)
            found.append(((at // m - away) * m, at + least))
        b, p = (np.concatenate(x) for x in zip(*found, strict=True))
        known = self.period <= m
        if len(b) and known.any():
            order = np.argsort(self.start[known], kind="stable")
            start, upto = self.start[known][order], np.maximum.accumulate(self.end[known][order])
            at = np.searchsorted(start, b, "right") - 1
            fresh = (at < 0) | (upto[at] < p + m)
            b, p = b[fresh], p[fresh]
        if not len(b):
            return
        q = p - b
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        head = np.ones(len(b), bool)  # neighbouring blocks hit at one distance are one stretch
        head[1:] = (q[1:] != q[:-1]) | (b[1:] != b[:-1] + m)
        tail = np.append(head[1:], True)
        first, last, q = b[head], b[tail] + m, q[head]
        self._take(first - self._common(first, first + q, True), last + q + self._common(last, last + q, False), q)

    def _advance(self, old: int) -> None:
        """Let the stretches that reached the newest of ``old`` words take in the words since."""
        opened = self.end == old
        start, end, period = (np.concatenate(x) for x in zip((self.start[opened], self.end[opened], self.period[opened]), self.waiting, strict=True))
        self.start, self.end, self.period = self.start[~opened], self.end[~opened], self.period[~opened]
        self.waiting = (np.empty(0, np.int64),) * 3
        self._take(start, end + self._common(end - period, end, False), period)

    def _take(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Merge stretches into the squares; those without a square wait if they can still grow."""
        square = end - start >= 2 * period
        wait = ~square & (end == self.words.n)
        self.waiting = _merged(*(np.concatenate((x, y[wait])) for x, y in zip(self.waiting, (start, end, period), strict=True)))
        self.start, self.end, self.period = _merged(*(np.concatenate((x, y[square])) for x, y in zip((self.start, self.end, self.period), (start, end, period), strict=True)))

    def _verified(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretches after a comparison of all their words; what a hash collision joined is cut at the differing words."""
        w, n = self.words.values, self.words.n
        out = [[start], [end], [period]]
        good = np.ones(len(start), bool)
        for k in range(len(start)):
            s, e, q = int(start[k]), int(end[k]), int(period[k])
            same = w[s : e - q] == w[s + q : e]
            ends = (s > 0 and w[s - 1] == w[s - 1 + q]) or (e < n and w[e] == w[e - q])
            if not ends and same.all():
                continue
            good[k] = False
            while s > 0 and w[s - 1] == w[s - 1 + q]:
                s -= 1
            while e < n and w[e] == w[e - q]:
                e += 1
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (w[s : e - q] == w[s + q : e]).astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= q:
                    for x, v in zip(out, (s + a, s + b + q, q), strict=True):
                        x.append(np.array([v], np.int64))
        return tuple(np.concatenate([x[0][good], *x[1:]]) for x in out)


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one start and period as one, with the furthest end."""
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    last = np.ones(len(start), bool)
    last[:-1] = (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    return start[last], end[last], period[last]


def text_runs(codes: list[np.ndarray], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the runs of each text; short texts share a stream, in which unique numbers part them."""
    found: list = [None] * len(codes)
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    at = 0
    while at < len(order):
        group, size = [], 0
        while at < len(order) and (not group or size + len(codes[order[at]]) <= SLAB):
            group.append(order[at])
            size += len(codes[order[at]]) + 1
            at += 1
        catchers = Catchers(len(codes[group[-1]]))
        stream = np.concatenate([np.append(codes[i], -1 - k) for k, i in enumerate(group)])
        for k in range(0, len(stream), SLAB):
            catchers.append(stream[k : k + SLAB])
        start, end, period = catchers.runs(least)
        first = np.cumsum([0, *[len(codes[i]) + 1 for i in group]])
        cut = np.searchsorted(start, first)
        for k, i in enumerate(group):
            a, b = cut[k], cut[k + 1]
            found[i] = (start[a:b] - first[k], end[a:b] - first[k], period[a:b])
    return found


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words, the words by number, and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    offsets = split.offsets.to_numpy()
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, upto[offsets - offsets[0]]


def find(docs: DataFrame, rewrite: Rewrite | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed text of every row.

    The collapsed text keeps of each run its first period: a word goes if any run holds it after the first
    ``period`` words; kept words are joined by one space.  ``rewrite`` puts words of the text in other places before.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in _slices(pc.fill_null(batch.column("text"), "")):
                flat, words, upto = _words(texts)
                codes = [flat[a:b] for a, b in zip(upto, upto[1:])]
                if rewrite:
                    for k, i in enumerate(ids.slice(at, len(texts)).to_pylist()):
                        put = rewrite(i, len(codes[k]))
                        codes[k] = codes[k] if put is None else codes[k][put]
                kept, listed, total = [], [], 0
                for own, (start, end, period) in zip(codes, text_runs(codes, least), strict=True):
                    gone = np.zeros(len(own) + 1, np.int64)
                    np.add.at(gone, start + period, 1)
                    np.add.at(gone, end, -1)
                    kept.append(own[np.cumsum(gone[:-1]) == 0])
                    listed.append(np.column_stack((start, end - start, period)))
                    total += len(start)
                some = np.concatenate([np.empty((0, 3), np.int64), *listed])
                runs = pa.StructArray.from_arrays([pa.array(some[:, c]) for c in range(3)], ["start", "length", "period"])
                upto = lambda parts: pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(upto(kept), words.take(pa.array(np.concatenate(kept)))), " ")
                columns = [ids.slice(at, len(texts)), pa.array([len(x) for x in codes], pa.int64()), pa.ListArray.from_arrays(upto(listed), runs), text]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests, from ``find``'s rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    longest = [(-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")]
    return rows.select("doc_id", "n_runs", *longest, F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
