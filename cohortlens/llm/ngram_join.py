"""N-gram Jaccard join by signature trees: which documents link, how many links each has, and their connected components.

Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of at
least ``percent`` / 100, decided in integers.  The work is spread as follows; each step is exact.

1. Every document gets its set as sorted 64-bit hashes, a fingerprint, and a token bitmap.  Equal sets
   become one class, named by the fingerprint, so that rows of one doc_id with different texts stay apart.
2. Nodes of the tree are bounded groups of classes that share a token.  Two linked sets always share one
   among the first ``n - ceil(percent * n / 100) + 1`` of each in any common order of tokens; the order
   used takes rare tokens first, by a count sketch over all documents (a token counts as often as all tokens
   of its slot), which changes the work but never the result.  Tokens with the same classes give one node.
3. In each node a signature tree over (size range, OR of bitmaps) is traversed against itself; pairs of
   tree nodes whose largest possible overlap is too small, or whose members are connected already, are
   pruned.  What survives connects *candidate components*, each a superset of true ones.
4. Each candidate component is traversed again with whole sets at the leaves, and here nothing is skipped
   for being connected: every link between two classes is found, in one group only, so links can be counted
   by adding up.  Components beyond ``NODE`` members are dealt by ranges of set sizes that a link cannot
   jump over, and within a range in hashed chunks; chunks of the same or the next range meet in a group.
   A task counts its links, so k near copies give about k * k / 100 rows rather than k * k / 2.

Nulls and empty texts have an empty set, link with nothing and are their own component.  Rows of a repeated
doc_id are judged by their own texts, each with its own component; a null doc_id is kept with a null component.
Only ``doc_id`` and ``text`` are read, so other columns of any name are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import pin, shuffle_partitions, unpin
from .text import bitmap, fingerprint, shingles

#: Most members of a group that one task traverses at a time; larger ones are dealt as pairs of chunks.
NODE = 256
#: A shared token with more expected classes than this is dealt out by salt and joined without pruning.
HOT = 2048
#: Bounds of the bits of a slot's number in the sketch of token counts, and slots sent at once.
LEAST_SLOTS, MOST_SLOTS, BLOCK = 16, 22, 4096
#: Most rows that are sent to every executor; beyond that a shuffled join is used.
BROADCAST_ROWS = 500_000
LEAF = 8
#: Columns of a 0/1 block, and its products that cost as much as one pair compared by itself.
COLUMNS, PAIR_COST = 4096, 300_000


def _chunk() -> int:
    """Members of a chunk; hashed chunks vary, so two of them stay near a group's size."""
    return max(1, 2 * NODE // 5)


def _token_load(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents hold a token of each slot, over all documents: a count sketch of tokens.

    Every task adds up all its documents and sends its counts in blocks, which are summed as a stream.
    """
    spark = docs.sparkSession
    slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (4 * docs.count()).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(slots, np.int64), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                held.append((s & np.uint64(slots - 1)).astype(np.int64))
                size += len(s)
                if size > slots:
                    total += np.bincount(np.concatenate(held), minlength=slots)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=slots)
        yield from blocks(enumerate(total.reshape(-1, BLOCK))) if total.any() else ()

    def blocks(found: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, n in found:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.astype("<i8").tobytes()], pa.binary())], ["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, np.ndarray]]:
            at, total = None, None
            for batch in batches:
                for k, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    if k != at:
                        if total is not None:
                            yield at, total
                        at, total = k, np.zeros(BLOCK, np.int64)
                    total = total + np.frombuffer(n, "<i8")
            if total is not None:
                yield at, total

        return blocks(each())

    parts = docs.select("text").mapInArrow(count, "block int, n binary")
    summed = parts.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(add, "block int, n binary")
    load = np.zeros((slots // BLOCK, BLOCK), np.int64)
    for r in summed.toLocalIterator():  # at most 2 ** MOST_SLOTS counts
        load[r["block"]] = np.frombuffer(r["n"], "<i8")
    return load.reshape(-1)


def class_of(fp: bytes) -> int:
    """A number for the class of a fingerprint, its first half."""
    return int.from_bytes(fp[:8], "little", signed=True)


def _signatures(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n, class (a number from the fingerprint), tok (prefix in the common order), salts (0: ordinary token), bits."""
    load = _token_load(docs, width)
    usual = float(np.median(load))
    hot = usual + max(HOT, 8 * usual**0.5)  # beyond what the slot's other tokens make likely
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(load, 2**31 - 1).astype(np.int32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                n = len(s)
                head = n - -(-percent * n // 100) + 1 if n else 0
                rank = load[(s & np.uint64(len(load) - 1)).astype(np.int64)]
                pick = np.argsort(rank, kind="stable")[:head]
                expected = rank[pick]
                out[0].append(n)
                out[1].append(class_of(fingerprint(s)))
                out[2].append(s[pick].view(np.int64))
                out[3].append(np.where(expected > hot, (expected - usual) // HOT + 1, 0).astype(np.int32))
                out[4].append(bitmap(s))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n", "class", "tok", "salts", "bits"])

    return pin(docs.mapInArrow(sign, "doc_id long, n long, class long, tok array<long>, salts array<int>, bits binary"))


def _shared_token_groups(reps: DataFrame) -> DataFrame:
    """Groups of classes that share a token: tok, sure (all members are to be connected unseen), ids.

    Rows of a token stream through sorted; a group leaves in pieces of at most NODE, so memory is bounded.
    """
    rows = reps.select("doc_id", F.explode(F.arrays_zip("tok", "salts")).alias("x"))
    rows = rows.select(F.col("x.tok").alias("tok"), F.when(F.col("x.salts") > 0, F.pmod(F.xxhash64("doc_id"), F.col("x.salts")) + 1).otherwise(0).alias("salt"), "doc_id")
    spark = reps.sparkSession
    rows = rows.repartition(shuffle_partitions(spark), "tok", "salt").sortWithinPartitions("tok", "salt", "doc_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple[int, bool, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], ["tok", "sure", "ids"])

        tok = np.empty(0, np.int64)
        salt, ids = tok, tok
        opened: tuple | None = None  # (token, salt, first id) of a run that has left in pieces so far
        for batch in batches:
            tok = np.concatenate((tok, batch.column("tok").to_numpy()))
            salt = np.concatenate((salt, batch.column("salt").to_numpy()))
            ids = np.concatenate((ids, batch.column("doc_id").to_numpy()))
            cut = np.flatnonzero((tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            found, opened = _close(tok[:last], salt[:last], ids[:last], cut[:-1], opened)
            tok, salt, ids = tok[last:], salt[last:], ids[last:]
            while len(tok) > 2 * HOT:  # one long run: its pieces are joined by its first id
                first = opened[2] if opened else ids[0]
                found.append((tok[0], True, np.concatenate(([first], ids[:NODE]))))
                opened = (tok[0], salt[0], first)
                tok, salt, ids = tok[NODE:], salt[NODE:], ids[NODE:]
            if found:
                yield emit(found)
        if len(tok):
            found, _ = _close(tok, salt, ids, np.empty(0, np.int64), opened)
            if found:
                yield emit(found)

    return rows.mapInArrow(runs, "tok long, sure boolean, ids array<long>")


def _close(tok: np.ndarray, salt: np.ndarray, ids: np.ndarray, cut: np.ndarray, opened: tuple | None) -> tuple[list, tuple | None]:
    """The finished runs of sorted rows.  Salted runs and continued ones are sure; single rows of ordinary tokens go."""
    if not len(tok):
        return [], opened
    start = np.concatenate(([0], cut))
    end = np.concatenate((cut, [len(tok)]))
    found = []
    for i in np.flatnonzero((end - start > 1) | (salt[start] > 0) | (start == 0)):
        a, b = int(start[i]), int(end[i])
        run = ids[a:b]
        going = opened is not None and i == 0 and opened[:2] == (tok[a], salt[a])
        if going:
            run = np.concatenate(([opened[2]], run))
        sure = bool(going or salt[a] > 0 or len(run) > HOT)
        if sure:
            for k in range(0, len(run), NODE):
                piece = run[k : k + NODE]
                found.append((tok[a], True, piece if k == 0 else np.concatenate((run[:1], piece))))
        elif 1 < len(run) <= NODE:
            found.append((tok[a], False, run))
        elif len(run) > NODE:
            chunks = [run[k : k + _chunk()] for k in range(0, len(run), _chunk())]
            found += [(tok[a], False, np.concatenate(pair)) for pair in itertools.combinations(chunks, 2)]
    return found, None


class _Tree:
    """A node over members sorted by size: size range, OR-combined bitmap, fewest bits of a member."""

    __slots__ = ("bits", "few", "kids", "largest", "least", "members", "same", "width")

    def __init__(self, members: list[int], sizes: list[int], bits: list[tuple[int, int]]):
        self.members, self.least, self.largest, self.same = members, sizes[members[0]], sizes[members[-1]], len(members) == 1
        self.width = min(bits[m][1] for m in members)
        folded = [_fold(*bits[m], self.width) for m in members]
        self.bits, self.few = 0, min(x.bit_count() for x in folded)
        for x in folded:
            self.bits |= x
        half = len(members) // 2
        self.kids = (_Tree(members[:half], sizes, bits), _Tree(members[half:], sizes, bits)) if len(members) > LEAF else None


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits | bits >> width) & ((1 << width) - 1)
    return bits


def _may_link(a: int, x: tuple[int, int], b: int, y: tuple[int, int], percent: int) -> bool:
    """Whether sets of sizes a and b with these bitmaps can have the overlap that a link needs."""
    width = min(x[1], y[1])
    p, q = _fold(*x, width), _fold(*y, width)
    most = min(a - (p & ~q).bit_count(), b - (q & ~p).bit_count())
    return (100 + percent) * most >= percent * (a + b)


def _prune(x: _Tree, y: _Tree, percent: int) -> bool:
    if 100 * min(x.largest, y.largest) < percent * max(x.least, y.least):
        return True
    width = min(x.width, y.width)
    common = (_fold(x.bits, x.width, width) & _fold(y.bits, y.width, width)).bit_count()
    few_x, few_y = (n.few if n.width == width else 0 for n in (x, y))
    most = min(x.largest - max(0, few_x - common), y.largest - max(0, few_y - common))
    return (100 + percent) * most < percent * (x.least + y.least)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common elements of the sets i[k] and j[k]: pair by pair, or by products of 0/1 columns where pairs are many."""
    left, right = np.unique(i), np.unique(j)
    used = np.unique(np.concatenate((left, right)))
    tok, col, n = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    wide = n > 1
    total = int(wide.sum())
    if len(left) * len(right) * total > PAIR_COST * len(i):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])[wide[col]]
    col = (np.cumsum(wide) - 1)[col[wide[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    at, to = np.searchsorted(used, left), np.searchsorted(used, right)
    both = np.zeros((len(left), len(right)), np.float32)  # exact: a set has far under 2 ** 24 elements
    for k in range(0, total, COLUMNS):
        a, b = np.searchsorted(col, (k, k + COLUMNS))
        block = np.zeros((len(used), min(COLUMNS, total - k)), np.float32)
        block[row[a:b], col[a:b] - k] = 1
        both += block[at] @ block[to].T
    return both[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)


def tree_pairs(sizes: list[int], bits: list[bytes], percent: int, sets: list[np.ndarray], sides: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links (i, j, shingles shared) by dual traversal: between sides 0 and 1, or among members of side 2."""
    own = [(int.from_bytes(x, "little"), 8 * len(x)) for x in bits]
    by_size = sorted(range(len(sizes)), key=lambda k: sizes[k])
    trees = [_Tree(members, sizes, own) for side in (0, 1, 2) if (members := [k for k in by_size if sides[k] == side])]
    stack = [(trees[0], trees[-1])] if len(trees) == 2 or sides[0] == 2 else []
    found_i, found_j, found_both, i, j = [], [], [], [], []

    def settle() -> None:
        a, b = np.array(i, np.int64), np.array(j, np.int64)
        n = np.array(sizes, np.int64)
        both = _shared(sets, a, b) if len(a) else a
        real = (100 + percent) * both >= percent * (n[a] + n[b])
        for kept, x in ((found_i, a), (found_j, b), (found_both, both)):
            kept.append(x[real])
        i.clear()
        j.clear()

    while stack:
        x, y = stack.pop()
        if x is not y and _prune(x, y, percent):
            continue
        if x is y and x.kids:
            stack += [x.kids, (x.kids[1], x.kids[1]), (x.kids[0], x.kids[0])]
        elif x.kids and (not y.kids or len(x.members) >= len(y.members)):
            stack += [(k, y) for k in x.kids]
        elif y.kids:
            stack += [(x, k) for k in y.kids]
        else:
            for a in x.members:
                for b in y.members:
                    if (x is not y or a < b) and _may_link(sizes[a], own[a], sizes[b], own[b], percent):
                        i.append(a)
                        j.append(b)
    settle()
    return tuple(np.concatenate(x) for x in (found_i, found_j, found_both))


def tree_links(ids: list[int], sizes: list[int], bits: list[bytes], percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links (id, root) that connect members exactly as all surviving pairs would, by dual traversal.

    With ``sets``, as all true links would.
    """
    if sets is not None:
        i, j, _ = tree_pairs(sizes, bits, percent, sets, [2] * len(ids))
        return _rooted(ids, i, j)
    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    ids, sizes = [ids[i] for i in order], [sizes[i] for i in order]
    own = [(int.from_bytes(bits[i], "little"), 8 * len(bits[i])) for i in order]
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def united(x: _Tree) -> bool:
        if not x.same:
            x.same = all(united(k) for k in x.kids) and find(x.kids[0].members[0]) == find(x.kids[1].members[0]) if x.kids else len({find(m) for m in x.members}) == 1
        return x.same

    def pair(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a == b or not _may_link(sizes[i], own[i], sizes[j], own[j], percent):
            return
        parent[max(a, b)] = min(a, b)

    if len(ids) == 2:
        pair(0, 1)
    elif ids:
        root = _Tree(list(range(len(ids))), sizes, own)
        stack = [(root, root)]
        while stack:
            x, y = stack.pop()
            if united(x) and united(y) and find(x.members[0]) == find(y.members[0]) or x is not y and _prune(x, y, percent):
                continue
            if x is y and x.kids:
                stack += [x.kids, (x.kids[1], x.kids[1]), (x.kids[0], x.kids[0])]
            elif x.kids and (not y.kids or len(x.members) >= len(y.members)):
                stack += [(k, y) for k in x.kids]
            elif y.kids:
                stack += [(x, k) for k in y.kids]
            else:
                for i in x.members:
                    for j in y.members:
                        if x is not y or i < j:
                            pair(i, j)
    return [(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i]


def _rooted(ids: list[int], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id connected) of every member that the links i, j connect to a smaller one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(ids[a]), find(ids[b])
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent) if find(x) != x]


def _traverse(rows: DataFrame, percent: int, pairs: bool = False) -> DataFrame:
    """Links inside each group g of rows (g, doc_id, n, bits and perhaps side and set), one or two trees a group.

    Without sets: (a, b) that connect candidates.  With sets: every member with links as (a, b, links), b the
    smallest member that they connect it to; or with ``pairs`` every link as (a, b, shared), a < b.
    """
    exact = "set" in rows.columns
    spark = rows.sparkSession
    rows = rows.repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g", "doc_id")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            found = []
            for row in zip(batch["g"], batch["doc_id"], batch["n"], batch["bits"], *([batch["side"], batch["set"]] if exact else []), strict=True):
                if held and held[0][0] != row[0]:
                    found += one(held)
                    held = []
                if not held or held[-1][1] != row[1]:
                    held.append(row)
            yield pd.DataFrame(found, columns=names, dtype="int64")
        yield pd.DataFrame(one(held), columns=names, dtype="int64")

    def one(held: list) -> list[tuple]:
        if len(held) < 2:
            return []
        _, ids, sizes, bits, *more = zip(*held, strict=True)
        if not exact:
            return tree_links(list(ids), list(sizes), list(bits), percent)
        i, j, both = tree_pairs(list(sizes), list(bits), percent, [np.frombuffer(x, np.uint64) for x in more[1]], list(more[0]))
        if pairs:
            return [(min(ids[a], ids[b]), max(ids[a], ids[b]), n) for a, b, n in zip(i.tolist(), j.tolist(), both.tolist(), strict=True)]
        root = dict(_rooted(list(ids), i, j))
        count = np.bincount(np.concatenate((i, j)), minlength=len(ids))
        return [(ids[k], root.get(ids[k], ids[k]), int(count[k])) for k in np.flatnonzero(count)]

    names = ["a", "b", *([("shared" if pairs else "links")] if exact else [])]
    return rows.mapInPandas(links, ", ".join(f"{x} long" for x in names))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, sent to all executors only after its rows were counted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _exact_links(docs: DataFrame, sig: DataFrame, candidates: DataFrame, percent: int, width: int, pairs: bool = False) -> DataFrame:
    """All true links inside candidate components (node, root), each found in one group: see ``_traverse``.

    ``sig`` has a row a class: doc_id is the class's number, rep the doc_id of a row that has the class's text.
    """
    bits = sig.select("doc_id", "n", "bits")
    ratio = max(100 / percent, 1.01) * (1 + 1e-9)  # of the sizes of linked sets, at most

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a row counts for the class that its own text has
            found = [shingles(x, width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(fingerprint(x)) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "set"])

    size = candidates.groupBy("root").agg(F.count("*").alias("all"))
    cells = candidates.join(size, "root").join(sig.select(F.col("doc_id").alias("node"), "n"), "node")
    whole = cells = pin(cells.select(F.col("node").alias("doc_id"), "root", F.when(F.col("all") <= NODE, 0).otherwise(F.floor(F.log("n") / float(np.log(ratio))).cast("int")).alias("range")))
    rows = cells.count()
    chunks = pin(cells.groupBy("root", "range").agg(F.ceil(F.count("*") / _chunk()).alias("chunks")))
    of = lambda by, name: chunks.select("root", (F.col("range") + by).alias("range"), F.col("chunks").alias(name))
    cells = cells.join(of(0, "same"), ["root", "range"]).join(of(-1, "above"), ["root", "range"], "left").join(of(1, "below"), ["root", "range"], "left")
    cells = cells.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("same")))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    group = lambda side, *key: F.struct(F.xxhash64("root", *key).alias("g"), side.cast("int").alias("side"))
    own, at = F.col("own"), F.col("range")
    met = F.concat(
        F.transform(upto("same"), lambda c: group(F.when(c == own, 2).otherwise((c < own).cast("int")), F.lit("same"), at, F.least(c, own), F.greatest(c, own))),
        F.transform(upto("above"), lambda c: group(F.lit(0), F.lit("next"), at, own, c)),
        F.transform(upto("below"), lambda c: group(F.lit(1), F.lit("next"), at - 1, c, own)),
    )
    placed = pin(cells.select("doc_id", F.explode(met).alias("x")).select("doc_id", "x.g", "x.side"))
    named = placed.select("doc_id").distinct().join(sig.select("doc_id", "rep"), "doc_id").select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(_small(named, rows), "doc_id", "left_semi").mapInArrow(tokens, "doc_id long, set binary")
    members = sets.join(_small(placed, placed.count()), "doc_id").join(bits, "doc_id").select("g", "doc_id", "n", "bits", "side", "set")
    found = pin(_traverse(members, percent, pairs))
    unpin(whole, chunks, placed)
    return found


def _candidates(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes of equal sets (class, rep: smallest doc_id), a signature of each class
    (its number as doc_id, and rep), candidate components of classes."""
    sig = _signatures(docs, percent, width)
    classes = pin(sig.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")))
    reps = sig.where("n > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["class", "doc_id"]).dropDuplicates(["class"])
    reps = reps.select(F.col("class").alias("doc_id"), F.col("doc_id").alias("rep"), "n", "tok", "salts", "bits")
    groups = pin(_shared_token_groups(reps.select("doc_id", "tok", "salts")))
    unseen = groups.where("sure")
    heads = unseen.groupBy("tok").agg(F.min(F.element_at("ids", 1)).alias("head"))
    unseen = unseen.join(heads, "tok").select(F.explode("ids").alias("a"), F.element_at("ids", 1).alias("first"), "head")
    unseen = unseen.select("a", F.col("first").alias("b")).unionByName(unseen.select(F.col("first").alias("a"), F.col("head").alias("b")).distinct())
    nodes = groups.where("not sure").select(F.xxhash64("ids").alias("g"), F.xxhash64(F.reverse("ids")).alias("g2"), "ids").dropDuplicates(["g", "g2"])
    members = nodes.select("g", F.explode("ids").alias("doc_id"))
    maybe = _traverse(members.join(reps.select("doc_id", "n", "bits"), "doc_id"), percent)
    found = pin(components(maybe.unionByName(unseen)))
    unpin(groups)
    return sig, classes, reps, found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def link_pairs(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """a, b, shared: every link between two classes of equal sets, named by their smallest doc_ids (a <= b; equal
    where a repeated doc_id has two linked texts).

    k near copies have up to k * (k - 1) / 2 rows here; ``link_components`` counts them without making them.
    """
    docs = _texts(docs)
    _, classes, reps, candidates = _candidates(docs, percent, width)
    links = _exact_links(docs, reps, candidates, percent, width, pairs=True)
    named = lambda c: classes.select(F.col("class").alias(c), F.col("rep").alias(f"{c}_id"))
    return links.join(named("a"), "a").join(named("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "shared")


def link_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included),
    class_id (smallest doc_id with an equal set) and n_links (other classes that this row's class links with).
    """
    docs = _texts(docs)
    sig, classes, reps, candidates = _candidates(docs, percent, width)
    links = _exact_links(docs, reps, candidates, percent, width)
    found = components(links.select("a", "b"))
    found = found.join(classes.withColumnRenamed("class", "node"), "node")
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = found.join(least, "root").select(F.col("node").alias("class"), "component_id")
    counted = links.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("n_links"))
    named = classes.join(found, "class", "left").join(counted, "class", "left")
    named = named.select("class", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id"), "n_links")
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    alone = F.col("component_id").isNull() | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    own = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "n_shingles", own("component_id"), own("class_id"), F.when(alone | F.col("n_links").isNull(), 0).otherwise(F.col("n_links")).alias("n_links"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row of each component, with all its columns: the one of smallest doc_id (null last).

    Rows are linked by a number of their own, so null and repeated doc_ids are judged row by row.
    """
    rows = pin(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    linked = link_components(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), percent, width)
    named = rows.select("row", F.col("doc.doc_id").cast("long").alias("id")).join(linked.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"))
    return rows.join(first.select(F.col("least.row").alias("row")), "row", "left_semi").select("doc.*")
