"""Hard negatives of anchors by an STR-packed R-tree over quantised vectors.

A score is the integer inner product of two vectors of ``floor(scale * x)``.  An anchor's positives are its
``POSITIVES`` best other rows of the same label; of each positive with score p its ``NEGATIVES`` best rows of
another label with p * ``least`` / 100 <= score <= p are returned.  Better is a higher score, then a smaller vec_id.

Packing is sort-tile-recursive: rows are cut into slabs of equal number along one coordinate, every slab along
the next, and so on.  The upper levels are cut on a bounded sample of rows and deal all rows to tiles; a tile of
more rows than a cell holds (a hot vector, say) is dealt to several cells by row number.  In a cell its own rows
are packed exactly, down to leaves.  Every node has a minimum bounding box, and a query vector and a box
give an interval of inner products, coordinate by coordinate.

1. Every anchor's first cell gives a bound that its kth positive cannot fall below.
2. Anchors go to the tiles whose interval reaches that bound, in blocks; a best-first queue takes the boxes of a cell
   by upper end and leaves out those strictly below the kth score so far, or equal to it with larger ids only.
3. The same search, with each anchor's distinct positive scores as score windows, gives the negatives: boxes whose
   interval lies outside all windows are left out.

All rows are indexed and results are exact.  Nothing grows with the data on the driver but the boxes of at most
``MOST_TILES`` tiles, ``BOX_BYTES`` in all.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.  Shorter vectors count as
continued by zeros.  Components are held within the largest size whose inner products fit a long (2 ** 28 for 64 of
them).  Repeated rows are rows of their own, as anchors, positives and negatives.  Anchors without
positives or negatives give no rows, nor does an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import pin, shuffle_partitions, unpin

POSITIVES = NEGATIVES = 5
#: Rows that the upper levels are cut on, about; twice as many at most.
SAMPLE = 20_000
MOST_TILES, BOX_BYTES = 4096, 32 << 20
#: Rows of a cell and anchors of a block; rows of a leaf, boxes of a node, windows that share a queue, coordinates packed by.
CELL_LEAST, CELL_MOST, BLOCK = 1024, 32_768, 8192
LEAF, FANOUT, SHARED, COORDINATES = 64, 8, 128, 4
NONE, ANY = -(2**63), 2**63 - 1


def limit(dim: int) -> int:
    """The largest component whose inner products of ``dim`` terms fit a long."""
    return min(2**31 - 1, math.isqrt(2**62 // max(1, dim)))


def _widest(x: np.ndarray) -> list[int]:
    return np.argsort(-x.var(axis=0), kind="stable")[:COORDINATES].tolist() if len(x) and x.shape[1] else []


def slabs(x: np.ndarray, tiles: int, coordinates: list[int]) -> tuple:
    """(coordinate, cuts, children): nested slabs of the sample x, as many leaves as tiles or some more."""
    if tiles <= 1 or not coordinates or not len(x):
        return ()
    c, *rest = coordinates
    n = max(1, math.ceil(tiles ** (1 / len(coordinates)) - 1e-9))
    order = np.sort(x[:, c], kind="stable")
    cuts = np.unique(order[[len(order) * k // n for k in range(1, n)]])
    part = np.searchsorted(cuts, x[:, c], "right")
    return c, cuts, [slabs(x[part == k], math.ceil(tiles / n), rest) for k in range(len(cuts) + 1)]


def tile_of(x: np.ndarray, node: tuple) -> np.ndarray:
    """The tile (0, 1, ...) of every row."""

    def place(rows: np.ndarray, node: tuple, first: int) -> int:
        if not node:
            out[rows] = first
            return first + 1
        c, cuts, children = node
        part = np.searchsorted(cuts, x[rows, c], "right")
        for k, child in enumerate(children):
            first = place(rows[part == k], child, first)
        return first

    out = np.zeros(len(x), np.int64)
    place(np.arange(len(x)), node, 0)
    return out


def _packed(x: np.ndarray, rows: np.ndarray, coordinates: list[int]) -> list[np.ndarray]:
    """Leaves of at most LEAF rows, by sort-tile-recursive packing."""
    if len(rows) <= LEAF or not coordinates:
        return [rows[k : k + LEAF] for k in range(0, len(rows), LEAF)]
    c, *rest = coordinates
    pages = math.ceil(len(rows) / LEAF)
    n = math.ceil(pages ** (1 / len(coordinates)) - 1e-9)
    size = math.ceil(pages / n) * LEAF
    rows = rows[np.argsort(x[rows, c], kind="stable")]
    return [leaf for k in range(0, len(rows), size) for leaf in _packed(x, rows[k : k + size], rest)]


class Tree:
    """The R-tree of one cell: levels of boxes (least, most, smallest id), leaves first."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.rows = [leaf[np.argsort(ids[leaf], kind="stable")] for leaf in _packed(x, np.arange(len(x)), _widest(x))]
        low, high, first = (np.array([f(leaf) for leaf in self.rows]) for f in (lambda r: x[r].min(0), lambda r: x[r].max(0), lambda r: ids[r].min()))
        self.levels = [(low, high, first)]
        while len(first) > 1:
            at = np.arange(0, len(first), FANOUT)
            low, high, first = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at)
            self.levels.append((low, high, first))


def interval(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of each query (rows of q) with any point of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return (up @ low.T + down @ high.T).astype(np.int64), (up @ high.T + down @ low.T).astype(np.int64)


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, q: np.ndarray, q_label: np.ndarray, q_row: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best rows (NONE: fewer) of the same or of another label, itself left out,
    with scores from low to high, by best-first traversal."""
    score, found = np.full((len(q), k), NONE), np.full((len(q), k), ANY)
    if not len(x) or not len(q):
        return score, found
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    kind = np.float64 if largest < 2**52 else np.int64  # exact sums either way
    x, q = x.astype(kind), q.astype(kind)
    tree = Tree(x, ids)
    near = np.lexsort(tuple(q[:, c] for c in reversed(_widest(q))) or (q_row,))
    for at in range(0, len(q), SHARED):
        some = near[at : at + SHARED]
        score[some], found[some] = _best_first(tree, x, ids, labels, rows, q[some], q_label[some], q_row[some], low[some], high[some], same, k)
    return score, found


def _best_first(tree: Tree, x, ids, labels, rows, q, q_label, q_row, low, high, same, k):  # noqa: ANN001, ANN202
    score, found = np.full((len(q), k), NONE), np.full((len(q), k), ANY)
    kth, kth_id = low.copy(), np.full(len(q), ANY)

    def open_for(least: np.ndarray, most: np.ndarray, first: int) -> np.ndarray:
        return (least <= high) & ((most > kth) | ((most == kth) & (first <= kth_id)))

    def offer(level: int, nodes: range) -> None:
        lows, highs, firsts = (b[nodes.start : nodes.stop] for b in tree.levels[level])
        least, most = interval(q, lows, highs)
        for j, node in enumerate(nodes):
            for_ = open_for(least[:, j], most[:, j], firsts[j])
            if for_.any():
                heapq.heappush(queue, (-int(most[for_, j].max()), level, node, least[:, j], most[:, j]))

    queue: list = []
    offer(len(tree.levels) - 1, range(len(tree.levels[-1][2])))
    while queue:
        _, level, node, least, most = heapq.heappop(queue)
        who = np.flatnonzero(open_for(least, most, tree.levels[level][2][node]))
        if not len(who):
            continue
        if level:
            offer(level - 1, range(node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1][2]))))
            continue
        leaf = tree.rows[node]
        s = (q[who] @ x[leaf].T).astype(np.int64)
        right = (s >= kth[who, None]) & (s <= high[who, None]) & ((labels[leaf] == q_label[who, None]) == same) & (rows[leaf] != q_row[who, None])
        hit = right.any(axis=1)
        who, s, right = who[hit], s[hit], right[hit]
        s = np.concatenate((score[who], np.where(right, s, NONE)), axis=1)
        own = np.concatenate((found[who], np.where(right, ids[leaf], ANY)), axis=1)
        order = np.lexsort((own, ~s), axis=-1)[:, :k]  # ~s falls as s rises
        score[who], found[who] = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
        full = score[who, -1] > NONE
        kth[who[full]], kth_id[who[full]] = score[who[full], -1], found[who[full], -1]
    return score, found


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)


def _valid(vectors: DataFrame, anchor: Column) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where("vec_id is not null and label is not null and x is not null").where(~bad)


def _tiled(rows: DataFrame, dim: int, scale: float, node: tuple) -> DataFrame:
    """row (a number of its own), vec_id, label, anchor, v (32-bit components) and tile."""
    most = limit(dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column("x")], np.int64) if len(b) else np.empty(0, np.int64)
            x = np.zeros((len(b), dim))
            x[np.arange(dim) < size[:, None]] = b.column("x").flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(scale * x), -most, most).astype(np.int64)
            v = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "anchor")), v, pa.array(tile_of(x, node))], ["vec_id", "label", "anchor", "v", "tile"])

    return rows.mapInArrow(place, "vec_id long, label long, anchor boolean, v binary, tile long").withColumn("row", F.monotonically_increasing_id())


def _boxes(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tile, rows, least and most component of every tile; boxes are merged inside tasks before they are dealt by tile."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            x, tile = _matrix(b.column("v"), dim), b.column("tile").to_numpy()
            for t in np.unique(tile).tolist():
                some = x[tile == t]
                n, low, high = held.get(t, (0, some[0], some[0]))
                held[t] = [n + len(some), np.minimum(low, some.min(0)), np.maximum(high, some.max(0))]
        yield _boxed(held)

    def merge(table: pa.Table) -> pa.Table:
        low, high = _matrix(table.column("low"), dim).min(0), _matrix(table.column("high"), dim).max(0)
        return pa.Table.from_batches([_boxed({table.column("tile")[0].as_py(): [sum(table.column("n").to_pylist()), low, high]})])

    kind = "tile long, n long, low binary, high binary"
    found = rows.select("tile", "v").mapInArrow(own, kind).groupBy("tile").applyInArrow(merge, kind).orderBy("tile").toArrow()
    return found.column("tile").to_numpy(), found.column("n").to_numpy(), _matrix(found.column("low"), dim), _matrix(found.column("high"), dim)


def _boxed(held: dict[int, list]) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.int64()), pa.array([x[0] for x in held.values()], pa.int64()), *(pa.array([x[k].astype("<i4").tobytes() for x in held.values()], pa.binary()) for k in (1, 2))]
    return pa.RecordBatch.from_arrays(columns, ["tile", "n", "low", "high"])


def _best(rows: DataFrame, queries: DataFrame, boxes: tuple, dim: int, blocks: int, same: bool, k: int, home: bool = False) -> DataFrame:
    """row, high, vec_id, score: the k best rows of each query (row, label, v, tile, low, high: arrays) and window.

    ``rows`` have their cell (tile, chunk).  With ``home`` a query goes to the first cell of its own tile alone.
    """
    tiles, chunks, lows, highs = boxes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = ([x.values.to_numpy()[i:j] for x in (b.column(c),) for i, j in zip(x.offsets.to_numpy(), x.offsets.to_numpy()[1:])] for c in ("low", "high"))
            least, most = interval(_matrix(b.column("v"), dim), lows, highs)
            who, cell = [], []
            for i in range(len(b)):
                meets = ((most[i][:, None] >= low[i]) & (least[i][:, None] <= high[i])).any(axis=1)
                for t in np.flatnonzero(meets).tolist():
                    who += [i] * int(chunks[t])
                    cell += [(int(tiles[t]), c) for c in range(int(chunks[t]))]
            out = b.take(pa.array(who, pa.int64())).to_struct_array().flatten()
            yield pa.RecordBatch.from_arrays([*out[:5], pa.array([c[0] for c in cell], pa.int64()), pa.array([c[1] for c in cell], pa.int64())], ["row", "label", "v", "low", "high", "tile", "chunk"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high = (right.column(c).combine_chunks() for c in ("q_low", "q_high"))
        many = np.diff(low.offsets.to_numpy()) if len(low) else np.empty(0, np.int64)
        each = np.repeat(np.arange(len(right)), many)
        low, high = (x.flatten().to_numpy() for x in (low, high))
        mine = lambda table, c: table.column(c).to_numpy()
        score, ids = search(_matrix(left.column("v"), dim), mine(left, "vec_id"), mine(left, "label"), mine(left, "row"), _matrix(right.column("q_v"), dim)[each], mine(right, "q_label")[each], mine(right, "q_row")[each], low, high, same, k)
        i, j = np.nonzero(score > NONE)
        return pa.table({"row": mine(right, "q_row")[each[i]], "high": high[i], "vec_id": ids[i, j], "score": score[i, j]})

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    queries = queries.select("row", "label", "v", "low", "high", "tile")
    if home:
        sent = queries.withColumn("chunk", F.lit(0).cast("long"))
    else:
        sent = queries.drop("tile").mapInArrow(deal, "row long, label long, v binary, low array<long>, high array<long>, tile long, chunk long")
    sent = sent.withColumn("block", block).select(*(F.col(c).alias(f"q_{c}") for c in ("row", "label", "v", "low", "high", "tile", "chunk", "block")))
    if home:
        rows = rows.where("chunk = 0")
    stored = rows.select("row", "vec_id", "label", "v", "tile", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    cell = ("tile", "chunk", "block")
    found = stored.groupBy(*cell).cogroup(sent.groupBy(*(f"q_{c}" for c in cell))).applyInArrow(meet, "row long, high long, vec_id long, score long")
    order = Window.partitionBy("row", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, scale: float = 256.0, least: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, for the rows where ``anchor`` holds."""
    spark = vectors.sparkSession
    valid = _valid(vectors, anchor)
    n, asked, dim = valid.agg(F.count("*"), F.sum(F.col("anchor").cast("long")), F.max(F.size("x"))).first()
    dim = max(1, dim or 0)
    n, asked = n or 0, asked or 0
    cell = min(CELL_MOST, max(CELL_LEAST, -(-n // (2 * shuffle_partitions(spark)))))
    tiles = max(1, min(MOST_TILES, BOX_BYTES // (16 * dim), -(-n // cell)))
    node: tuple = ()
    if tiles > 1:
        hashed = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 40))
        sample = valid.where(hashed < int(min(1.0, SAMPLE / n) * (1 << 40))).select("x").limit(2 * SAMPLE).toArrow().column("x").to_pylist()
        x = np.zeros((len(sample), dim))
        for k, r in enumerate(sample):
            x[k, : len(r)] = r
        x = np.clip(np.floor(scale * x), -limit(dim), limit(dim)).astype(np.int64)
        node = slabs(x, tiles, _widest(x))
    placed = pin(_tiled(valid, dim, scale, node))
    tile, size, lows, highs = _boxes(placed, dim)
    chunks = -(-size // cell)
    boxes = tile, chunks, lows, highs
    listed = F.broadcast(spark.createDataFrame(pa.table({"tile": tile, "chunks": chunks})))  # at most MOST_TILES rows
    rows = placed.join(listed, "tile").withColumn("chunk", F.pmod("row", "chunks"))
    blocks = max(1, -(-asked // BLOCK))
    anchors = placed.where("anchor").select("row", "vec_id", "label", "v", "tile")
    all_, none = F.array(F.lit(ANY)).alias("high"), F.lit(NONE)
    first = _best(rows, anchors.select("*", F.array(none).alias("low"), all_), boxes, dim, blocks, True, POSITIVES, home=True)
    bound = first.groupBy("row").agg(F.when(F.count("*") == POSITIVES, F.min("score")).otherwise(none).alias("bound"))
    asking = anchors.join(bound, "row", "left").select("*", F.array(F.coalesce("bound", none)).alias("low"), all_)
    positives = pin(_best(rows, asking, boxes, dim, blocks, True, POSITIVES).select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("positive_score")).alias("high"))  # POSITIVES of them at most
    windows = windows.withColumn("low", F.transform("high", lambda p: F.ceil(p.cast("decimal(38,0)") * least / 100).cast("long")))
    negatives = _best(rows, anchors.join(windows, "row"), boxes, dim, blocks, False, NEGATIVES)
    negatives = negatives.select("row", F.col("high").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = positives.join(negatives, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    out = pin(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    unpin(placed, positives)
    return out


#: The same rows in DuckDB for anchors divisible by 100 and labels moved where vec_id is divisible by 7.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.r AS r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT r, anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.r, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.positive_score ORDER BY s.score DESC, s.other_id) AS rank
  FROM (SELECT DISTINCT r, positive_score FROM p) p JOIN s ON s.r = p.r AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM p JOIN n USING (r, positive_score) WHERE rank <= 5
"""
