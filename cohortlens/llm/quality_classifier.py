"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Text view: shares of hashed words, of pairs of character classes, and of repeated words.  Metadata view:
language, source, size and layout (lines and their lengths).  Both are computed once for every row and kept
as a narrow table.  Labelled rows are dealt by class: every fourth of a class, in hash order, is held back for
calibration, the others train.  In each round both views are calibrated on the held-back rows and score all
rows whose doc_id has no label.  A view hands on what it is confident of: calibrated probability at least
``CONFIDENT`` (good) or at most 1 - ``CONFIDENT`` (bad), unless the other view is as confident of the opposite;
of these the ``GIVEN`` most confident of either class, rows of equal content counting once and none twice,
join the other view's training rows with weight ``PSEUDO``.  Rounds end after ``ROUNDS`` or when nothing
qualifies.  The views are then calibrated and combined on the held-back rows.

Bounds, all parameters: at most ``LABELLED`` labelled rows, half of each class (those of smallest hash,
weighted to the classes' shares of all labels), and ROUNDS * 4 * GIVEN pseudo-labels reach the driver;
everything else covers all documents.

Null and empty texts have zero text features; null language or source is a value of its own; labels outside
0 and 1 are ignored; of a doc_id labelled repeatedly, the smallest quality counts.  Rows without a doc_id are
scored but teach nothing.  With fewer than two labelled documents of a class nothing can be learned: scores
are 0.5 and all is kept.  Rows map one to one, repeated ones too; an empty table gives none; only doc_id,
text, lang and source are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import pin, unpin

LABELLED, ROUNDS, GIVEN, KEEP_FROM = 6000, 3, 150, 0.5
CONFIDENT, PSEUDO, FOLDS = 0.95, 0.2, 4
WORD_SLOTS, CLASSES, HASHED = 64, 9, 16
TEXT = WORD_SLOTS + CLASSES * CLASSES + 3
META = 2 * HASHED + 6
_CLASS = np.full(0x110000, 8, np.uint8)  # others
for _k, _chars in enumerate((" \t\v\f\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "!\"'()-", "#*$%&|<>")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0xDF:0x250] = 2


def text_features(text: str) -> np.ndarray:
    out = np.zeros(TEXT, np.float32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return out
    kinds = _CLASS[points].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = max(1, len(words))
    distinct = Counter(words)
    for w, c in distinct.items():
        out[zlib.crc32(w) % WORD_SLOTS] += c
    out[:WORD_SLOTS] = np.sqrt(out[:WORD_SLOTS] / n)
    out[WORD_SLOTS : WORD_SLOTS + CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(points) - 1))
    out[-3:] = len(distinct) / n, min(2.0, len(points) / n / 10), max(distinct.values(), default=0) / n
    return out


def meta_features(lang: str | None, source: str | None, text: str) -> np.ndarray:
    out = np.zeros(META, np.float32)
    out[zlib.crc32(repr(lang).encode()) % HASHED] = 1
    out[HASHED + zlib.crc32(repr(source).encode()) % HASHED] = 1
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    out[2 * HASHED :] = np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, np.log1p(max(sizes)) / 10, np.log1p(sum(sizes) / len(lines)) / 10, len(set(lines)) / len(lines), sizes.count(0) / len(lines)
    return out


def row_key(docs: DataFrame) -> Column:
    """A hash of all that a row's verdict depends on; with the doc_id it names rows of equal verdict."""
    columns = [F.col(c).cast("string") for c in ("text", "lang", "source")]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, key, t and m (float arrays) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            t = [text_features(x) for x in texts]
            m = [meta_features(*x) for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(t, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.float32()))], ["doc_id", "key", "t", "m"])

    return rows.mapInArrow(view, "doc_id long, key long, t array<float>, m array<float>")


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept, not penalised."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _scored(rows: DataFrame, text: np.ndarray, meta: np.ndarray) -> DataFrame:
    """doc_id, key, row, st and sm: both views' log-odds."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [b.column(c).flatten().to_numpy().reshape(len(b), -1) @ w[:-1] + w[-1] if len(b) else np.empty(0) for c, w in (("t", text), ("m", meta))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "row")), *(pa.array(v, pa.float64()) for v in values)], ["doc_id", "key", "row", "st", "sm"])

    return rows.select("doc_id", "key", "row", "t", "m").mapInArrow(score, "doc_id long, key long, row long, st double, sm double")


def _listed(rows: DataFrame, column: str, values: list[int]) -> DataFrame:
    """A broadcast table of a bounded list."""
    return F.broadcast(rows.sparkSession.createDataFrame(pa.table({column: pa.array(values, pa.int64())})))


def _given(rows: DataFrame, scored: DataFrame, known: DataFrame, platt: list[np.ndarray], taken: list[int]) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
    """What each view is confident of: (view, class, t, m), at most GIVEN of a view and class."""
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    odds = {c: F.col(c) * float(w[0]) + float(w[1]) for c, w in zip(("st", "sm"), platt, strict=True)}
    good, bad = {c: x >= sure for c, x in odds.items()}, {c: x <= -sure for c, x in odds.items()}
    free = scored.where(F.col("doc_id").isNotNull() & (good["st"] | good["sm"] | bad["st"] | bad["sm"]))
    if taken:
        free = free.join(_listed(rows, "key", taken), "key", "left_anti")  # at most ROUNDS * 4 * GIVEN
    free = free.join(known.select("doc_id"), "doc_id", "left_anti")
    free = pin(free.groupBy("key", "st", "sm").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "row")).alias("who")))
    chosen = None
    for view, other in (("st", "sm"), ("sm", "st")):
        for y, own, against in ((1.0, good[view], bad[other]), (0.0, bad[view], good[other])):
            most = free.where(own & ~against).orderBy(F.desc(view) if y else F.asc(view), "who").limit(GIVEN)
            most = most.select("who.row", "key", F.lit(view).alias("view"), F.lit(y).alias("y"))
            chosen = most if chosen is None else chosen.unionByName(most)
    listed = chosen.collect()  # at most 4 * GIVEN rows
    unpin(free)
    new = sorted({r["row"] for r in listed})
    found = {r["row"]: r for r in rows.join(_listed(rows, "row", new), "row", "left_semi").select("row", "t", "m").collect()}
    taken += {r["key"] for r in listed}
    return [(r["view"], r["y"], np.array(found[r["row"]]["t"]), np.array(found[r["row"]]["m"])) for r in listed]


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[tuple[int, float]], list[int]]:
    """The labels (doc_id, y) of these documents; a bounded sample of them in hash order; how many of either class there are."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    known = pin(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    sample = [r for y in (0.0, 1.0) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED // 2).collect()]
    return known, [(r["doc_id"], r["y"]) for r in sample], [total.get(0.0, 0), total.get(1.0, 0)]


def train(rows: DataFrame, known: DataFrame, sample: list[tuple[int, float]], total: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Coefficients of the text view and the metadata view, their calibrations, and the combination, after all rounds."""
    order = {d: (k, y) for k, (d, y) in enumerate(sample)}
    found = sorted(rows.join(_listed(rows, "doc_id", list(order)), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("key", "row", "t", "m")).alias("r")).collect(), key=lambda r: order[r["doc_id"]][0])
    y = np.array([order[r["doc_id"]][1] for r in found])
    t, m = np.array([r["r"]["t"] for r in found]), np.array([r["r"]["m"] for r in found])
    fold, weight = np.zeros(len(y), bool), np.ones(len(y))
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at[::FOLDS]] = True
        weight[at] = total[c] / len(at) * len(y) / sum(total)
    parts = {"st": [(t[~fold], y[~fold], weight[~fold])], "sm": [(m[~fold], y[~fold], weight[~fold])]}
    learn = lambda view: fit(*(np.concatenate([p[k] for p in parts[view]]) for k in range(3)))
    taken: list[int] = []
    for done in range(ROUNDS + 1):
        text, meta = learn("st"), learn("sm")
        odds = np.column_stack([t[fold] @ text[:-1] + text[-1], m[fold] @ meta[:-1] + meta[-1]])
        platt = [fit(odds[:, [k]], y[fold], weight[fold], ridge=1e-2) for k in (0, 1)]
        given = _given(rows, _scored(rows, text, meta), known, platt, taken) if done < ROUNDS else []
        if not given:
            break
        for view, other, at in (("st", "sm", 3), ("sm", "st", 2)):  # each view's picks train the other
            own = [g for g in given if g[0] == view]
            if own:
                parts[other].append((np.array([g[at] for g in own]), np.array([g[1] for g in own]), np.full(len(own), PSEUDO)))
    both = fit(np.column_stack([odds[:, k] * platt[k][0] + platt[k][1] for k in (0, 1)]), y[fold], weight[fold], ridge=1e-2)
    return text, meta, platt, both


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``classify`` with the rows' keys."""
    rows = pin(features(docs).withColumn("row", F.monotonically_increasing_id()))
    known, sample, total = _labelled(docs, labels)
    if min(total) < 2:
        return rows.select("doc_id", "key", *[F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("kept"))
    text, meta, platt, both = train(rows, known, sample, total)
    logistic = lambda c: 1 / (1 + F.exp(-c))
    a, b = (F.col(c) * float(w[0]) + float(w[1]) for c, w in zip(("st", "sm"), platt, strict=True))
    out = _scored(rows, text, meta).select("doc_id", "key", logistic(a).alias("text_score"), logistic(b).alias("meta_score"), logistic(a * float(both[0]) + b * float(both[1]) + float(both[2])).alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP_FROM)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score (calibrated probabilities of good quality) and kept."""
    return _judged(docs, labels).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with all their columns; every row is judged by itself, null and repeated doc_ids too."""
    good = _judged(docs, labels).where("kept").select(F.col("doc_id").alias("id"), "key").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), row_key(docs).alias("own_key"))
    return rows.join(good, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi").select("doc.*")
