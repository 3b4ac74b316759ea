"""Bootstrap intervals without gathering a cell's rows, on scores as they are.

A resample of exchangeable units only depends on how often each distinct unit is drawn.  Rows are therefore counted
by what the statistic sees of them, and the counts are drawn in two steps: how many draws of a resample fall into
each score bucket (a multinomial over the small table of buckets), then, bucket by bucket, which of its distinct
rows they are.  That is the multinomial over all rows, whatever their number.

Clustered statistics of scores draw whole cases: strata of up to ``SMALL`` cases by exact multinomial counts, more
by Poisson weights hashed from the case and scaled to the stratum's number of cases.  Cases with the same rows are one
kind, weighted once by the sum of its cases' weights (c of Poisson(1) are one of Poisson(c)).  A task weighs the cells (case,
score) of one bucket in all resamples and returns sums; what the area needs across buckets follows from the
buckets' totals.  Only the fits of a resampled recalibration take a bucket's mean logit for its rows (buckets are
under 0.006 wide there).  Results travel as matrices of ``DRAWS`` resamples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.counts import kinds
from cohortlens.operators.ranks import areas, bucket
from cohortlens.session import scratch

B, SEED = 2000, 20240101
#: Counts that are drawn at a time.
CHUNK = 2_000_000
#: Cases of a stratum that are drawn exactly; resamples in a matrix; rows of a task's group of equal scores; rows weighted at a time.
SMALL, DRAWS, ROWS, BLOCK = 1000, 100, 50_000, 4096
#: Kinds of equally many cases from which on their weights are looked up by the first bits.
GUIDED = 32
#: Finer buckets that a frequent one is cut into, at most.
PARTS = 1 << 16
#: Poisson(1) by 16 bits of a hash, so probabilities are multiples of 1 / 65,536.
POISSON = np.searchsorted(np.round(np.cumsum([np.exp(-1) / math.factorial(k) for k in range(9)]) * 65536), np.arange(65536), side="right").astype(np.uint8)


def generator(seed: int, *names: object) -> np.random.Generator:
    """A generator of its own for every combination of names, so that one more cell never moves another."""
    words = np.frombuffer(hashlib.sha256("\x1f".join(map(str, names)).encode()).digest(), "<u4")
    return np.random.Generator(np.random.SFC64(np.random.SeedSequence(seed, spawn_key=tuple(words.tolist()))))


def interval(draws: np.ndarray, level: float = 0.95) -> tuple[float | None, float | None, str | None]:
    """Bounds between the order statistics of the finite draws; none where a tenth is not finite or nothing varies."""
    usable = np.sort(draws[np.isfinite(draws)])
    if 10 * usable.size < 9 * draws.size:
        return None, None, "degenerate_resamples"
    tail = (1 - level) / 2
    low, high = np.interp([tail, 1 - tail], np.linspace(0, 1, usable.size), usable).tolist()
    return (low, high, None) if low < high else (None, None, "boundary_estimate")


def drawn(rng: np.random.Generator, counts: np.ndarray, b: int, *values: np.ndarray) -> list[np.ndarray]:
    """Totals of each value over b multinomial resamples of the units, drawn in blocks of bounded size."""
    out, step = [], max(1, CHUNK // len(counts))
    for at in range(0, b, step):
        taken = rng.multinomial(counts.sum(), counts / counts.sum(), min(step, b - at))
        out.append([taken @ v for v in values])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _typed(keys: list[str], more: str) -> str:
    return ", ".join(f"`{k}` string" for k in keys) + ", " + more


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys})


def row_draws(cells: DataFrame, keys: list[str], name: str, reduce: Callable, combine: Callable, b: int, seed: int) -> DataFrame:
    """keys, b, value of b resamples of rows within their outcome y.

    cells: keys, y, c (rows), bucket, and what ``reduce`` needs.  It turns a bucket's cells and their drawn counts
    (resamples x cells) into a matrix (any x resamples); ``combine`` turns these, by rising bucket, into a value a resample.
    """
    cells = _named(cells, keys)
    own = [*keys, "bucket"]
    sizes = cells.groupBy(*own, "y").agg(F.sum("c").alias("c"))

    def allot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "bucket"], ascending=[False, True])
        key, out = [pdf[k].iloc[0] for k in keys], []
        for y, part in pdf.groupby("y", sort=False):
            c, rng = part["c"].to_numpy(), generator(seed, *key, name, y)
            for block, first in enumerate(range(0, b, DRAWS)):
                n = rng.multinomial(c.sum(), c / c.sum(), min(DRAWS, b - first)).T.astype("<i8")
                out += [[*key, k, int(y), block, x.tobytes()] for k, x in zip(part["bucket"], n, strict=True)]
        return pd.DataFrame(out, columns=[*own, "y", "block", "n"])

    def draw(key: tuple, pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in pdf.columns if c not in own]).reset_index(drop=True)
        c, y, out = pdf["c"].to_numpy(), pdf["y"].to_numpy(), []
        for block, part in given.sort_values("y", ascending=False).groupby("block"):
            n = {k: np.frombuffer(x, "<i8") for k, x in zip(part["y"], part["n"], strict=True)}
            count, found = len(next(iter(n.values()))), []
            step = max(1, CHUNK // len(c))
            rng = generator(seed, *key, name, block)
            for at in range(0, count, step):
                taken = np.zeros((min(step, count - at), len(c)), np.int64)
                for k, x in n.items():
                    taken[:, y == k] = rng.multinomial(x[at : at + step], c[y == k] / c[y == k].sum())
                found.append(reduce(pdf, taken))
            out.append([*key, int(block), np.concatenate(found, axis=1).astype("<f8").tobytes()])
        return pd.DataFrame(out, columns=[*own, "block", "m"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        first = int(pdf["block"].iloc[0]) * DRAWS
        count = min(DRAWS, b - first)
        value = combine([np.frombuffer(x, "<f8").reshape(-1, count) for x in pdf["m"]])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "b": first + 1 + np.arange(count), "value": value})

    given = sizes.groupBy(*keys).applyInPandas(allot, _typed(keys, "bucket long, y int, block int, n binary"))
    parts = cells.groupBy(*own).cogroup(given.groupBy(*own)).applyInPandas(draw, _typed(keys, "bucket long, block int, m binary"))
    return parts.groupBy(*keys, "block").applyInPandas(settle, _typed(keys, "b int, value double"))


def _within(s: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pairs won by positives over negatives among cells at ascending s (resamples x cells), half for ties."""
    first = np.flatnonzero(np.diff(s, prepend=-np.inf))
    p, q = np.add.reduceat(p, first, axis=1), np.add.reduceat(q, first, axis=1)
    return (p * (np.cumsum(q, axis=1) - q / 2)).sum(axis=1)


def _won(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs won, positives and negatives, of matrices (won inside, positives, negatives) by rising score."""
    won = below = pos = np.zeros(parts[0].shape[1])
    for inside, p, q in parts:
        won, below, pos = won + inside + p * below, below + q, pos + p
    return won, pos, below


def bootstrap_auroc(rows: DataFrame, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, n_pos, n_neg, ci_lo, ci_hi, reason of the stratified row bootstrap, on exact scores."""
    cells = rows.where("score is not null").groupBy(*keys, F.col("score").cast("double").alias("s"), "y").agg(F.count("*").alias("c")).withColumn("bucket", bucket(F.col("s")))

    def reduce(pdf: pd.DataFrame, taken: np.ndarray) -> np.ndarray:
        order = np.argsort(pdf["s"].to_numpy(), kind="stable")
        y, taken = pdf["y"].to_numpy()[order], taken[:, order]
        p, q = taken * (y == 1), taken * (y == 0)
        return np.stack([_within(pdf["s"].to_numpy()[order], p, q), p.sum(axis=1), q.sum(axis=1)])

    def combine(parts: list[np.ndarray]) -> np.ndarray:
        won, pos, neg = _won(parts)
        with np.errstate(divide="ignore", invalid="ignore"):
            return won / (pos * neg)

    sizes = _named(cells, keys).groupBy(*keys).agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("n_neg"))
    found = _percentiles(row_draws(cells, keys, "auroc", reduce, combine, b, seed), keys, "value", b)
    short = F.when(F.col("n_pos") < 2, "insufficient_positives").when(F.col("n_neg") < 2, "insufficient_negatives")
    out = sizes.join(found, keys, "left").withColumn("reason", F.coalesce(short, "reason"))
    shown = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select(*keys, "n_pos", "n_neg", shown("ci_lo"), shown("ci_hi"), "reason")


def _mean_interval(cells: DataFrame, keys: list[str], b: int, seed: int, both: bool) -> DataFrame:
    """keys, n, est, ci_lo, ci_hi, reason of the mean of d over rows drawn within y; ``both`` refuses a single outcome."""
    reduce = lambda pdf, taken: (taken @ pdf["d"].to_numpy())[None, :]
    cells = cells.withColumn("bucket", bucket(F.col("d")))
    sizes = _named(cells, keys).groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("d")) / F.sum("c")).alias("est"), F.count_distinct("y").alias("outcomes"))
    found = row_draws(cells, keys, "brier", reduce, lambda parts: sum(x[0] for x in parts), b, seed)
    found = found.join(sizes.select(*keys, "n"), keys).withColumn("value", F.col("value") / F.col("n")).drop("n")
    out = sizes.join(_percentiles(found, keys, "value", b), keys, "left")
    out = out.withColumn("reason", F.when((F.col("outcomes") < 2) & F.lit(both), "single_class").otherwise(F.col("reason")))
    shown = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select(*keys, "n", "est", shown("ci_lo"), shown("ci_hi"), "reason")


def bootstrap_paired_brier(pairs: DataFrame, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, n, est, ci_lo, ci_hi, reason of the difference of two Brier scores on the same rows."""
    loss = lambda c: (F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))
    return _mean_interval(pairs.groupBy(*keys, "y", (loss("score") - loss("prior")).alias("d")).agg(F.count("*").alias("c")), keys, b, seed, False)


def bootstrap_brier(rows: DataFrame, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, n, est, ci_lo, ci_hi, reason of the Brier score of rows drawn within their outcome; a cell with one
    outcome keeps its estimate."""
    loss = (F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))
    return _mean_interval(rows.where("score is not null").groupBy(*keys, "y", loss.alias("d")).agg(F.count("*").alias("c")), keys, b, seed, True)


def bootstrap_clustered_proportion(cells: DataFrame, case: str, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, cases, est, ci_lo, ci_hi, reason: whole cases drawn with replacement, of rows with ``hit`` (0/1)."""
    units = cells.groupBy(*keys, case).agg(F.count("*").alias("m"), F.sum("hit").alias("u"))
    return bootstrap_units(units, keys, b, seed)


def bootstrap_units(units: DataFrame, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """The same of one row a case: m rows, and u, the sum of their hits; u may be negative (a difference)."""
    return bootstrap_kinds(kinds(units, keys), keys, b, seed)


def bootstrap_kinds(kinds: DataFrame, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """The same of kinds() of cases."""
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m", "u"])
        m, u, c = (pdf[x].to_numpy() for x in "muc")
        key = [str(pdf[k].iloc[0]) for k in keys]
        events, all_rows = drawn(generator(seed, *key, "proportion"), c, b, u, m)
        found = interval(events / np.maximum(all_rows, 1)) if c.sum() >= 2 else (None, None, "insufficient_clusters")
        if c.sum() < 5:
            found = (None, None, "fewer_than_five_cases")
        return pd.DataFrame([[*key, int(c.sum()), float((c @ u) / (c @ m)), *found]], columns=[*keys, "cases", "est", "ci_lo", "ci_hi", "reason"])

    return kinds.groupBy(*keys).applyInPandas(draw, ", ".join(f"{k} string" for k in keys) + ", cases long, est double, ci_lo double, ci_hi double, reason string")


def bootstrap_clustered_difference(cells: DataFrame, case: str, level: str, keys: list[str], reference: str, b: int = B, seed: int = SEED) -> DataFrame:
    """keys, level, cases, est, ci_lo, ci_hi, reason: each level's proportion less the reference level's.

    Whole cases are drawn on both sides, the level's first, by one generator.  A case with rows on both
    sides, fewer than five cases on a side, or a side whose own interval has no width refuses the interval.
    """
    units = cells.groupBy(*keys, F.col(level).alias("level"), case).agg(F.count("*").alias("m"), F.sum("hit").alias("u"))
    spans = F.max((F.col("level") == reference).cast("int")).over(Window.partitionBy(*keys, case))
    kinds = units.withColumn("spans", spans).groupBy(*keys, "level", "m", "u").agg(F.count("*").alias("c"), F.max("spans").alias("spans"))
    own = kinds.where(F.col("level") != reference).withColumn("side", F.lit(0))
    base = kinds.where(F.col("level") == reference).drop("level", "spans")
    other = own.select(*keys, "level").distinct().join(base, keys).select(*keys, "level", "m", "u", "c", F.lit(0).alias("spans"), F.lit(1).alias("side"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        key, sides = [str(pdf[k].iloc[0]) for k in [*keys, "level"]], []
        rng = generator(seed, *key, "difference")
        for side in (0, 1):
            part = pdf[pdf["side"] == side].sort_values(["m", "u"])
            sides.append(tuple(part[x].to_numpy() for x in "muc"))
        cases = [int(c.sum()) for _, _, c in sides]
        est = float(np.subtract(*[(c @ u) / (c @ m) for m, u, c in sides])) if min(cases) else None
        if not min(cases):
            found = (None, None, "zero_denominator")
        elif pdf["spans"].any():
            found = (None, None, "cases_span_both_groups")
        elif min(cases) < 5:
            found = (None, None, "fewer_than_five_cases")
        else:
            draws = [np.divide(*drawn(rng, c, b, u, m)) for m, u, c in sides]
            found = (None, None, "boundary_estimate") if any(interval(d)[2] for d in draws) else interval(draws[0] - draws[1])
        return pd.DataFrame([[*key, cases[0], est, *found]], columns=[*keys, "level", "cases", "est", "ci_lo", "ci_hi", "reason"])

    return own.unionByName(other).groupBy(*keys, "level").applyInPandas(draw, ", ".join(f"{k} string" for k in [*keys, "level"]) + ", cases long, est double, ci_lo double, ci_hi double, reason string")


def _stirred(h: np.ndarray, first: int, last: int) -> np.ndarray:
    """64 random bits for each hash and each number from first to last - 1."""
    x = h.view(np.uint64)[:, None] + np.arange(first, last, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def hashed_weights(h: np.ndarray, first: int, count: int) -> np.ndarray:
    """Poisson(1) weights of the resamples first, first + 1, ... for each hash of a case; first is a multiple of four."""
    return POISSON.take(_stirred(h, first // 4 + 1, (first + count + 3) // 4 + 1).view(np.uint16))[:, :count]


@lru_cache(maxsize=16)
def exact_weights(seed: int, key: tuple, n: int, b: int) -> np.ndarray:
    """How often the first 0, 1, ... n of n cases are drawn in b resamples of n cases (cases x resamples)."""
    taken = generator(seed, *key, "cases").multinomial(n, np.full(n, 1 / n), b).T
    return np.concatenate([np.zeros((1, b), np.uint16), np.cumsum(taken, axis=0, dtype=np.uint16)])


@lru_cache(maxsize=256)
def poisson_table(n: int) -> tuple[int, np.ndarray]:
    """The smallest count of a Poisson(n) in reach of 53 bits, and the distribution function from there."""
    reach = 12 * math.sqrt(n) + 40
    low = max(0, int(n - reach))
    steps = np.cumsum(np.log(n / np.arange(low + 1, int(n + reach) + 1)))
    p = np.exp(np.concatenate([[0.0], steps]) - max(0.0, steps.max()))
    return low, np.cumsum(p) / p.sum()


def _counted(n: int, u: np.ndarray) -> np.ndarray:
    """Poisson(n) counts of random numbers of 53 bits."""
    low, share = poisson_table(n)
    return low + np.minimum(np.searchsorted(share, u * 2.0**-53, side="right"), len(share) - 1)


@lru_cache(maxsize=64)
def poisson_guide(n: int) -> np.ndarray:
    """_counted() of all random numbers with the same first 16 bits, -1 where later bits decide."""
    first = np.arange(65536, dtype=np.uint64) << np.uint64(37)
    least, most = _counted(n, first), _counted(n, first + np.uint64(2**37 - 1))
    return np.where(least == most, least, -1).astype(np.int32)


def kind_weights(h: np.ndarray, c: np.ndarray, first: int, count: int) -> np.ndarray:
    """Poisson(c) weights of the resamples first, first + 1, ... for each kind of c cases, from a hash of its first case."""
    single = c == 1
    if single.all():
        return hashed_weights(h, first, count).astype(float)
    out = np.empty((len(h), count))
    out[single] = hashed_weights(h[single], first, count)
    for n in np.unique(c[~single]).tolist():
        every = np.flatnonzero(c == n)
        for lo in range(0, len(every), 512):  # little enough for a processor's cache
            where = every[lo : lo + 512]
            u = _stirred(h[where], first + 1, first + count + 1)
            u >>= np.uint64(11)
            if len(every) < GUIDED:
                out[where] = _counted(n, u)
                continue
            found = poisson_guide(n).take((u >> np.uint64(37)).view(np.int64))
            if found.min() < 0:
                late = found < 0
                found[late] = _counted(n, u[late])
            out[where] = found
    return out


def case_kinds(rows: DataFrame, case: str, keys: list[str], scores: list[str], seed: int) -> DataFrame:
    """keys, h, c, y, scores, n: the n equal rows that each of the c cases of a kind has; h is the least hash of the cases.

    Cases are of one kind if their rows agree in y and all scores, told by two 64-bit sums of their rows' hashes.
    """
    cells = _named(rows, keys).groupBy(*keys, case, "y", *[F.col(s).cast("double").alias(s) for s in scores]).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, case)
    told = [x for s in ("y", *scores) for x in (F.col(s).isNull(), F.col(s))]  # a hash passes nulls over
    signs = [F.bit_xor(F.xxhash64(F.lit(i), F.col("n"), *told)).over(w).alias(f"_sign{i}") for i in (0, 1)]
    cells = cells.select(*keys, F.xxhash64(case, F.lit(seed)).alias("h"), *signs, "y", *scores, "n")
    return cells.groupBy(*keys, "_sign0", "_sign1", "y", *scores, "n").agg(F.min("h").alias("h"), F.count("*").alias("c"))


def _kept(df: DataFrame) -> DataFrame:
    """The same rows from a table under the checkpoint folder, so that what made them runs once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the buckets of over ROWS cells cut at equal distances of scores, so that no task gets a frequent one
    whole; numbers of buckets still rise with the scores, and sums by bucket stay exact."""
    size = cells.groupBy(*keys, "bucket").agg(F.min("s").alias("_low"), F.max("s").alias("_high"), F.count("*").alias("_n"))
    size = size.where((F.col("_n") > ROWS) & (F.col("_low") < F.col("_high"))).withColumn("_parts", F.least(F.lit(PARTS), F.ceil(2 * F.col("_n") / ROWS)))
    place = F.floor((F.col("s") - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_parts"))
    part = F.coalesce(F.least(place, F.col("_parts") - 1), F.lit(0))
    return cells.join(size, [*keys, "bucket"], "left").withColumn("bucket", F.col("bucket") * PARTS + part).drop("_low", "_high", "_n", "_parts")


class Pairs:
    """Pairs that positives win over negatives (half for ties) among rows at rising scores, some at a time, in b resamples.

    won has a row for own-own, own-mixed, mixed-own and mixed-mixed strata.  Weights are whole numbers, so sums are exact.
    """

    def __init__(self, s: np.ndarray, p: np.ndarray, q: np.ndarray, mixed: np.ndarray, b: int) -> None:
        self.at = np.cumsum(np.diff(s, prepend=s[:1]) > 0)
        self.counts, self.mixed = (p, q), mixed
        self.won, self.below = np.zeros((4, b)), np.zeros((2, b))
        self.last = np.zeros((2, 2, b))  # positives and negatives so far at the last score

    def turn(self, part: slice) -> None:
        """Takes up the next rows."""
        at, mixed = self.at[part], self.mixed[part]
        self.tied, self.one = part.start > 0 and self.at[part.start - 1] == at[0], at[0] == at[-1]
        self.ends, self.rows = (at[0], at[-1]), []
        for x in self.counts:
            for k in (False, True):
                rows = np.flatnonzero((x[part] > 0) & (mixed == k))
                start = np.flatnonzero(np.diff(at[rows], prepend=-1))
                self.rows.append((rows, x[part][rows].astype(float), start, at[rows][start]))
        self.places = [[np.searchsorted(self.rows[2 + j][3], self.rows[i][3], side) for side in ("left", "right")] for i in (0, 1) for j in (0, 1)]

    def add(self, weight: np.ndarray, to: slice) -> None:
        """Adds these rows with their weights in the resamples ``to``."""
        steps = []
        for rows, x, start, _ in self.rows:
            w = weight if len(rows) == len(weight) else weight[rows]
            w = w if (x == 1).all() else w * x[:, None]
            steps.append(w if len(start) == len(rows) else np.add.reduceat(w, start, axis=0))
        none = np.zeros(weight.shape[1])
        ends = np.array([[x[k] if len(at) and at[k] == end else none for x, (*_, at) in zip(steps, self.rows, strict=True)] for k, end in zip((0, -1), self.ends, strict=True)]).reshape(2, 2, 2, -1)
        for j in (0, 1):
            less = np.empty((len(steps[2 + j]) + 1, weight.shape[1]))
            less[0] = self.below[j, to]
            less[1:] = steps[2 + j]
            np.cumsum(less, axis=0, out=less)
            for i in (0, 1):
                if len(steps[i]) and less[-1].any():
                    left, right = self.places[2 * i + j]
                    won = np.einsum("sb,sb->b", steps[i], less[left])
                    self.won[2 * i + j, to] += won if (left == right).all() else (won + np.einsum("sb,sb->b", steps[i], less[right])) / 2
                if self.tied:  # rows before at the first score: half for each pair, not all or none
                    self.won[2 * i + j, to] += (self.last[0, i, to] * ends[0, 1, j] - ends[0, 0, i] * self.last[1, j, to]) / 2
            self.below[j, to] = less[-1]
        self.last[:, :, to] = ends[1] + (self.last[:, :, to] if self.tied and self.one else 0)


def weighted_blocks(kinds: DataFrame, keys: list[str], b: int, seed: int, strata: bool) -> DataFrame:
    """keys, bucket, same, block, low, x, m: what resampled cases make of each score bucket, in ``DRAWS`` resamples a block.

    kinds: case_kinds() with their score; rows without one take no part.

    same tells whether the bucket has one score, low and x are its smallest score and mean logit.  With ``strata`` m has, for positives and negatives
    of their strata (own, mixed): pairs won inside the bucket (own-own, own-mixed, mixed-own, mixed-mixed), then
    positives and negatives by stratum.  Without, all cases are one stratum and m has positives, negatives,
    expected positives and losses.  Bucket null has the sums of the weights of the strata's cases and their numbers.
    A bucket of one score is dealt over several rows, to be added up, and leaves its own pairs to the reader; one of many
    rows and several scores was cut into finer ones before.
    """
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    cells = kinds.where("score is not null").groupBy(*keys, "h", "c", F.col("score").alias("s")).agg(of(1).alias("p"), of(0).alias("q"))
    w = Window.partitionBy(*keys, "h")
    stratum = F.when(F.sum("q").over(w) == 0, "pos").when(F.sum("p").over(w) == 0, "neg").otherwise("mixed") if strata else F.lit("all")
    cells = cells.select(*keys, stratum.alias("stratum"), "h", "c", "s", "p", "q", bucket(F.col("s")).alias("bucket"))
    cells = _parted(cells, keys)
    own = [*keys, "stratum"]
    units = cells.select(*own, "h", "c").distinct()
    sizes = units.groupBy(*own).agg(F.sum("c").alias("units"))
    units = units.join(sizes, own)
    before = Window.partitionBy(*own).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # at most SMALL rows a window
    few = units.where(F.col("units") <= SMALL).withColumn("i", F.coalesce(F.sum("c").over(before), F.lit(0)))
    many = units.where(F.col("units") > SMALL).withColumn("i", F.lit(None).cast("long"))
    units = few.unionByName(many)
    same = F.col("low") == F.col("high")
    spread = cells.groupBy(*keys, "bucket").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n"))
    spread = spread.select(*keys, "bucket", "low", same.alias("same"), F.when(same, F.ceil(F.col("n") / ROWS)).otherwise(1).alias("salts"))
    cells = cells.join(units.drop("c"), [*own, "h"]).join(spread, [*keys, "bucket"]).withColumn("salt", F.pmod(F.col("h"), F.col("salts")))
    totals = units.select(*own, "h", "c", "units", "i", F.lit(None).cast("double").alias("s"), F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("double").alias("low"), F.lit(True).alias("same"), F.pmod("h", F.ceil(F.col("units") / ROWS)).alias("salt"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "h"])
        key, same = [pdf[k].iloc[0] for k in keys], bool(pdf["same"].iloc[0])
        whole = bool(pdf["bucket"].isna().iloc[0])
        s, h, c, i, p, q = (pdf[x].to_numpy() for x in ("s", "h", "c", "i", "p", "q"))
        names, first_of, kinds = np.unique(pdf["stratum"].to_numpy().astype(str), return_index=True, return_inverse=True)
        units = [int(n) for n in pdf["units"].to_numpy()[first_of]]
        mixed = names[kinds] == "mixed"
        if whole:
            terms = [kinds == k for k in range(len(names))]
        elif strata:
            terms = [x * (mixed == k) for x in (p, q) for k in (False, True)]
        else:
            terms = [p, q, s * (p + q), (1 - s) ** 2 * p + s**2 * q]
        terms = np.array(terms, float)
        sums, pairs = np.zeros((len(terms), b)), None if same or whole or not strata else Pairs(s, p, q, mixed, b)
        for lo in range(0, len(s), BLOCK):
            part = slice(lo, lo + BLOCK)
            if pairs:
                pairs.turn(part)
            for first in range(0, b, DRAWS):
                count = min(DRAWS, b - first)
                weight = np.empty((len(s[part]), count))
                for k in np.unique(kinds[part]):
                    where = np.flatnonzero(kinds[part] == k)
                    if units[k] <= SMALL:
                        drawn_before, at = exact_weights(seed, (*key, str(names[k])), units[k], b)[:, first : first + count], i[part][where].astype(int)
                        found = drawn_before[at + c[part][where]].astype(float) - drawn_before[at]
                    else:
                        found = kind_weights(h[part][where], c[part][where], first, count)
                    if len(where) == len(weight):
                        weight = found
                    else:
                        weight[where] = found
                sums[:, first : first + count] += terms[:, part] @ weight
                if pairs:
                    pairs.add(weight, slice(first, first + count))
        out = []
        for block, first in enumerate(range(0, b, DRAWS)):
            at = slice(first, min(first + DRAWS, b))
            if whole:
                out += [[*key, None, True, str(kind), n, block, None, None, x[at].tobytes()] for kind, n, x in zip(names, units, sums, strict=True)]
                continue
            found = sums[:, at] if not strata else np.concatenate([pairs.won[:, at] if pairs else np.zeros((4, at.stop - first)), sums[:, at]])
            clipped = np.clip(s, 1e-12, 1 - 1e-12)
            x = float(np.average(np.log(clipped / (1 - clipped)), weights=(p + q) * c)) if s.min() >= 0 and s.max() <= 1 else None
            out.append([*key, int(pdf["bucket"].iloc[0]), same, None, 0, block, float(s[0]), x, found.tobytes()])
        return pd.DataFrame(out, columns=[*keys, "bucket", "same", "stratum", "units", "block", "low", "x", "m"])

    columns = [*keys, "bucket", "stratum", "h", "c", "units", "i", "s", "p", "q", "same", "salt"]
    both = cells.select(*columns).unionByName(totals.select(*columns))
    return both.groupBy(*keys, "bucket", "salt").applyInPandas(add, _typed(keys, "bucket long, same boolean, stratum string, units long, block int, low double, x double, m binary"))


def _scales(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """For each stratum its number of cases over the sum of their weights, by resample; nan where none was drawn."""
    out: dict[str, tuple[int, np.ndarray]] = {}
    for kind, n, m in zip(pdf["stratum"], pdf["units"], pdf["m"], strict=True):
        if kind is not None:
            out[kind] = (n, out.get(kind, (n, 0.0))[1] + np.frombuffer(m))
    with np.errstate(divide="ignore", invalid="ignore"):
        return {k: np.where(t > 0, n / t, np.nan) for k, (n, t) in out.items()}


def _by_bucket(pdf: pd.DataFrame, count: int) -> list[tuple[float, bool, np.ndarray]]:
    """Mean logit, whether there is one score, and summed matrix of each bucket, by rising score."""
    cells = pdf[pdf["stratum"].isna()].sort_values(["low", "bucket"])
    return [(part["x"].iloc[0], part["same"].iloc[0], sum(np.frombuffer(m).reshape(-1, count) for m in part["m"])) for _, part in cells.groupby("bucket", sort=False)]


def _percentiles(draws: DataFrame, keys: list[str], value: str, b: int) -> DataFrame:
    """keys, draws, ci_lo, ci_hi, reason of the finite values of b resamples."""
    finite = F.when(~F.isnan(value), F.col(value))
    fine = draws.groupBy(*keys).agg(F.count(finite).alias("draws"), F.percentile(finite, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    reason = F.when(F.col("draws") < 0.9 * b, "degenerate_resamples").when(F.col("q")[0] == F.col("q")[1], "boundary_estimate")
    return fine.select(*keys, "draws", F.when(reason.isNull(), F.col("q")[0]).alias("ci_lo"), F.when(reason.isNull(), F.col("q")[1]).alias("ci_hi"), reason.alias("reason"))


def bootstrap_clustered_auroc(rows: DataFrame, case: str, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, draws, ci_lo, ci_hi, reason of the area under cases resampled within their class, all sums distributed.

    A class that the draws cannot vary (see ``class_strata``) or fewer than five cases refuse the interval.
    """
    found = _percentiles(clustered_areas(rows, case, keys, b, seed), keys, "value", b)
    return _guarded(found, class_strata(rows.where("score is not null"), case, keys), keys).select(*keys, "draws", "ci_lo", "ci_hi", "reason")


def _short(strata: DataFrame, keys: list[str]) -> DataFrame:
    """keys as text, cases, short of class_strata(): whether a class is absent, or cannot be varied by draws of cases within classes."""
    cases = F.col("units_pos") + F.col("units_neg") + F.col("units_mixed")
    single = (F.col("units_mixed") == 0) & (F.least("units_pos", "units_neg") == 0)
    short = F.when(single, "single_class").when(F.col("deficient").isNotNull(), "insufficient_clusters")
    return strata.select(*[F.col(k).cast("string").alias(k) for k in keys], cases.alias("units"), short.alias("short"))


def _guarded(found: DataFrame, strata: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals with those of deficient classes (see ``class_strata``) and of fewer than five cases refused, in the reference's order."""
    out = found.join(_short(strata, keys), keys, "left")
    reason = F.coalesce("short", "reason", F.when(F.col("units") < 5, "fewer_than_five_cases"))
    out = out.withColumn("reason", reason)
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("ci_lo", "ci_hi")}).drop("units", "short")


def clustered_areas(rows: DataFrame, case: str, keys: list[str], b: int, seed: int = SEED) -> DataFrame:
    """keys, b, value: the area of each resample of cases within positive, negative and mixed ones; NaN without a class."""
    return _areas_of(_kept(case_kinds(rows.where("score is not null"), case, keys, ["score"], seed)), keys, b, seed)


def _areas_of(kinds: DataFrame, keys: list[str], b: int, seed: int) -> DataFrame:
    """clustered_areas() of case_kinds()."""
    found = weighted_blocks(kinds, keys, b, seed, strata=True)

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["block"].iloc[0]) * DRAWS
        count = min(DRAWS, b - first)
        scale, none = _scales(pdf), np.zeros(count)
        pos, neg = [[scale.get(k, none) for k in kinds] for kinds in (("pos", "mixed"), ("neg", "mixed"))]
        won, below, ones = np.zeros(count), np.zeros(count), np.zeros(count)
        for _, same, m in _by_bucket(pdf, count):
            p, q = m[4] * pos[0] + m[5] * pos[1], m[6] * neg[0] + m[7] * neg[1]
            inside = sum(m[2 * i + j] * pos[i] * neg[j] for i in (0, 1) for j in (0, 1))
            won, below, ones = won + p * below + (p * q / 2 if same else inside), below + q, ones + p
        with np.errstate(divide="ignore", invalid="ignore"):
            value = won / (ones * below)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "b": first + 1 + np.arange(count), "value": value})

    return found.groupBy(*keys, "block").applyInPandas(area, _typed(keys, "b int, value double"))


def _less(draws: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Value less the other's value of the same resample."""
    return draws.join(other.withColumnRenamed("value", "other"), on).withColumn("value", F.col("value") - F.col("other")).drop("other")


def bootstrap_clustered_area_difference(rows: DataFrame, case: str, level: str, keys: list[str], reference: str, b: int = B, seed: int = SEED) -> DataFrame:
    """keys, level, cases, est, draws, ci_lo, ci_hi, reason: each level's area less the reference level's.

    Cases of two levels are different units with weights of their own, so the sides vary independently; a
    case with rows on both sides refuses the interval, as do fewer than five cases or fewer than ten rows of
    a class on a side, and a side whose own interval has no width.
    """
    own = [*keys, "level"]
    rows = rows.withColumn("level", F.col(level))
    scored = F.col("score").isNotNull()
    sums = {name: F.count_if((F.col("y") == y) & kept) for y, a in ((1, "p"), (0, "q")) for name, kept in ((a, F.lit(True)), (f"scored_{a}", scored))}
    units = rows.groupBy(*own, case).agg(*[x.alias(name) for name, x in sums.items()], (F.count_if(scored) > 0).alias("scored"))
    spans = F.max((F.col("level") == reference).cast("int")).over(Window.partitionBy(*keys, case))
    shapes = _kept(units.withColumn("spans", spans).groupBy(*own, *sums, "scored", "spans").agg(F.count("*").alias("c")))
    total = lambda x: F.sum(F.col("c") * F.col(x))
    side = shapes.groupBy(*own).agg(F.sum("c").alias("cases"), F.least(total("p"), total("q")).alias("scarce"), F.max("spans").alias("spans"))
    kinds = _kept(case_kinds(rows.where(scored), case, own, ["score"], seed))
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n") * F.col("c"))), F.lit(0))
    side = side.join(areas(kinds.groupBy(*own, F.col("score").alias("s")).agg(of(1).alias("p"), of(0).alias("q")), own).select(*own, "auc"), own)
    draws = _areas_of(kinds, own, b, seed)
    strata = strata_of(shapes.where("scored").groupBy(*own, F.col("scored_p").alias("p"), F.col("scored_q").alias("q")).agg(F.sum("c").alias("c")), own)
    own_reason = _guarded(_percentiles(draws, own, "value", b), strata, own)
    side = side.join(own_reason.select(*own, F.col("reason").alias("own_reason")), own, "left")
    is_base = F.col("level") == reference
    base = side.where(is_base).select(*keys, F.col("cases").alias("cases0"), F.col("scarce").alias("scarce0"), F.col("auc").alias("auc0"), F.col("own_reason").alias("reason0"))
    apart = _percentiles(_less(draws.where(~is_base), draws.where(is_base).drop("level"), [*keys, "b"]), own, "value", b)
    out = side.where(~is_base).join(base, keys, "left").join(apart, own, "left")
    refused = (
        F.when(F.col("cases0").isNull(), "zero_denominator")
        .when(F.col("spans") > 0, "cases_span_both_groups")
        .when(F.least("cases", "cases0") < 5, "fewer_than_five_cases")
        .when(F.least("scarce", "scarce0") < 10, "insufficient_class_rows")
        .otherwise(F.coalesce("own_reason", "reason0", "reason"))
    )
    shown = lambda c: F.when(F.col("refused").isNull(), F.col(c)).alias(c)
    return out.withColumn("refused", refused).select(*own, "cases", (F.col("auc") - F.col("auc0")).alias("est"), "draws", shown("ci_lo"), shown("ci_hi"), F.col("refused").alias("reason"))


def bootstrap_clustered_paired(pairs: DataFrame, case: str, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, metric (auroc, brier, slope), draws, ci_lo, ci_hi, reason of ``score`` less ``prior`` on the same rows.

    A case has the same weight for both scores in a resample, so what they share cancels.  Classes that the
    draws cannot vary and fewer than five cases refuse the intervals.
    """
    def statistics(kinds: DataFrame) -> DataFrame:
        area = _areas_of(kinds, keys, b, seed).withColumn("metric", F.lit("auroc"))
        return _calibration_of(kinds, keys, b, seed).where(F.col("metric").isin("brier", "slope")).unionByName(area)

    kinds = _kept(case_kinds(pairs, case, keys, ["score", "prior"], seed))  # of both scores, so that a kind has one weight
    new, prior = kinds.drop("prior"), kinds.drop("score").withColumnRenamed("prior", "score")
    found = _percentiles(_less(statistics(new), statistics(prior), [*keys, "b", "metric"]), [*keys, "metric"], "value", b)
    return _guarded(found, class_strata(pairs, case, keys), keys).select(*keys, "metric", "draws", "ci_lo", "ci_hi", "reason")


def logistic_fit(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of p events and q others at each x by Newton steps; nan where they do not settle."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-np.clip(beta @ design, -700, 700)))
        information = (design * ((p + q) * mu * (1 - mu))) @ design.T
        if not np.linalg.det(information) > 0:
            break
        step = np.linalg.solve(information, design @ (p - (p + q) * mu))
        beta = beta + step
        if np.abs(step / (1 + np.abs(beta))).max() <= 1e-10:
            return float(beta[0]), float(beta[1])
    return np.nan, np.nan


def bootstrap_clustered_calibration(rows: DataFrame, case: str, keys: list[str], b: int = B, seed: int = SEED) -> DataFrame:
    """keys, metric (oe, brier, intercept, slope), draws, ci_lo, ci_hi, reason under resampled cases; refused like the
    other clustered score statistics where a class cannot be varied or cases are under five."""
    found = _percentiles(clustered_calibration(rows, case, keys, b, seed), [*keys, "metric"], "value", b)
    return _guarded(found, class_strata(rows.where("score is not null"), case, keys), keys).select(*keys, "metric", "draws", "ci_lo", "ci_hi", "reason")


def clustered_calibration(rows: DataFrame, case: str, keys: list[str], b: int, seed: int = SEED) -> DataFrame:
    """keys, b, metric, value of each resample of cases; those with one outcome or without a fit have NaN."""
    return _calibration_of(_kept(case_kinds(rows.where("score is not null"), case, keys, ["score"], seed)), keys, b, seed)


def _calibration_of(kinds: DataFrame, keys: list[str], b: int, seed: int) -> DataFrame:
    """clustered_calibration() of case_kinds()."""
    names = ("oe", "brier", "intercept", "slope")
    found = weighted_blocks(kinds, keys, b, seed, strata=False)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key, first, out = [pdf[k].iloc[0] for k in keys], int(pdf["block"].iloc[0]) * DRAWS, []
        count = min(DRAWS, b - first)
        scale, parts = _scales(pdf)["all"], _by_bucket(pdf, count)
        x, sums = np.array([x for x, _, _ in parts], float), np.stack([m for *_, m in parts]) * scale
        for k in range(count):
            (p, q, expected, loss), values = sums[:, :, k].T, [np.nan] * 4
            if p.sum() > 0 and q.sum() > 0:
                met = p + q > 0
                values = [p.sum() / expected.sum() if expected.sum() > 0 else np.nan, loss.sum() / (p + q).sum(), *logistic_fit(x[met], p[met], q[met])]
            out += [[*key, first + k + 1, name, value] for name, value in zip(names, values, strict=True)]
        return pd.DataFrame(out, columns=[*keys, "b", "metric", "value"])

    return found.groupBy(*keys, "block").applyInPandas(fit, _typed(keys, "b int, metric string, value double"))


def class_strata(rows: DataFrame, case: str, keys: list[str]) -> DataFrame:
    """keys and what decides whether cases can be resampled within their class.

    units_pos, units_neg, units_mixed: cases with positives only, negatives only, or both; frozen_pos and
    frozen_neg: share of a class's squared rows in strata of one case; deficient: the scarcest class (ties:
    positive) whose strata all hold under two cases or whose frozen share is 0.20 or more; invariant: whether
    no resample can change the share of positives.
    """
    units = rows.groupBy(*keys, case).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    return strata_of(units.groupBy(*keys, "p", "q").agg(F.count("*").alias("c")), keys)


def strata_of(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """class_strata() of the c cases with p positives and q negatives each."""
    stratum = F.when(F.col("q") == 0, "pos").when(F.col("p") == 0, "neg").otherwise("mixed")
    sizes = sizes.withColumn("stratum", stratum)
    whole = Window.partitionBy(*keys)
    balance = F.sum(F.col("c") * (F.col("p") + F.col("q"))).over(whole) * F.col("p") - F.sum(F.col("c") * F.col("p")).over(whole) * (F.col("p") + F.col("q"))
    square = lambda x: F.sum(F.col("c") * F.col(x) * F.col(x))
    per = sizes.withColumn("balance", balance).groupBy(*keys, "stratum").agg(F.sum("c").alias("units"), square("p").alias("pp"), square("q").alias("qq"), (F.min("balance") == F.max("balance")).alias("even"))
    n = lambda s: F.coalesce(F.sum(F.when(F.col("stratum") == s, F.col("units"))), F.lit(0))
    frozen = lambda x: F.try_divide(F.sum(F.when(F.col("units") == 1, F.col(x)).otherwise(0)).cast("double"), F.sum(x).cast("double"))
    out = per.groupBy(*keys).agg(*[n(s).alias(f"units_{s}") for s in ("pos", "neg", "mixed")], F.coalesce(frozen("pp"), F.lit(0.0)).alias("frozen_pos"), F.coalesce(frozen("qq"), F.lit(0.0)).alias("frozen_neg"), F.bool_and("even").alias("invariant"))
    short = lambda s: (F.greatest(f"units_{s}", "units_mixed") < 2) | (F.col(f"frozen_{s}") >= 0.20)
    deficient = F.when(short("pos") & (~short("neg") | (F.col("units_pos") <= F.col("units_neg"))), "positive").when(short("neg"), "negative")
    return out.withColumn("deficient", deficient)
