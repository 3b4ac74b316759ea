"""Toxicity by multiple-instance learning: document labels teach a score of sentences.

A document is a bag of sentences.  A sentence's probability is logistic in the sum of its words' weights, and a
document is toxic unless all its sentences are harmless (noisy-or): 1 - (1 - p1) * (1 - p2) * ...  Only documents
are labelled; the likelihood of their labels under the noisy-or lets the sentences that explain a label take it up,
while every sentence of a harmless document counts as harmless.  The same weights then locate the sentences.

Sentences end at ``.``, ``!``, ``?`` or a line break, and after ``WORDS`` words in any case; words are runs of letters,
lower-cased, and count once a sentence.  Words have a weight if the labels speak for them: a log-likelihood ratio of
at least ``SUPPORT`` that toxic texts hold them more often.  Weights start at, and are drawn to, the log-odds of texts.

Bounds, parameters all: at most ``LABELLED`` labelled texts of at most ``LONGEST`` code points, half of each class,
different from each other and of smallest hash, weighted to the classes' shares, reach the driver as words.
Every row's whole text is scored.

Null and empty texts have no sentence and score 0.  A doc_id labelled both ways counts as toxic; other labels than 0
and 1 are ignored, and so are labels of null doc_ids; rows of a repeated doc_id share its label.  With fewer than two
labelled texts of a class nothing can be learned and all scores are 0.  Rows map one to one; an empty table
gives none; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import pin, unpin

LABELLED, LONGEST, WORDS = 6000, 20_000, 32
SUPPORT, STEPS, RATE, RIDGE, START = 20.0, 400, 0.1, 0.02, -6.0
TOXIC_FROM, LOCATED_FROM = 0.7, 0.5
#: Words whose weights a task remembers.
CACHE = 500_000
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """start, end (code points) and words of every sentence; sentences without words are left out."""
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m[0])
        if len(words) <= WORDS:
            if words:
                yield m.start(), m.end(), words
            continue
        found = [(x.start(), x.end()) for x in _WORD.finditer(text, m.start(), m.end())]
        for k in range(0, len(words), WORDS):
            part = found[k : k + WORDS]
            yield part[0][0], part[-1][1], words[k : k + WORDS]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def reader(self):  # noqa: ANN201
        """A function from a sentence's words to its log-odds."""
        known: dict[str, float] = {}

        def odds(words: list[str]) -> float:
            if len(known) > CACHE:
                known.clear()
            held = set()
            for w in words:
                x = known.get(w)
                if x is None:
                    x = known[w] = self.weights.get(w.lower(), 0.0)
                if x:
                    held.add(w.lower())
            return self.bias + sum(self.weights[w] for w in sorted(held)) if held else self.bias

        return odds


def softplus(x: float) -> float:
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def supported(word: np.ndarray, bag: np.ndarray, y: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words (0 to words-1) the labels speak for, and the log-odds of texts that hold them.

    ``word`` and ``bag`` are the words of all bags, one after the other, and whose they are.
    """
    pair = np.unique(word.astype(np.int64) * len(y) + bag)
    word, label = pair // len(y), y[pair % len(y)]
    bad, good = np.bincount(word, label, words), np.bincount(word, 1 - label, words)
    n_bad, n_good = float(y.sum()), float(len(y) - y.sum())
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))
    held = (bad + good) / len(y)
    ratio = 2 * (part(bad, held * n_bad) + part(good, held * n_good) + part(n_bad - bad, (1 - held) * n_bad) + part(n_good - good, (1 - held) * n_good))
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return (ratio >= SUPPORT) & (bad * n_good > good * n_bad), odds


def fit(word: np.ndarray, owner: np.ndarray, n: int, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the words and the bias under which the labels of bags are likeliest, by gradient steps of adapted size.

    ``owner`` has the sentence (of n) of each word, none twice in one; ``bag`` where each bag's sentences begin, one at least.
    """
    held = np.repeat(np.arange(len(bag)), np.diff(bag, append=n))
    w = np.append(prior, START)  # the bias last
    first, second = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.mean()
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, w[word], n) + w[-1]
        total = np.add.reduceat(np.logaddexp(0, z), bag)  # minus the log of the chance that all are harmless
        slope = weight * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        dz = slope[held] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.append(np.bincount(word, dz[owner], len(prior)) + RIDGE * (w[:-1] - prior), dz.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad**2 - second)
        w -= RATE * min(1.0, 2 * (1 - step / STEPS)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """A model of the rows (of doc_id) where ``learn`` holds; None if a class has fewer than two texts."""
    docs = _rows(docs)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(learn)
    named = named.groupBy("doc_id").agg(F.max("y").alias("y"))
    sized = docs.where(F.length("text").between(1, LONGEST)).select("doc_id", F.xxhash64("text").alias("key"))
    texts = pin(sized.join(named, "doc_id").groupBy("key").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id")))
    count = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [r for y in (0, 1) for r in texts.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(LABELLED // 2).collect()]
    unpin(texts)
    if min(count.get(0, 0), count.get(1, 0)) < 2:
        return None
    label = {r["key"]: r["y"] for r in chosen}
    listed = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": [r["doc_id"] for r in chosen], "key": list(label)})))  # at most LABELLED

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [[sorted({w.lower() for w in words}) for _, _, words in sentences(text)] for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(bags, pa.list_(pa.list_(pa.string())))], ["key", "bag"])

    of = docs.where(F.length("text") <= LONGEST).withColumn("key", F.xxhash64("text")).join(listed, ["doc_id", "key"]).select("key", "text")
    found = of.mapInArrow(read, "key long, bag array<array<string>>").dropDuplicates(["key"]).where(F.size("bag") > 0).toArrow().sort_by("key")
    y = np.array([label[k] for k in found.column("key").to_pylist()], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    bags = found.column("bag").combine_chunks()
    inner = bags.flatten()
    coded = inner.flatten().dictionary_encode()
    begin, end = (x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() for x in (bags, inner))
    word, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(inner)), np.diff(end))
    good, odds = supported(word, np.repeat(np.arange(len(bags)), np.diff(end[begin])), y, len(coded.dictionary))
    number = np.cumsum(good) - 1
    keep = good[word]
    share = [max(1, int((y == c).sum())) / count[c] for c in (0, 1)]
    weights, bias = fit(number[word[keep]], owner[keep], len(inner), begin[:-1], y, np.where(y > 0, 1 / share[1], 1 / share[0]), odds[good])
    return Model(dict(zip(coded.dictionary.filter(pa.array(good)).to_pylist(), weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and, where that is TOXIC_FROM or more, the offending sentences: start and end in
    code points, text and score, all of LOCATED_FROM or more and the worst in any case."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of LABELLED texts at most

    def judge(text: str | None, odds) -> tuple[float, list[dict]]:  # noqa: ANN001
        if not text or odds is None:
            return 0.0, []
        parts = [(odds(words), start, end) for start, end, words in sentences(text)]
        found = -expm1(-sum(softplus(z) for z, _, _ in parts))
        if found < TOXIC_FROM:
            return found, []
        least = min(0.0, max(z for z, _, _ in parts))  # log-odds of LOCATED_FROM
        return found, [{"start": s, "end": e, "text": text[s:e], "score": 1 / (1 + exp(-z))} for z, s, e in parts if z >= least]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value.reader() if shared.value else None
        for b in batches:
            found = [judge(text, odds) for text in b.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], kind)], ["doc_id", "score", "sentences"])

    return _rows(docs).mapInArrow(each, "doc_id long, score double, sentences array<struct<start:long,end:long,text:string,score:double>>")


def held_out(parts: int = 3, part: int = 1) -> Column:
    """Whether the doc_id's text form hashes to the part that is not learned from; null: no."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and sentences of every row."""
    found = score(docs, train(docs, labels, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "sentences")
