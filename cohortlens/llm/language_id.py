"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text.  A document is parsed into the longest
phrases that occur in that sample; the language that needs the fewest phrases, weighted by the logarithm of its
sample's length, wins.  Texts are lower-cased, every run of characters other than letters is one space, and the
automata read UTF-8 bytes, so any script keeps all its letters.

The parse of a text is one run of a finite automaton.  Long texts are cut into lanes of ``LANE`` bytes that numpy
reads side by side from a guessed state; lanes whose state at entry turns out otherwise are read again until all
agree, so the phrases are exactly those of the whole text.

A language is learned from at most ``SAMPLES`` labelled documents, preferring (in hash order) ones of at most
``FITTING`` code points, which are taken whole; of a text beyond ``LONGEST`` a stretch of that length at a hashed place
is learned.  All languages together learn from ``LEARNED`` code points at most (some 1.2 KB of memory each), their texts
being cut to equal shares of it, and more than ``LANGUAGES`` of them are an error.  Null texts and texts without a letter get ``und``
and score 0.  Ties go to the smaller name.  With no labelled text every document is ``und``; with one language
its score is 1.  Rows map one to one, repeated ones and null doc_ids too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES, FITTING, LANE = 16, 1000, 4096
LONGEST, LEARNED, LANGUAGES = 2000, 400_000, 250
SPACE = 32
#: Positions gathered at once, and bytes that numpy parses at once.
STRETCH, AT_ONCE = 64, 4_000_000
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def samples(docs: DataFrame, usable: Column) -> dict[str, list[str]]:
    """Texts of a few documents per language; hot languages are pre-aggregated like any other."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc_id", F.lit(7))
    text = F.col("text").cast("string")
    over = F.greatest(F.char_length(text) - FITTING, F.lit(0))
    size = F.char_length(text)
    place = F.pmod(key, F.greatest(size - LONGEST + 1, F.lit(1)).cast("long")).cast("int")
    learned = F.when(size <= LONGEST, text).otherwise(text.substr(place + 1, F.lit(LONGEST)))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.pmod(key, F.lit(SAMPLES)).alias("slot"), F.struct(over.alias("over"), key.alias("key"), F.sha2(text, 256).alias("of")).alias("rank"), learned.alias("text"))
    chosen = rows.groupBy("lang", "slot").agg(F.min_by("text", "rank").alias("text"))
    out: dict[str, list[str]] = {}
    for r in chosen.limit(SAMPLES * LANGUAGES + 1).orderBy("lang", "slot").collect():  # SAMPLES texts a language, none beyond LONGEST
        out.setdefault(r["lang"], []).append(r["text"])
    if len(out) > LANGUAGES or sum(map(len, out.values())) > SAMPLES * LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = LEARNED // (SAMPLES * max(1, len(out)))
    return {lang: [text[:share] for text in texts] for lang, texts in out.items()}


def letters(text: str) -> np.ndarray:
    """UTF-8 bytes of the text in lower case, each run of other characters than letters one space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(SPACE))[keep]
    return np.frombuffer(points.tobytes().decode("utf-32-le").lower().encode("utf-8"), np.uint8)


class Automata:
    """The languages' suffix automata as one table, phrase starts included."""

    _kept: dict[tuple, Automata] = {}

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        coded = [letters("\n".join(texts[x])) for x in self.names]
        seen = np.unique(np.concatenate([*coded, np.empty(0, np.uint8)]))
        #: 0 pads, the last code stands for bytes that no sample has.
        self.width = len(seen) + 2
        self.code = np.full(256, self.width - 1, np.uint8)
        self.code[seen] = np.arange(len(seen)) + 1
        self.weight = np.array([np.log2(max(2, len(x))) for x in coded])
        tables, self.root = [], np.zeros((len(coded), 1), np.int64)
        at = 0
        for k, x in enumerate(coded):
            self.root[k] = at
            table = _table(self.code[x].tolist(), self.width)
            tables.append(table + 2 * at)
            at += len(table)
        self.table = np.concatenate([*tables, np.empty(0, np.int64)])

    @classmethod
    def of(cls, texts: dict[str, list[str]]) -> Automata:
        key = tuple((k, *v) for k, v in sorted(texts.items()))
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(texts)
        return cls._kept[key]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows, from ``letters``) in each language (columns)."""
        lanes = np.array([max(1, -(-len(x) // LANE)) for x in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.cumsum(lanes) - lanes
        within = np.arange(len(owner)) - first[owner]
        sizes = np.array([len(x) for x in texts], np.int64)
        start = (np.cumsum(sizes) - sizes)[owner] + within * LANE
        length = np.minimum(LANE, sizes[owner] - within * LANE)
        flat = self.code[np.concatenate([*texts, np.zeros(STRETCH, np.uint8)])]
        entry = np.repeat(self.root, len(owner), axis=1)
        count, leave = np.zeros(entry.shape, np.int64), entry.copy()
        again = np.arange(len(owner))
        while len(again):
            count[:, again], leave[:, again] = self._read(flat, start[again], length[again], entry[:, again])
            true = np.repeat(self.root, len(owner), axis=1)
            true[:, 1:][:, within[1:] > 0] = leave[:, :-1][:, within[1:] > 0]
            again = np.flatnonzero((true != entry).any(axis=0))
            entry = true
        return np.add.reduceat(count, first, axis=1).T if len(texts) else np.zeros((0, len(self.names)), np.int64)

    def _read(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each lane and the state after it, from the states at entry."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, count = entry[:, order].copy(), np.zeros(entry.shape, np.int64)
        for at in range(0, int(length[0]) if len(length) else 0, STRETCH):
            n = int(np.searchsorted(-length, -at, "left"))
            here = at + np.arange(STRETCH)
            codes = np.where(here < length[:n, None], flat[np.minimum(start[:n, None] + here, len(flat) - 1)], 0).T.astype(np.int64)
            live, counted = state[:, :n], count[:, :n]
            for k, row in enumerate(codes):
                m = int(np.searchsorted(-length[:n], -(at + k), "left"))
                if not m:
                    break
                step = self.table[live[:, :m] + row[:m]]
                counted[:, :m] += step & 1
                live[:, :m] = step >> 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[:, back], state[:, back]


def _table(codes: list[int], width: int) -> np.ndarray:
    """The automaton of ``codes``: entry (state, code) is twice the place of the next state's row, plus 1 where a phrase starts."""
    link, length, goto = [-1], [0], [{}]
    last = 0
    for c in codes:
        made = len(link)
        link.append(0)
        length.append(length[last] + 1)
        goto.append({})
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = made
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[made] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                goto.append(dict(goto[q]))
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = twin
                    p = link[p]
                link[q] = link[made] = twin
        last = made
    root = np.ones(width, np.int64)
    for c, q in goto[0].items():
        root[c] = 2 * q * width + 1
    table = np.tile(root, (len(link), 1))
    for s, moves in enumerate(goto):
        if s:
            for c, q in moves.items():
                table[s, c] = 2 * q * width
    return table.reshape(-1)


def predict(docs: DataFrame, texts: dict[str, list[str]], *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred and score, from the text alone."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most SAMPLES texts a language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Automata.of(shared.value)
        for batch in batches:
            coded = [letters(x or "") for x in batch.column("text").to_pylist()]
            names, scores = [], []
            k = 0
            while k < len(coded):
                part, size = [], 0
                while k < len(coded) and (not part or size + len(coded[k]) <= AT_ONCE):
                    part.append(coded[k])
                    size += len(coded[k])
                    k += 1
                cost = model.phrases(part) * model.weight
                for x, row in zip(part, cost, strict=True):
                    if not model.names or not (x != SPACE).any():
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(row.argmin())
                    second = np.delete(row, best).min() if len(row) > 1 else np.inf
                    names.append(model.names[best])
                    scores.append(float(1 - row[best] / second))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(judge, f"{kept}, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 5) -> DataFrame:
    """Learns from rows whose crc32 of the doc_id as text leaves a remainder, predicts all: doc_id, held_out, lang_pred, score."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == 0
    held = F.coalesce(held, F.lit(False))
    return predict(docs, samples(docs, ~held & F.col("doc_id").isNotNull()), held.alias("held_out"))
