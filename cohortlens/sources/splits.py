"""Quoted CSV and whole-document JSON read in parallel: byte ranges are parsed apart and their states composed.

A file is cut at byte ranges by Spark's text source, with the line feed (CSV) or the closing brace (JSON) as the end
of a piece.  Whether a range begins inside a quoted field or string depends on all ranges before it, so:

1. Every range is read once from both possible beginnings; it yields where each would end, and by how much it
   opens or closes brackets.  That is one short row a range.
2. The rows of a file are composed in the order of the ranges, which gives each range its true beginning.  Their
   number, not the data's size, is what the driver sees (as it sees the list of ranges anyway); more than
   ``MOST_RANGES`` are an error that asks for larger ones.
3. Every range is read again from its true beginning.  Records that lie within a range are parsed there, a batch at a
   time; the pieces of a record that crosses ranges, at most one a range's end, meet in a small shuffle.

Rows have no order across ranges.  Compressed files are one range, as their bytes cannot be entered in the middle.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RANGES = 1_000_000
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_STRING = re.compile(r'"(?:[^"\\]|\\[\s\S])*"')
_STRING_END = re.compile(r'(?:[^"\\]|\\[\s\S])*"')
_FIELD_END = re.compile(r"[,\r]")


def csv_line(line: str, inside: bool) -> tuple[bool, int]:
    """Whether the next line begins inside a quoted field; a quote opens one only at a field's beginning."""
    at = 0
    while True:
        if not inside:
            if '"' not in line[at:]:
                return False, 0
            inside = line[at : at + 1] == '"'
            at += inside
        if inside:
            m = _QUOTED.match(line, at)
            if not m:
                return True, 0
            at, inside = m.end(), False
        m = _FIELD_END.search(line, at)
        if not m:
            return False, 0
        at = m.end()


def json_piece(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether the next piece begins inside a string, and the brackets opened less those closed, the piece's own end included."""
    if inside:
        m = _STRING_END.match(piece)
        if not m:
            return True, 0
        piece = piece[m.end() :]
    rest = _STRING.sub("", piece)
    cut = rest.find('"')
    inside = cut >= 0
    rest = rest[:cut] if inside else rest
    return inside, rest.count("{") + rest.count("[") - rest.count("}") - rest.count("]") - (not inside)


@dataclass(frozen=True)
class Format:
    end: str  # what ends a piece
    plain: str  # a piece with no match leaves state and depth alone, wherever it begins
    calm: str  # a piece with a match is a whole record where it begins outside
    fold: Callable[[str, bool], tuple[bool, int]]
    depth: int  # of brackets at the file's beginning; records are whole at depth 1
    parse: Callable[[list[str]], list[tuple[list[str], list[str | None]]]]  # texts of records -> keys (none: []) and values


def parse_csv(records: list[str]) -> list[tuple[list[str], list[str | None]]]:
    csv.field_size_limit(2**31 - 1)
    return [([], row) for row in csv.reader(io.StringIO("\n".join(records), newline=""))]


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "1" if value else "0"
    return repr(value) if isinstance(value, (int, float)) else json.dumps(value, ensure_ascii=False)


def parse_json(records: list[str]) -> list[tuple[list[str], list[str | None]]]:
    out = []
    for text in records:
        text = text.lstrip("\ufeff \t\r\n[,")
        if text.startswith("{"):
            row = json.loads(text + "}")
            out.append((list(row), [_text(v) for v in row.values()]))
        elif text and not text.startswith("]"):
            raise ValueError("S04: rows must be objects")
    return out


_FIELD = r'(?:[^",\r]*|"(?:[^"]|"")*")'
CSV = Format("\n", '"|\r.', f"^{_FIELD}(?:,{_FIELD})*\r?$", csv_line, 1, parse_csv)
JSON = Format("}", "", "", json_piece, 0, parse_json)
PLAIN, CALM, OTHER = range(3)


def _pieces(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """file (a hash of its path), start of the range and text, in the order of the file within a range."""
    lines = spark.read.option("lineSep", kind.end).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """(file, start) and the next pieces of that range, batch by batch."""
    for b in batches:
        file, start = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield (int(file[i]), int(start[i])), b.column(2).slice(i, j - i)


def _stretches(texts: pa.Array, kind: Format) -> Iterator[tuple[int, int, int]]:
    """Stretches of plain or of calm pieces, and single others: first, end, which."""
    match = lambda found, pattern: pc.match_substring_regex(found, pattern).to_numpy(zero_copy_only=False)
    which = np.where(match(texts, kind.plain), OTHER, PLAIN)
    marked = np.flatnonzero(which)
    if kind.calm and len(marked):
        which[marked[match(texts.take(pa.array(marked)), kind.calm)]] = CALM
    cuts = np.flatnonzero((which[1:] != which[:-1]) | (which[1:] == OTHER)) + 1
    for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield at, to, int(which[at])


def summaries(pieces: DataFrame, kind: Format) -> DataFrame:
    """A row a range: for a beginning outside (0) and inside (1) a string, end, brackets opened, and the fewest open at a piece's beginning."""
    fold = kind.fold

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for now, texts in _by_range(batches):
            if now != key:
                if key:
                    yield row(key, held)
                key, held = now, [[False, 0, None], [True, 0, None]]
            for at, to, which in _stretches(texts, kind):
                lines, known = None, {}  # both beginnings soon agree where a text is read: no line twice from one state
                for state in held:
                    if not state[0]:
                        state[2] = state[1] if state[2] is None else min(state[2], state[1])
                    if which == PLAIN or which == CALM and not state[0]:
                        continue
                    lines = texts.slice(at, to - at).to_pylist() if lines is None else lines
                    for text in lines:
                        if which == CALM and not state[0]:
                            state[2] = state[1] if state[2] is None else min(state[2], state[1])
                            break
                        if which == CALM or state[0] not in known:
                            known[state[0]] = fold(text, state[0])
                        state[0], more = known[state[0]]
                        state[1] += more
        if key:
            yield row(key, held)

    def row(key: tuple[int, int], held: list) -> pa.RecordBatch:
        ends, deltas, lows = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), *(pa.array([x], pa.bool_()) for x in ends), *(pa.array([x], pa.int64()) for x in (*deltas, *lows))], ["file", "start", "end0", "end1", "delta0", "delta1", "low0", "low1"])

    return pieces.mapInArrow(each, "file long, start long, end0 boolean, end1 boolean, delta0 long, delta1 long, low0 long, low1 long")


def beginnings(found: list, depth: int) -> tuple[dict[tuple[int, int], tuple[bool, int, int]], bool]:
    """Of each range its true state (inside, depth) and the range in which a record open at its beginning began;
    and whether any record is open where a range or a file ends."""
    out, crossed = {}, False
    file, inside, at, owner = None, False, depth, 0
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, at, owner = r["file"], False, depth, r["start"]
        out[r["file"], r["start"]] = (inside, at, owner)
        low = r["low1"] if inside else r["low0"]
        if low is not None and at + low <= 1:
            owner = r["start"]
        inside, at = (r["end1"], at + r["delta1"]) if inside else (r["end0"], at + r["delta0"])
        crossed |= inside or at > 1
    return out, crossed


def records(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """file, start and number (which order a file's records), first (the file's first record), keys and values."""
    pieces = _pieces(spark, path, kind)
    listed = summaries(pieces, kind).limit(MOST_RANGES + 1).collect()
    if len(listed) > MOST_RANGES:
        raise ValueError(f"over {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
    begin, crossed = beginnings(listed, kind.depth)
    shared = spark.sparkContext.broadcast(begin)  # at most MOST_RANGES entries
    fold, parse, end = kind.fold, kind.parse, kind.end
    strings = pa.list_(pa.string())

    def batch(key: tuple[int, int], owner: int, number: int, first: int, plain: pa.Array, whole: list[str], rest: list[str]) -> pa.RecordBatch:
        rows = parse(whole) if whole else []
        parts = len(plain), len(rows), len(rest)
        n = sum(parts)
        columns = {
            "file": pa.array(np.full(n, key[0])), "start": pa.array(np.full(n, key[1])), "number": pa.array(np.arange(number, number + n)), "first": pa.array(np.arange(n) == first),
            "keys": pa.array([None] * parts[0] + [r[0] for r in rows] + [None] * parts[2], strings), "values": pa.array([None] * parts[0] + [r[1] for r in rows] + [None] * parts[2], strings),
            "text": pa.concat_arrays([plain, pa.nulls(parts[1] + parts[2], pa.string())]), "owner": pa.array(np.full(n, owner)), "piece": pa.array([None] * (parts[0] + parts[1]) + rest, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, none = None, [], pa.array([], pa.string())
        for now, texts in _by_range(batches):
            if now != key:
                if opened:
                    yield batch(key, key[1], number, 0 if first else -1, none, [], [end.join(opened)])
                key, opened, number, first = now, [], 0, now[1] == 0
                inside, depth, owner = shared.value[key]
                own = False
            plain, whole, rest, leads = [], [], [], None
            for at, to, which in _stretches(texts, kind):
                while at < to:
                    own |= not inside and depth <= 1  # the open record began in this range
                    if which == PLAIN and not inside:
                        plain.append(np.arange(at, to))
                        leads, at = leads or "plain", to
                        continue
                    if which == CALM and not inside:
                        whole += texts.slice(at, to - at).to_pylist()
                        leads, at = leads or "whole", to
                        continue
                    if which == PLAIN:
                        opened += texts.slice(at, to - at).to_pylist()
                        break
                    opened.append(texts[at].as_py())
                    at += 1
                    inside, more = fold(opened[-1], inside)
                    depth += more
                    if not inside and depth <= 1:
                        (whole if own else rest).append(end.join(opened))
                        leads = leads or ("whole" if own else None)
                        opened = []
            if opened and not own:  # no record of this range: let go of the text
                rest.append(end.join(opened))
                opened = []
            if plain or whole or rest:
                lines = texts.take(pa.array(np.concatenate(plain))) if plain else none
                found = batch(key, owner, number, (len(lines) if leads == "whole" else 0) if first and leads else -1, lines, whole, rest)
                number, first = number + found.num_rows, first and not leads
                yield found
        if opened:
            yield batch(key, key[1], number, 0 if first else -1, none, [], [end.join(opened)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse([text]) for text in b.column("piece").to_pylist()]
            of = pa.array([k for k, found in enumerate(rows) for _ in found], pa.int64())
            flat = [r for found in rows for r in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ("file", "start", "number", "first")), *(pa.array([r[k] for r in flat], strings) for k in (0, 1))], ["file", "start", "number", "first", "keys", "values"])

    shown = "file long, start long, number long, first boolean, keys array<string>, values array<string>"
    out = pieces.mapInArrow(read, shown + ", text string, owner long, piece string")
    values = F.when(F.col("text").isNotNull(), F.split(F.regexp_replace("text", "\r$", ""), ",", -1)).otherwise(F.col("values"))
    lying = out.where("piece is null").select("file", "start", "number", "first", "keys", values.alias("values"))
    if not crossed:
        return lying
    parts = out.where("piece is not null").groupBy("file", "owner").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "number", "piece"))).alias("parts"))
    text = F.concat_ws(end, F.transform("parts", lambda x: x["piece"]))
    parts = parts.select("file", F.col("owner").alias("start"), F.lit(2**62).alias("number"), "first", text.alias("piece"))
    return lying.unionByName(parts.mapInArrow(join, shown))
