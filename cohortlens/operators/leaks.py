"""Leak scan: do files hold any of a list of values, in the forms that serialisers and transports give them?

All forms of all needles are one Aho-Corasick automaton, which is sent to the tasks after the needles were counted.
Files are read by byte ranges; the automaton runs over a range as a stream, a batch of lines at a time with the last
bytes of the batch before, and what crosses the border of two ranges is found in a small table of their edges.  So a
needle is found wherever it lies, line breaks inside it included, and no task holds more than a batch.

Forms of a needle: its UTF-8 bytes, JSON-escaped (ASCII and UTF-8), percent-encoded (``%20`` and ``+``), and base64
(both alphabets) at the three byte alignments, without the characters that depend on the neighbouring bytes.  Needles
of ``LONG`` characters or more match in any case but in base64; shorter ones, and base64, match as they are.  A case
changed by more than one character, as of ß and SS, is not found.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib.parse import quote, quote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONG = 6
#: Bytes of all needles together, at most: the automaton has some nine forms of each.
NEEDLE_BYTES = 4 << 20


def forms(needle: str) -> dict[str, bytes]:
    """The byte strings that stand for the needle, by form."""
    raw = needle.encode()
    out = {
        "utf8": raw,
        "json_ascii": json.dumps(needle)[1:-1].encode(),
        "json_utf8": json.dumps(needle, ensure_ascii=False)[1:-1].encode(),
        "percent": quote(needle, safe="").encode(),
        "percent_plus": quote_plus(needle, safe="").encode(),
    }
    for before in range(3):  # bytes of a group of three that lie before the needle
        text = base64.b64encode(bytes(before) + raw)
        first = -(-before * 4 // 3)  # characters that hold bits of those
        last = (before + len(raw)) * 8 // 6  # characters whose bits all are known
        if last - first >= 4:
            out[f"base64_{before}"] = text[first:last]
            out[f"base64url_{before}"] = text[first:last].replace(b"+", b"-").replace(b"/", b"_")
    return out


class Scanner:
    """The automata over exact and over case-folded bytes, made where they are used."""

    def __init__(self, needles: dict[str, str]):
        self.needles = needles
        self.exact: dict[bytes, list[tuple[str, str]]] = {}
        self.folded: dict[bytes, list[tuple[str, str]]] = {}
        for name, needle in needles.items():
            for form, text in forms(needle).items() if needle else ():
                if len(needle) < LONG or form.startswith("base64"):
                    self.exact.setdefault(text, []).append((name, form))
                    continue
                # bytes are folded over A-Z alone, so other letters are looked for in both cases
                for spelt in {forms(x)[form].lower() for x in (needle, needle.lower(), needle.upper())}:
                    self.folded.setdefault(spelt, []).append((name, form))
        self.longest = max(map(len, [*self.exact, *self.folded]), default=0)
        self.machines: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "machines": None}

    def hits(self, data: bytes, after: int = 0, upto: int | None = None) -> list[tuple[str, str]]:
        """(needle, form) of every occurrence that ends beyond ``after`` and begins before ``upto``."""
        import ahocorasick

        if self.machines is None:
            self.machines = []
            for table in (self.exact, self.folded):
                machine = ahocorasick.Automaton()
                for text, names in table.items():
                    machine.add_word(text.decode("latin-1"), (len(text), names))
                machine.make_automaton()
                self.machines.append((machine, bool(table)))
        found = []
        for (machine, some), text in zip(self.machines, (data, data.lower()), strict=True):
            for end, (size, names) in machine.iter(text.decode("latin-1")) if some else ():
                if end + 1 > after and (upto is None or end + 1 - size < upto):
                    found += names
        return found


def scan(spark: SparkSession, path: str, needles: DataFrame) -> DataFrame:
    """payload (file), needle, form and hits of every needle (columns needle: its name, text) found below ``path``."""
    listed = needles.where("length(text) > 0").select(F.col("needle").cast("string"), F.col("text").cast("string"))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > NEEDLE_BYTES:
        raise ValueError(f"needles of {size} bytes, over {NEEDLE_BYTES}")
    scanner = Scanner({r["needle"]: r["text"] for r in listed.collect()})
    shared = spark.sparkContext.broadcast(scanner)  # NEEDLE_BYTES and their forms
    keep = max(0, scanner.longest - 1)
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("payload"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key, head, tail = shared.value, None, b"", b""

        def rows(payload: str, start: int, found: list[tuple[str, str]], edges: tuple[bytes, bytes] | None) -> pa.RecordBatch:
            counted: dict[tuple[str, str], int] = {}
            for x in found:
                counted[x] = counted.get(x, 0) + 1
            n = len(counted) + (edges is not None)
            none = [None] * len(counted)
            last = lambda x: [x] if edges is not None else []
            columns = {
                "payload": pa.array([payload] * n, pa.string()), "start": pa.array([start] * n, pa.int64()),
                "needle": pa.array([x[0] for x in counted] + last(None), pa.string()), "form": pa.array([x[1] for x in counted] + last(None), pa.string()),
                "hits": pa.array([*counted.values(), *last(None)], pa.int64()),
                "head": pa.array(none + (last(edges[0]) if edges else []), pa.binary()), "tail": pa.array(none + (last(edges[1]) if edges else []), pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            payloads, starts, texts = (b.column(k).to_pylist() for k in range(3))
            at = 0
            for k in range(1, len(texts) + 1):
                if k < len(texts) and starts[k] == starts[at] and payloads[k] == payloads[at]:
                    continue
                now = (payloads[at], starts[at])
                if now != key:
                    if key:
                        yield rows(*key, [], (head, tail))
                    key, head, tail = now, b"", b""
                data = b"\n".join(texts[at:k]) + b"\n"
                head = (head + data[:keep])[:keep] if len(head) < keep else head
                found = s.hits(tail + data, len(tail))
                tail = (tail + data)[-keep:] if keep else b""
                yield rows(*key, found, None)
                at = k
        if key:
            yield rows(*key, [], (head, tail))

    out = lines.mapInArrow(read, "payload string, start long, needle string, form string, hits long, head binary, tail binary")
    inner = out.where("needle is not null").select("payload", "needle", "form", "hits")
    edges = out.where("needle is null").select("payload", "start", "head", "tail")
    order = Window.partitionBy("payload").orderBy("start")
    # ranges shorter than a needle are rare; as many before as could matter are looked at
    least = edges.withColumn("last", F.lead("start").over(order).isNull()).where(~F.col("last")).agg(F.min(F.octet_length("tail"))).first()[0]
    reach = max(1, -(-keep // max(1, least or keep or 1)))
    before = F.collect_list("tail").over(order.rowsBetween(-reach, -1))
    crossing = edges.select("payload", before.alias("before"), "head").where(F.size("before") > 0)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            found: list[tuple] = []
            for payload, before, head in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                left = b"".join(before)[-keep:] if keep else b""
                found += [(payload, *x) for x in s.hits(left + head, len(left), len(left))]
            yield pa.RecordBatch.from_pydict({"payload": pa.array([x[0] for x in found], pa.string()), "needle": pa.array([x[1] for x in found], pa.string()), "form": pa.array([x[2] for x in found], pa.string()), "hits": pa.array([1] * len(found), pa.int64())})

    both = inner.unionByName(crossing.mapInArrow(cross, "payload string, needle string, form string, hits long"))
    return both.groupBy("payload", "needle", "form").agg(F.sum("hits").alias("hits"))
