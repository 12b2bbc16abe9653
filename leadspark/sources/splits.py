"""Records of large text files in many tasks, where a record may go on over separators: CSV with quoted line breaks, and the objects of one JSON array.

Spark's text reader cuts a file into pieces at a separator (a line break, or `}`), and large files into byte ranges. Where
records begin depends on what came before: whether a quote is open, and in JSON how deep brackets are. Each range is summed
up for each state it may begin in; prefix sums over the table of ranges (one row each) give the state and the number of
records that each range begins with; a second pass cuts the records. Only records over the border of two ranges are
shuffled and joined, so a file takes as many tasks as it has ranges, and the order of the file is known by number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.DOTALL)
MARKS = re.compile(r'"(?:\\.|[^"\\])*"|[\[\]{}]', re.DOTALL)
RECORD = "file string, number long, place long, whole boolean, text string"


class Lines:
    """CSV: pieces are lines; a record ends with a line after which no quote is open. Blank lines between records are none."""

    separator, start = "\n", (False, 0)

    def step(self, piece: str, state: tuple[bool, int]) -> tuple[bool, int]:
        return state[0] ^ bool(piece.count('"') & 1), 0

    def ends(self, piece: str, before: tuple[bool, int], after: tuple[bool, int]) -> bool:
        return not after[0] and (before[0] or not (piece == "" or piece.isspace()))

    def fresh(self, state: tuple[bool, int]) -> bool:
        return not state[0]

    def record(self, text: str, number: int) -> str | None:
        text = text.removesuffix("\n").removesuffix("\r").lstrip("\r\n")
        return text.removeprefix("\ufeff") if number == 0 else text


class Objects:
    """One JSON array: pieces end with `}`; an object ends where brackets are one deep again, outside of strings."""

    separator, start = "}", (False, 0)

    def step(self, piece: str, state: tuple[bool, int]) -> tuple[bool, int]:
        parts = ESCAPED.sub("", piece).split('"')
        inside = state[0] ^ bool(len(parts) - 1 & 1)
        outer = "".join(parts[state[0]::2])
        depth = sum(outer.count(c) for c in "[{") - sum(outer.count(c) for c in "]}")
        return inside, state[1] + depth - (not inside)

    def ends(self, piece: str, before: tuple[bool, int], after: tuple[bool, int]) -> bool:
        return after == (False, 1)

    def fresh(self, state: tuple[bool, int]) -> bool:
        return not state[0] and state[1] <= 1

    def record(self, text: str, number: int) -> str | None:
        """From the first bracket of an object that is one deep: other items of the array are left out."""
        depth = 0 if number == 0 else 1
        for m in MARKS.finditer(text):
            if m[0] == "{" and depth == 1:
                return text[m.start():]
            depth += (m[0] in "[{") - (m[0] in "]}")
        return None


def _ranges(batches):
    """Pieces with the file and range that they are in."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("value", "file", "begin")), strict=True)


def _summed(kind):
    """For each range and each state of quotes that it may begin with: the state after it, the change of depth, and how many pieces end at which relative depth, were they to end a record there."""
    def run(batches):
        import pyarrow as pa

        def row(key, states, counts):
            data = [[key[0]], [key[1]], *([int(states[h][0])] for h in (0, 1)), *([states[h][1]] for h in (0, 1)), *([list(counts[h].items())] for h in (0, 1))]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.map_(pa.int64(), pa.int64())] * 2)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, kinds, strict=True)], ["file", "begin", "s0", "s1", "d0", "d1", "n0", "n1"])

        key = None
        for piece, file, begin in _ranges(batches):
            if (file, begin) != key:
                if key:
                    yield row(key, states, counts)
                key, states, counts = (file, begin), [(False, 0), (True, 0)], [{}, {}]
            for h in (0, 1):
                before, states[h] = states[h], kind.step(piece, states[h])
                # at which depth must the range begin for a record to end here? with a change of d, at 1 - d in JSON and at 0 in CSV
                need = 1 - states[h][1] if isinstance(kind, Objects) else 0
                if kind.ends(piece, before, (states[h][0], 1 if isinstance(kind, Objects) else 0)):
                    counts[h][need] = counts[h].get(need, 0) + 1
        if key:
            yield row(key, states, counts)
    return run


def _cut(kind, starts):
    """Records, and parts of records over a border of ranges."""
    def run(batches):
        import pyarrow as pa

        kinds, names = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), [c.split()[0] for c in RECORD.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        key, held, rows, size = None, [], [], 0
        for piece, file, begin in _ranges(batches):
            if (file, begin) != key:
                if held:
                    rows.append((*key_of, key[1], False, "".join(held)))
                key = (file, begin)
                state, number = starts.value[key]
                held, whole = [], kind.fresh(state)
            before, state = state, kind.step(piece, state)
            held.append(piece + kind.separator)
            key_of = (file, number)
            if kind.ends(piece, before, state):
                text = "".join(held)
                size += len(text)
                rows.append((file, number, begin, whole, kind.record(text, number) if whole else text))
                held, whole, number = [], True, number + 1
                if len(rows) >= 10_000 or size > 8_000_000:
                    yield table(rows)
                    rows, size = [], 0
        if held:
            rows.append((*key_of, key[1], False, "".join(held)))
        if rows:
            yield table(rows)
    return run


def _whole(kind):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [kind.record(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("number").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("number"), pa.array(texts, pa.string())], ["file", "number", "text"])
    return run


def records(spark: SparkSession, path: str, kind: Lines | Objects) -> DataFrame:
    """(file, number, text): the records of files under path, numbered 0, 1, ... in each file in its order.

    A record that no later piece ends (an open quote at the end of the file) is a record of its own. Ranges are those of
    spark.sql.files.maxPartitionBytes; their table, a row for each, goes to the driver and back: 100 TB in ranges of 128
    MB have 800 000. A record is as large as its reader must hold.
    """
    pieces = spark.read.option("lineSep", kind.separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    sums = pieces.mapInArrow(_summed(kind), "file string, begin long, s0 int, s1 int, d0 long, d1 long, n0 map<bigint,bigint>, n1 map<bigint,bigint>").collect()
    starts, last = {}, None
    for r in sorted(sums, key=lambda r: (r.file, r.begin)):
        if r.file != last:
            last, state, number = r.file, kind.start, 0
        starts[(r.file, r.begin)] = (state, number)
        h = int(state[0])
        number += (r.n0, r.n1)[h].get(state[1], 0)
        state = bool((r.s0, r.s1)[h]), state[1] + (r.d0, r.d1)[h]
    cut = pieces.mapInArrow(_cut(kind, spark.sparkContext.broadcast(starts)), RECORD)
    parts = cut.where("not whole").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"))
    return cut.where("whole").select("file", "number", "text").unionByName(parts.mapInArrow(_whole(kind), "file string, number long, text string")).where("text is not null")
