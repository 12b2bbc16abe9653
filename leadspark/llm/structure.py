"""Repair of conversation structure by Hirschberg's divide and conquer over four states.

A conversation is right when its role initials read `(s?(ua)+)?`. Edits turn it into such a one at least cost: Keep (0),
Rerole to user or assistant (3), Delete (4, and required for blank and duplicate rows), Insert a user or assistant row
without text (3); a truncated row that stays adds 3. Of equal costs the audit, the string of the edits' initials, that is
least in ASCII order wins.

A row leads from a state to a state (0: start, 1: after s, 2: after u, 3: after a), first by inserts and then by one edit
of its own. A run of rows is summed up by 16 costs and, for each start, the ranks of its ends by their least audits;
audits of equally many rows are never prefixes of each other, so ranks and costs of two runs give those of both. Forward
and backward cost vectors meet in the middle of a run; of the crossings that are optimal the one with the least audit is
taken and both halves are solved alone, so a run needs space for its rows and a few vectors.

On Spark: rows are numbered in order without their texts, dealt into blocks of 1 024 rows and summed up; the sums of blocks
that a conversation has are summed up in the same way until it has one, and crossings are then handed down again. So a
conversation with a third of all rows takes many tasks of bounded memory. Texts are shuffled once, next to their block's
audit, and streamed in order.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import materialize
from leadspark.scratch import ranked

BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, NEVER = range(4), 1 << 60
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
#: The state that an inserted or reroled row leads to, and what is still to be inserted at the end of a conversation.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
MISSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
PACK = struct.Struct("<16q16b")


def after(state: int, initial: str) -> int | None:
    """The state after a kept row with this initial, or None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def _row(initial: int, fault: int) -> tuple:
    """For each start and end: cost, rank among the start's ends, and the least string of edits of a row."""
    out = []
    for p in STATES:
        ends: dict[int, tuple[int, str]] = {}
        state, before, paid = p, "", 0
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if fault not in (1, 2):
                more = TRUNCATED if fault == 3 else 0
                options.append((NEXT[state], REROLE + more, "R"))
                kept = after(state, INITIALS[initial]) if initial < 3 else None
                if kept is not None:
                    options.append((kept, KEEP + more, "K"))
            for q, cost, edit in options:
                ends[q] = min(ends.get(q, (NEVER, "")), (paid + cost, before + edit))
            state, before, paid = NEXT[state], before + "I", paid + INSERT
        order = sorted(ends, key=lambda q: ends[q][1])
        out.append(tuple((ends[q][0], order.index(q), ends[q][1]) if q in ends else (NEVER, 0, "") for q in STATES))
    return tuple(out)


#: What a row does, by 4 * (index of its initial, 3: another) + index of its fault.
ROWS = [_row(c >> 2, c & 3) for c in range(16)]


def forward(items, p: int) -> tuple[list[int], list[int]]:
    """From state p through items: least cost and rank of the least audit for each end."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[p] = 0
    for t in items:
        best = [min((cost[m] + t[m][q][0], rank[m], t[m][q][1]) for m in STATES) for q in STATES]
        places = sorted(b[1:] for b in best if b[0] < NEVER)
        cost = [min(b[0], NEVER) for b in best]
        rank = [places.index(b[1:]) if b[0] < NEVER else 0 for b in best]
    return cost, rank


def backward(items, q: int) -> list[int]:
    """To state q through items: least cost for each start."""
    cost = [NEVER] * 4
    cost[q] = 0
    for t in reversed(items):
        cost = [min(NEVER, min(t[p][m][0] + cost[m] for m in STATES)) for p in STATES]
    return cost


def total(items) -> tuple:
    """What a run of items does as a whole."""
    ways = [forward(items, p) for p in STATES]
    return tuple(tuple((cost[q], rank[q]) for q in STATES) for cost, rank in ways)


def crossings(items, p: int, q: int) -> list[int]:
    """The states after each of items on the cheapest way from p to q with the least audit."""
    if len(items) == 1:
        return [q]
    half = len(items) // 2
    cost, rank = forward(items[:half], p)
    rest = backward(items[half:], q)
    m = min(STATES, key=lambda s: (cost[s] + rest[s], rank[s]))
    return crossings(items[:half], p, m) + crossings(items[half:], m, q)


def last_state(of: tuple) -> int:
    """The best end of a conversation that begins at the start and does `of`."""
    return min(STATES, key=lambda q: (of[START][q][0] + INSERT * len(MISSING[q]), of[START][q][1]))


@lru_cache(100_000)
def audit(codes: bytes, p: int, q: int) -> str:
    """The edits of rows with these codes from state p to state q."""
    items, out, state = [ROWS[c] for c in codes], [], p
    for item, end in zip(items, crossings(items, p, q), strict=True):
        out.append(item[state][end][2])
        state = end
    return "".join(out)


@lru_cache(100_000)
def _alone(codes: bytes) -> str:
    q = last_state(total([ROWS[c] for c in codes]))
    return audit(codes, START, q) + MISSING[q]


def pack(of: tuple) -> bytes:
    return PACK.pack(*(x[0] for row in of for x in row), *(x[1] for row in of for x in row))


def unpack(data: bytes) -> tuple:
    v = PACK.unpack(data)
    return tuple(tuple((v[4 * p + q], v[16 + 4 * p + q]) for q in STATES) for p in STATES)


def _blocks(size: int):
    """Blocks of marks (place * 32 + 4 * initial, + 1 if blank, + 16 if truncated; + 31: the row there is the first of its role and text) to codes, sums and audits of short conversations."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, block, marks in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "marks")), strict=True):
                marks.sort()
                codes, row = bytearray(), 0
                for m in marks:
                    if m & 31 == 31:  # the row before is the first of its role and text
                        codes[-1] = (row & 12) | (3 if row & 16 else 0)
                    else:
                        row = m & 31
                        codes.append((row & 12) | (1 if row & 3 else 2))
                codes = bytes(codes)
                short = block == 0 and len(codes) < size
                rows.append((k, block, codes, None if short else pack(total([ROWS[c] for c in codes])), _alone(codes) if short else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column("at")], ["k", "block", "codes", "sums", "audit", "at"])
    return run


def _sums(batches):
    import pyarrow as pa

    for batch in batches:
        sums = [pack(total([unpack(x["sums"]) for x in sorted(items, key=lambda x: x["block"])])) for items in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("block"), pa.array(sums, pa.binary())], ["k", "block", "sums"])


def _ends(batches):
    """The whole conversations' first and last states."""
    import pyarrow as pa

    for batch in batches:
        q = [last_state(unpack(x)) for x in batch.column("sums").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("block"), pa.array([START] * len(q), pa.int32()), pa.array(q, pa.int32()), pa.array([True] * len(q))], ["k", "block", "p", "q", "last"])


def _down(batches):
    """First and last states of a run's parts."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for k, items, p, q, last in zip(*(batch.column(c).to_pylist() for c in ("k", "items", "p", "q", "last")), strict=True):
            items.sort(key=lambda x: x["block"])
            for i, (item, end) in enumerate(zip(items, crossings([unpack(x["sums"]) for x in items], p, q), strict=True)):
                rows.append((k, item["block"], p, end, last and i == len(items) - 1))
                p = end
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["k", "block", "p", "q", "last"])


def _audits(batches):
    import pyarrow as pa

    for batch in batches:
        out = [audit(codes, p, q) + (MISSING[q] if last else "") for codes, p, q, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "p", "q", "last")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("block"), batch.column("codes"), pa.array(out, pa.string()), batch.column("at")], ["k", "block", "codes", "audit", "at"])


EDITS = "k string, step long, edit string, cost long, fault string, turn long, old_role string, role string, text string"


def _edits(batches):
    """Rows and audits in order to edits; what is held is a batch and the edits of blocks whose rows follow."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = [c.split()[0] for c in EDITS.split(", ")]
    key, todo, codes, state, step, at, row = None, "", b"", START, 0, 0, 0
    role_of = {USER: "user", ASSISTANT: "assistant"}
    for batch in batches:
        out = []

        def inserts():
            nonlocal state, at, step
            while at < len(todo) and todo[at] == "I":
                state, at, step = NEXT[state], at + 1, step + 1
                out.append((key, step, "I", INSERT, None, None, None, role_of[state], ""))

        for k, turn, role, text, kind, audited, coded in zip(*(batch.column(c).to_pylist() for c in ("k", "turn", "role", "text", "kind", "audit", "codes")), strict=True):
            if k != key:
                inserts()
                key, todo, codes, state, step, at, row = k, "", b"", START, 0, 0, 0
            if kind == 0:
                todo, codes, at, row = todo[at:] + audited, codes[row:] + coded, 0, 0
                continue
            inserts()
            edit, fault = todo[at], codes[row] & 3
            at, row, step = at + 1, row + 1, step + 1
            cost = DELETE if edit == "D" else (REROLE if edit == "R" else KEEP) + (TRUNCATED if fault == 3 else 0)
            if edit == "D":
                out.append((key, step, edit, cost, FAULTS[fault], turn, role, None, None))
                continue
            state = NEXT[state] if edit == "R" else after(state, role[:1])
            out.append((key, step, edit, cost, FAULTS[fault], turn, role, role_of[state] if edit == "R" else role, text))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 9, kinds, strict=True)], names)
    if at < len(todo):
        out = []
        while at < len(todo):
            state, at, step = NEXT[state], at + 1, step + 1
            out.append((key, step, "I", INSERT, None, None, None, role_of[state], ""))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _key(column):
    """A conversation's key, not null: '' for null, else '=' and the id."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits of conversations (conv_id, turn, role, text), in order: k (key of the conv_id), step 1, 2, ..., edit, cost, fault, turn, old_role and the role and text that stay (null: deleted).

    A conversation's rows follow each other in one partition. They are taken by turn (null first); rows of one turn by
    role, then by the text's first 64 characters, then by its MD5. Null roles and texts are one space; a null conv_id is a
    conversation; turns are whole numbers. A row has the first fault of: blank (nothing but ASCII white space), duplicate
    (role and text came before), truncated (its last character that is not white is none of `.!?`). Empty tables give
    no rows; other columns are not read.
    """
    rows = conversations.select(_key(F.col("conv_id")).alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "md5": F.unhex(F.md5("text"))})
    order = ["turn", "role", "head", "md5"]
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12) + F.when(last == "", 1).when(~last.isin(".", "!", "?"), 16).otherwise(0)
    numbered = ranked(rows.select("k", *order, code.alias("code")), ["k"], [F.col(c) for c in order], "place")
    numbered = numbered.withColumn("place", F.col("place") - 1)
    first = numbered.where(F.col("code") % 4 != 1).groupBy("k", "role", "md5").agg(F.min("place").alias("place"))
    nothing = F.lit(None).cast("struct<turn:bigint,role:string,head:string,md5:binary>")
    marks = numbered.select("k", "place", "code", F.struct(*order).alias("at")).unionByName(first.select("k", "place", F.lit(31).alias("code"), nothing.alias("at")))
    grouped = marks.groupBy("k", F.floor(F.col("place") / block).alias("block")).agg(F.collect_list(F.col("place") * 32 + F.col("code")).alias("marks"), F.min("at").alias("at"))
    blocks = materialize(grouped.mapInArrow(_blocks(block), "k string, block long, codes binary, sums binary, audit string, at struct<turn:bigint,role:string,head:string,md5:binary>"), "blocks")
    audits = blocks.where("audit is not null").select("k", "block", "codes", "audit", "at")
    if blocks.where("audit is null").limit(1).count():
        audits = audits.unionByName(_long_audits(blocks.where("audit is null"), block))
    here = rows.select("k", *order, "text", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("binary").alias("codes"))
    there = audits.select("k", "at.*", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), "block", "audit", "codes")
    stream = here.unionByName(there).repartition("k").sortWithinPartitions("k", *order, "kind", "block")
    return stream.select("k", "turn", "role", "text", "kind", "audit", "codes").mapInArrow(_edits, EDITS)


def _long_audits(blocks: DataFrame, block: int) -> DataFrame:
    """Audits of blocks whose conversations may have several: sums go up until each conversation has one, crossings come down."""
    levels, sums = [], blocks.select("k", "block", "sums")
    while (sums.agg(F.max("block")).first()[0] or 0) > 0:
        runs = materialize(sums.groupBy("k", F.floor(F.col("block") / block).alias("block")).agg(F.collect_list(F.struct("block", "sums")).alias("items")), "runs")
        levels.append(runs)
        sums = materialize(runs.mapInArrow(_sums, "k string, block long, sums binary"), "sums")
    kind = "k string, block long, p int, q int, last boolean"
    ways = sums.mapInArrow(_ends, kind)
    for runs in reversed(levels):
        ways = runs.join(ways, ["k", "block"]).mapInArrow(_down, kind)
    return blocks.select("k", "block", "codes", "at").join(ways, ["k", "block"]).mapInArrow(_audits, "k string, block long, codes binary, audit string, at struct<turn:bigint,role:string,head:string,md5:binary>")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DIGESTS = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches):
    import pyarrow as pa

    key, state = None, None

    def close():
        turns = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return (key, turns, *(state[c] for c in COUNTS[1:]), "".join(state["audit"]), state["hash"].hexdigest())

    def table(rows):
        kinds = (pa.string(), *[pa.int64()] * 6, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 9, kinds, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])

    for batch in batches:
        out = []
        for k, edit, cost, fault, turn, old, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "edit", "cost", "fault", "turn", "old_role", "role", "text")), strict=True):
            if k != key:
                if key is not None:
                    out.append(close())
                key, state = k, {c: 0 for c in COUNTS} | {"turns": 0, "low": None, "high": None, "before": None, "audit": [], "hash": hashlib.sha256(), "lines": 0}
            state["audit"].append(edit)
            state["cost"] += cost
            if edit != "I":
                if fault:
                    state[fault] += 1
                if state["before"] is not None and state["before"] + old[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["before"] = old[:1]
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                    state["turns"] += 1
            if role is not None:
                state["hash"].update(f"{'\n' if state['lines'] else ''}{role}:{text}".encode())
                state["lines"] += 1
        yield table(out)
    if key is not None:
        yield table([close()])


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn` modulo 20: 0 drops, 1 empties, 2 takes `[.!?]` out, 3 repeats, 4 makes it the user's. Nulls are one space."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20).alias("_fate"))
    fate = F.col("_fate")
    rows = rows.where(fate != 0).withColumns({"role": F.when(fate == 4, "user").otherwise(F.col("role")),
                                              "text": F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
                                              "_copy": F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1)))})
    return rows.select("conv_id", "turn", "role", "text")


def report(conversations: DataFrame) -> DataFrame:
    """The audit of each conv_id of damaged conversations; a conversation without rows after damage has zeros and an empty audit."""
    ids = conversations.groupBy("conv_id").agg(F.first(_key(F.col("conv_id"))).alias("k"))
    found = repair(damage(conversations)).mapInArrow(_digests, DIGESTS)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return ids.join(found, "k", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
