"""Exact substring deduplication over an enhanced suffix array of anchored suffixes.

A byte goes when a `length`-byte string that covers it also starts earlier (smaller doc_id, or same document and earlier).

1. Anchors. Every `length`-byte string has one anchor: the leftmost place of its smallest k-byte hash. That depends on
   the string alone, so equal strings have their anchors at the same place. Neighbouring strings with one anchor make
   its context; an anchor gives its hash, its context's hash and its place: one row in about 32 bytes. Hashes are
   counted first (combined before the shuffle), and only the rows of repeated ones go on.
2. Anchors with the same hash and the same context: all but the first are repeats of the whole context, at once. The
   first one is a minimum, combined before the shuffle, that the rows of a hot context look up in several tasks.
3. First anchors of each context whose hash has further contexts are the suffixes whose common prefixes matter. Their
   contexts are fetched from the texts, and each bucket (same k bytes) becomes an enhanced suffix array: suffixes
   sorted, common-prefix lengths of neighbours, and a stack scan that closes the intervals of the common-prefix tree.
   In each interval the left contexts tell the left-extension diversity: a repeat is maximal when its occurrences differ
   to the left and to the right. Each maximal group gives all its occurrences; all but the first are repeats.
4. A bucket of more than `bucket` contexts (a phrase of k bytes in many texts) is split: two contexts that share a
   string of `length` bytes share a bytes before the anchor and length - k - step - a after it for one of a = 0, step,
   2 step, 3 step, so each context goes to four buckets by these bytes, and every pair still meets. Buckets that are
   large even then have their `length`-byte strings compared as such: a hash each, the first of which is a minimum.
   So no task holds an unbounded bucket.
5. Repeats are cut out of the texts, which are joined once with their list of spans.

Hashes are 64 bits wide, of the bytes themselves; texts are processed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import U64, discard, materialize, meet, mix64, slices

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
#: Bits of a place in a buffer of pieces, and the bytes of a piece: fixed, so that every string has the same anchor in texts of any length.
BITS, PIECE = 22, 1 << 20
_BASE, _INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  a cache
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    if held.get("n", 0) < n:
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base)
            x[0] = U64(1)
            both.append(np.multiply.accumulate(x))
        held.update(n=n, both=tuple(both))
    return held["both"]


class _Hashes:
    """Hashes of all substrings of a buffer of bytes, each in constant time: sums of table[byte] * base ** place modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inverse[a])

    def grams(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each w neighbours, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(hashes: np.ndarray, inside: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and the begins and ends of their contexts; hashes of k-grams, inside: starts of the strings to cover."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    low = U64((1 << BITS) - 1)
    least = _sliding((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - k + 1, np.minimum)
    at = (least[inside] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(inside) > 1)]))
    return at[cut], inside[cut], np.concatenate([inside[cut[1:] - 1], inside[-1:]]) + length


def _pieces(texts: list, length: int):
    """Buffers of up to PIECE bytes or so: bytes with one that is in no UTF-8 text after each piece, begins of the pieces, their texts' numbers and their places in them. Every string of length bytes is in one piece."""
    held: list[tuple[int, int, bytes]] = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for a in range(0, len(raw) - length + 1, PIECE):
            if held and sum(len(x) + 1 for _, _, x in held) + len(raw) > PIECE:
                yield _buffer(held)
                held = []
            held.append((i, a, raw[a : a + PIECE + length - 1]))
    if held:
        yield _buffer(held)


def _buffer(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"\xff".join(x for _, _, x in pieces) + b"\xff", np.uint8)
    sizes = np.fromiter((len(x) + 1 for _, _, x in pieces), np.int64, len(pieces))
    return data, np.cumsum(sizes) - sizes, np.array([i for i, _, _ in pieces]), np.array([a for _, a, _ in pieces])


def _find(length: int, k: int):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, limit=1_000_000):
            for data, begins, text, offset in _pieces(batch.column("text").to_pylist(), length):
                h = _Hashes(data)
                outside = np.cumsum(np.concatenate([[0], data == 255]))
                at, low, high = anchors(h.grams(k), np.flatnonzero(outside[length:] == outside[:-length]), length, k)
                piece = np.searchsorted(begins, at, side="right") - 1
                context = h.of(low, high) + (at - low).astype(np.uint64)
                place = (at - begins[piece] + offset[piece]) << 16 | (at - low) << 8 | (high - at)
                take = pa.array(text[piece])
                yield pa.RecordBatch.from_arrays([pa.array(h.of(at, at + k).view(np.int64)), pa.array(context.view(np.int64)), batch.column("d").take(take), batch.column("e").take(take), pa.array(place)], ["h", "x", "d", "e", "q"])
    return run


def _squeeze(batches):
    """Texts compressed for the shuffle."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], [*rest, "z"])


def _key(a: int, left: bytes, right: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(left + right, seed=a + 1) - (1 << 63)


def _splits(length: int, k: int) -> list[tuple[int, int]]:
    """Bytes before the anchor and from it on, of which any two contexts of one anchor with a string of length bytes in common share one pair."""
    step = -(-(length - k) // 4) or 1
    return [(a, k + max(0, length - k - step - a)) for a in range(0, 4 * step, step)]


def _contexts(length: int, k: int, split: bool):
    """The contexts of spots: left ones reversed. split: once for each of the keys that replace h, with the bytes that the key holds."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names, kinds = (["h", "d", "e", "p", "left", "right", "a", "b"], (*[pa.int64()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.int64()))
        for batch in slices(batches, "z", 1_000_000):
            out: tuple[list, ...] = tuple([] for _ in names)
            for d, e, z, spots in zip(*(batch.column(c).to_pylist() for c in ("d", "e", "z", "spots")), strict=True):
                raw = unpack(z)
                for s in spots:
                    p, n, m = s["q"] >> 16, s["q"] >> 8 & 255, s["q"] & 255
                    left, right = raw[p - n : p][::-1], raw[p : p + m]
                    for a, b in _splits(length, k) if split else ((0, 0),):
                        if a <= n and b <= m:
                            for column, v in zip(out, (_key(a, left[:a], right[:b]) if split else s["h"], d, e, p, left, right, a, b), strict=True):
                                column.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)
                    out = tuple([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)
    return run


def _strings(length: int):
    """Hashes and places of the strings of length bytes around what the key of a context holds."""
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for d, e, p, left, right, a, b in zip(*(batch.column(c).to_pylist() for c in ("d", "e", "p", "left", "right", "a", "b")), strict=True):
                raw, at = left[::-1] + right, len(left)
                for i in range(max(0, at + b - length), min(at - a, len(raw) - length) + 1):
                    for column, v in zip(out, (xxhash.xxh3_64_intdigest(raw[i : i + length]) - (1 << 63), d, e, p - at + i), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["h", "d", "e", "q"])
    return run


def common(items: list[bytes]) -> np.ndarray:
    """Common-prefix length of each item and the one before it (0 for the first)."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    width = int(sizes.max(initial=1))
    grid = np.frombuffer(b"".join(x.ljust(width, b"\xff") for x in items), np.uint8).reshape(len(items), width)
    out = np.zeros(len(items), np.int64)
    if len(items) > 1:
        same = grid[1:] == grid[:-1]
        first = np.where(same.all(1), width, same.argmin(1))
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def intervals(lcp: np.ndarray, least: int):
    """Intervals (length, begin, end) of the common-prefix tree with a length of least or more, by a stack scan, inner ones first."""
    stack: list[list[int]] = []
    for i in range(1, len(lcp) + 1):
        v = int(lcp[i]) if i < len(lcp) else 0
        begin = i - 1
        while stack and stack[-1][0] > v:
            n, begin = stack.pop()
            yield n, begin, i
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append([v, begin])


def maximal_repeats(left: list[bytes], right: list[bytes], length: int):
    """Of occurrences of one anchor (right contexts sorted, left ones reversed): (left length, right length, occurrences) of each maximal repeat of at least length bytes."""
    for r, a, b in intervals(common(right), 1):
        need = max(0, length - r)
        part = range(a, b)
        before = {left[i][:1] for i in part}
        if need == 0 and (len(before) > 1 or b"" in before):
            yield 0, r, list(part)
        order = sorted(part, key=left.__getitem__)
        for n, c, d in intervals(common([left[i] for i in order]), max(1, need)):
            yield n, r, order[c:d]


def _repeats(places: list[tuple], left: list[bytes], right: list[bytes], length: int, out: list) -> None:
    """For each occurrence of a bucket that is not the first of some maximal repeat, what these repeats cover: they all hold the anchor, so one span."""
    best: dict[int, tuple[int, int]] = {}
    for n, r, group in maximal_repeats(left, right, length):
        first = min(group, key=lambda i: (places[i][0] is None, places[i][0] or 0, *places[i][1:]))
        for i in group:
            if i != first:
                x, y = best.get(i, (0, 0))
                best[i] = max(x, n), max(y, r)
    for i, (n, r) in best.items():
        d, e, p = places[i]
        out.append((d, e, (p - n) << 32 | (p + r)))


def _scan(length: int):
    def run(batches):
        import pyarrow as pa

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out, strict=True) if out else ((), (), ()))], ["d", "e", "s"])

        now, places, left, right, out, known = None, [], [], [], [], set()
        for batch in batches:
            for h, d, e, p, x, y in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "e", "p", "left", "right")), strict=True):
                if h != now:
                    if len(places) > 1:
                        _repeats(places, left, right, length, out)
                    now, places, left, right, known = h, [], [], [], set()
                if (d, e, p) in known:  # rows that repeat as a whole are one document
                    continue
                known.add((d, e, p))
                places.append((d, e, p))
                left.append(x)
                right.append(y)
            yield flush(out)
            out = []
        if len(places) > 1:
            _repeats(places, left, right, length, out)
        yield flush(out)
    return run


def _cut(batches):
    import hashlib

    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "z", 1_000_000):
        rows: list[tuple] = []
        for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = unpack(z)
            if not spans:
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            s = np.sort(np.array(spans, np.int64))
            a, b = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            begins, ends = a[new], np.concatenate([b[new[1:] - 1], b[-1:]])
            kept, at = hashlib.sha256(), 0
            for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            rows.append((len(raw), int((ends - begins).sum()), len(new), kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


#: The order of occurrences: null ids last.
def _place():
    return F.struct(F.col("d").isNull().alias("no"), "d", "e", "q")


def repeated_spans(docs: DataFrame, length: int = 100, k: int = 32, bucket: int = 2000) -> DataFrame:
    """(d, e, spans): spans (begin << 32 | end, bytes, may overlap) of document d (e: the hash of its text) that are repeats. length: k to 255."""
    if not 0 < k <= length <= 255:
        raise ValueError("length has to be from k to 255")
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("e"), "text").where(F.octet_length("text") >= length)
    found = keyed.mapInArrow(_find(length, k), "h long, x long, d long, e long, q long")
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1"), "twice")
    rows = materialize(meet(found, twice, ["h"], "_n", ["d", "e", "q"]), "anchors")
    first = materialize(rows.groupBy("h", "x").agg(F.min(_place()).alias("first"), F.count("*").alias("_n")), "first")
    # rows that repeat as a whole are one document: neither copy is earlier
    again = meet(rows, first, ["h", "x"], "_n", ["d", "e", "q"]).where(_place() != F.col("first"))
    p = F.shiftright("q", 16)
    whole = again.select("d", "e", F.shiftleft(p - F.shiftright("q", 8).bitwiseAND(255), 32).bitwiseOR(p + F.col("q").bitwiseAND(255)).alias("s"))
    several = materialize(first.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("large", F.col("_n") > bucket), "several")
    spots = meet(first.select("h", "x", "first"), several, ["h"], "_n", ["x"]).select("h", "large", "first.d", "first.e", "first.q")
    by_doc = materialize(spots.groupBy("d", "e", "large").agg(F.collect_list(F.struct("h", "q")).alias("spots")), "spots")  # no longer than the document
    squeezed = keyed.mapInArrow(_squeeze, "d long, e long, z binary").alias("t")

    def contexts(split: bool) -> DataFrame:
        s = by_doc.where(F.col("large") == split).alias("s")
        with_text = squeezed.join(s, F.col("t.d").eqNullSafe(F.col("s.d")) & (F.col("t.e") == F.col("s.e"))).select("t.d", "t.e", "t.z", "s.spots")
        return with_text.mapInArrow(_contexts(length, k, split), "h long, d long, e long, p long, left binary, right binary, a long, b long")

    def scanned(contexts: DataFrame) -> DataFrame:
        return contexts.select("h", "d", "e", "p", "left", "right").repartition("h").sortWithinPartitions("h", "right").mapInArrow(_scan(length), "d long, e long, s long")

    parts = [whole, scanned(contexts(False))]
    if several.where("large").limit(1).count():
        held = materialize(contexts(True), "split")
        split = held.dropDuplicates(["h", "d", "e", "p"])
        sizes = materialize(split.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("large", F.col("_n") > bucket), "sizes")
        split = meet(split, sizes, ["h"], "_n", ["d", "e", "p"])
        strings = materialize(split.where("large").mapInArrow(_strings(length), "h long, d long, e long, q long"), "strings")
        least = materialize(strings.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("_n")), "least")
        later = meet(strings, least, ["h"], "_n", ["d", "e", "q"]).where(_place() != F.col("first"))
        parts += [scanned(split.where("not large")), later.select("d", "e", F.shiftleft("q", 32).bitwiseOR(F.col("q") + length).alias("s"))]
    spans = parts[0]
    for other in parts[1:]:
        spans = spans.unionByName(other)
    out = materialize(spans.groupBy("d", "e").agg(F.collect_list("s").alias("spans")), "spans")
    discard(twice, rows, first, several, by_doc, *((held, sizes, strings, least) if len(parts) > 2 else ()))
    return out


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32, bucket: int = 2000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each of docs (doc_id, text).

    A null text is empty; texts under length bytes keep all; null doc_ids come last; rows that repeat as a whole are one
    document and get the same row each; other rows of one doc_id follow their texts' hashes; an empty table gives none.
    """
    spans = repeated_spans(docs, length, k, bucket)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_e"), "text").mapInArrow(_squeeze, "doc_id long, _e long, z binary")
    joined = t.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_e") == F.col("e")), "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
