"""Language-model scores by deleted interpolation of bigrams.

p(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's frequency
c(h) (powers of two) and the weights l of each bucket are learned by expectation-maximisation on counts of a part of
the training documents that the maximum-likelihood estimates of that step leave out.

Texts are read once, into chunks of about 750 thousand tokens: distinct words, and the texts as numbers of words. Each
chunk sends its distinct unigrams and bigrams, packed and sorted, to count buckets by hash range; a bucket adds up the
counts of all chunks and answers each chunk in its own order. A frequent n-gram is one entry per chunk, so no bucket is
hot. There are just as many buckets as keep a bucket's entries within memory, so a chunk's part of a bucket stays a long
run of entries; the rows exchanged are never more than the chunks' distinct n-grams, which grow with the input. With its
answers each chunk scores its documents. The driver gets N, V and some sums per frequency bucket.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import U64, discard, materialize, mix64, slices, word_hashes

END, START = U64(0x5A17E9D3C0FFEE01), U64(0x1B0CA7F00D5EED03)
CHUNK = "chunk long, docs array<long>, has_id array<boolean>, fold binary, sizes binary, words binary, ids binary"
KEYS = "bucket long, level int, chunk long, keys binary, main binary, other binary"


def pack(a: np.ndarray) -> bytes:
    """Integers as planes of bytes: small numbers compress well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_counts(a: np.ndarray) -> bytes:
    """Counts as planes of bytes, of 32 bits where they fit and else of 64, with the width in front."""
    kind = np.uint32 if not len(a) or int(a.max()) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + pack(a.astype(kind))


def unpack_counts(b: bytes) -> np.ndarray:
    return unpack(memoryview(b)[1:], np.uint32 if b[0] == 4 else np.uint64)


def _chunks(tokens: int, folds: int, test: int, held: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        empty = lambda: ([], [], [], [], {})
        docs, fold, sizes, ids, words = empty()

        def row():
            nonlocal made
            # numbers in order of frequency would be shorter still; order of first use is near enough
            hashes = np.concatenate([[END, START], mix64(word_hashes(list(words)))]).astype(np.uint64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([[d or 0 for d in docs]], pa.list_(pa.int64())), pa.array([[d is not None for d in docs]], pa.list_(pa.bool_())), pa.array([bytes(fold)], pa.binary()),
                 pa.array([pack(np.array(sizes, np.uint32))], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([pack(np.concatenate(ids))], pa.binary())],
                [c.split()[0] for c in CHUNK.split(", ")])
            made += 1
            return out

        held_tokens = 0
        for batch in slices(batches):
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                split = (text or "").encode().lower().split()
                get = words.setdefault
                own = np.fromiter((get(w, len(words) + 2) for w in split), np.uint32, len(split))
                rest = zlib.crc32(b"" if d is None else str(d).encode()) % folds
                docs.append(d)
                fold.append(2 if rest == test else 1 if rest == held else 0)
                sizes.append(len(split) + 1)
                ids += [own, np.zeros(1, np.uint32)]
                held_tokens += len(split) + 1
                if held_tokens >= tokens:
                    yield row()
                    docs, fold, sizes, ids, words = empty()
                    held_tokens = 0
        if docs:
            yield row()
    return run


def _before(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of the word before each word; START (1) before each text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 1
    return before


def _pairs(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams of a chunk as pairs of word numbers, and each token's place among them."""
    return np.unique(before.astype(np.uint64) << U64(32) | ids, return_inverse=True)


def _keys(pairs: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of bigrams (bits of the bucket and 40 more), and each bigram's place among them."""
    key = mix64(hashes[(pairs >> U64(32)).astype(np.int64)] * U64(0x9E3779B97F4A7C15) + hashes[(pairs & U64(0xFFFFFFFF)).astype(np.int64)])
    return np.unique(key >> U64(24 - bits), return_inverse=True)


def _read(row) -> tuple[np.ndarray, ...]:
    fold, sizes = np.frombuffer(row["fold"], np.uint8), unpack(row["sizes"], np.uint32).astype(np.int64)
    return fold, sizes, unpack(row["ids"], np.uint32), np.repeat(fold, sizes)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _emit(bits: int):
    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            fold, sizes, ids, part = _read(row)
            hashes = np.frombuffer(row["words"], np.uint64)
            one, where = np.unique(hashes, return_inverse=True)
            pairs, at = _pairs(ids, _before(ids, sizes))
            two, place = _keys(pairs, hashes, bits)
            starts = np.bincount(fold, minlength=3)
            for level, keys, place, size, width in ((1, one, where[ids], 64, 8), (2, two, place[at], 40 + bits, 5)):
                main, other = (np.bincount(place[part == f], minlength=len(keys)).astype(np.uint32) for f in (0, 1))
                if level == 1:  # START is a context only: once a text
                    s = where[1]
                    main[s], other[s] = starts[0], starts[1]
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << U64(size - bits))
                cuts = np.concatenate([[0], cuts, [len(keys)]])
                raw = keys.view(np.uint8).reshape(-1, 8)[:, :width]  # the bucket's bits are left out of bigrams' keys
                live = np.flatnonzero(np.diff(cuts))
                data = [[int(b) for b in live], [level] * len(live), [row["chunk"]] * len(live), *([f(cuts[b], cuts[b + 1]) for b in live] for f in (lambda a, b: raw[a:b].tobytes(), lambda a, b: pack(main[a:b]), lambda a, b: pack(other[a:b])))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(data, kinds, strict=True)], [c.split()[0] for c in KEYS.split(", ")])
    return run


def _count(table):
    """Counts of one bucket over all chunks, for each chunk in the order of its keys; and, as chunk -1, the bucket's sums."""
    import pyarrow as pa

    level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
    width, parts = 8 if level == 1 else 5, []
    for raw in table.column("keys").to_pylist():
        grid = np.zeros((len(raw) // width, 8), np.uint8)
        grid[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        parts.append(grid.view(np.uint64).ravel())
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    sums = []
    for c in ("main", "other"):
        mine = np.concatenate([unpack(x, np.uint32) for x in table.column(c).to_pylist()])
        sums.append(np.bincount(place, weights=mine, minlength=len(keys)).astype(np.uint64))
    cuts, chunks = np.cumsum([0, *map(len, parts)]), table.column("chunk").to_pylist()
    out = [[c, level, bucket, *(pack_counts(s[place[cuts[i] : cuts[i + 1]]]) for s in sums), None, None, None] for i, c in enumerate(chunks)]
    if level == 1:
        words = keys != START
        out.append([-1, level, bucket, None, None, *(int(s[words].sum()) for s in sums), int(((sums[0] + sums[1] > 0) & words).sum())])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "level", "bucket", "main", "other", "n_main", "n_other", "distinct"])


def _join(bits: int):
    def run(left, right):
        """A chunk with the corpus counts of its unigrams (in the order of word numbers) and bigrams (of pairs of numbers)."""
        import pyarrow as pa

        row = left.slice(0, 1).to_pylist()[0]
        found = right.to_pylist()
        found.sort(key=lambda r: (r["level"], r["bucket"]))
        got = {(lv, c): np.concatenate([unpack_counts(r[c]) for r in found if r["level"] == lv]) for lv in (1, 2) for c in ("main", "other")}
        _, sizes, ids, _ = _read(row)
        hashes = np.frombuffer(row["words"], np.uint64)
        _, where = np.unique(hashes, return_inverse=True)
        _, place = _keys(_pairs(ids, _before(ids, sizes))[0], hashes, bits)
        counts = [pack_counts(got[lv, c][at]) for lv, at in ((1, where), (2, place)) for c in ("main", "other")]
        data = [*(row[c] for c in ("docs", "has_id", "fold", "sizes", "ids")), *counts]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 7)
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(data, kinds, strict=True)], names=[c.split()[0] for c in JOINED.split(", ")])
    return run


JOINED = "docs array<long>, has_id array<boolean>, fold binary, sizes binary, ids binary, m1 binary, o1 binary, m2 binary, o2 binary"


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the whole part of the binary logarithm."""
    return np.where(c > 0, 1 + np.log2(np.maximum(c, 1)).astype(np.int64), 0)


def _tokens(row) -> tuple[np.ndarray, ...]:
    fold, sizes, ids, part = _read(row)
    before = _before(ids, sizes)
    _, at = _pairs(ids, before)
    return fold, sizes, ids, part, before, at


def _events(n_main: int):
    """Held-out bigrams: frequency bucket, the two estimates from the other documents, and how often."""
    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            _, _, ids, part, before, at = _tokens(row)
            m1, m2 = (unpack_counts(row[c]).astype(np.float64) for c in ("m1", "m2"))
            t = np.flatnonzero(part == 1)
            c, h, w = m2[at[t]], m1[before[t]], m1[ids[t]]
            order = np.lexsort((w, h, c))
            key = np.stack([c[order], h[order], w[order]])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if len(t) else np.zeros(0, np.int64)
            c, h, w = key[:, first]
            times = np.diff(np.concatenate([first, [len(t)]]))
            yield pa.RecordBatch.from_arrays([pa.array(context_bucket(h).astype(np.int32)), pa.array(c / np.maximum(h, 1)), pa.array(w / max(1, n_main)), pa.array(times.astype(np.int64))], ["b", "p2", "p1", "n"])
    return run


def learn(events: DataFrame, floor: float, rounds: int = 100, stop: float = 1e-3, buckets: int = 48) -> np.ndarray:
    """Weights (buckets x 3: bigram, unigram, uniform) by expectation-maximisation, until none moves by `stop`; each round is one aggregation of events. Warns if `rounds` do not suffice."""
    weights = np.tile([0.4, 0.4, 0.2], (buckets, 1))
    weights[0] = [0.0, 0.7, 0.3]
    for _ in range(rounds):
        pick = lambda k, w=weights: F.element_at(F.array(*(F.lit(float(x)) for x in w[:, k])), F.col("b") + 1)
        parts = [pick(0) * F.col("p2"), pick(1) * F.col("p1"), pick(2) * floor]
        scored = events.select("b", "n", *(p.alias(f"_{i}") for i, p in enumerate(parts))).withColumn("_s", F.col("_0") + F.col("_1") + F.col("_2"))
        got = scored.groupBy("b").agg(*(F.sum(F.col("n") * F.col(f"_{i}") / F.col("_s")).alias(f"s{i}") for i in range(3))).collect()  # a row a bucket
        new = weights.copy()
        for r in got:
            share = np.array([r.s0, r.s1, r.s2])
            new[r.b] = (share + 1e-6 * (weights[r.b] > 0)) / (share + 1e-6 * (weights[r.b] > 0)).sum()
        moved, seen = np.abs(new - weights).max(), sorted(r.b for r in got)
        weights = new
        if moved < stop:
            break
    else:
        warnings.warn(f"weights still move by {moved:.2g} after {rounds} rounds", stacklevel=2)
    for b in range(1, buckets):  # buckets without events: as the next lower one
        if seen and b not in seen and (low := [x for x in seen if 0 < x < b]):
            weights[b] = weights[low[-1]]
    return weights


def _score(weights: np.ndarray, n: int, v: int):
    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            fold, sizes, ids, _, before, at = _tokens(row)
            c1 = unpack_counts(row["m1"]).astype(np.float64) + unpack_counts(row["o1"])
            c2 = unpack_counts(row["m2"]).astype(np.float64) + unpack_counts(row["o2"])
            w, h = c1[ids], c1[before]
            weight = weights[context_bucket(h)]
            p = weight[:, 0] * c2[at] / np.maximum(h, 1) + weight[:, 1] * w / max(1, n) + weight[:, 2] / (v + 1)
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            add = lambda x: np.add.reduceat(x, cuts)  # noqa: E731, B023
            ids_ = pa.array(row["docs"], pa.int64(), mask=~np.array(row["has_id"]))
            yield pa.RecordBatch.from_arrays([ids_, pa.array(fold == 2), pa.array(sizes), pa.array(add((w > 0).astype(np.int64))), pa.array(np.full(len(sizes), n, np.int64)), pa.array(add(np.log10((w + 1) / (n + v + 1)))), pa.array(add(np.log10(p)))],
                                             ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, folds: int = 7, test: int = 2, held: int = 5, chunk_tokens: int = 750_000, bucket_tokens: int = 8_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each of docs (doc_id, text).

    Documents whose crc32(doc_id) mod folds is `test` are scored but not learned from; those with `held` are what the
    mixture weights are learned on, and count in the model itself. Tokens: words with A-Z lower-cased, then one end. A
    null or empty text is an end alone; a null doc_id counts as the empty string; rows that repeat each count.
    An empty table gives no rows. Without training documents every probability is 1 / (V + 1) = 1.
    """
    chunks = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks(chunk_tokens, folds, test, held), CHUNK), "chunks")
    entries = chunks.agg(F.sum(F.octet_length("words") / 8 + F.octet_length("ids") / 4)).first()[0] or 0  # at least the chunks' distinct n-grams
    bits = max(6, int(np.ceil(np.log2(max(1, entries / bucket_tokens)))))
    keys = chunks.mapInArrow(_emit(bits), KEYS)
    counted = materialize(keys.groupBy("level", "bucket").applyInArrow(_count, "chunk long, level int, bucket long, main binary, other binary, n_main long, n_other long, distinct long"), "counts")
    sums = counted.where("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_main", "n_other", "distinct"))).first()
    answers = counted.where("chunk >= 0").select("chunk", "level", "bucket", "main", "other")
    joined = materialize(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_join(bits), JOINED), "counted")
    discard(chunks, counted)
    n, v = sums.n_main + sums.n_other, sums.distinct
    events = materialize(joined.mapInArrow(_events(sums.n_main), "b int, p2 double, p1 double, n long"), "events")
    weights = learn(events, 1.0 / (v + 1))
    if not n:
        weights = np.tile([0.0, 0.0, 1.0], (len(weights), 1))
    return joined.mapInArrow(_score(weights, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
