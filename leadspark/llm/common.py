"""What several operators share: shared-storage tables, words and hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.scratch import components, discard, materialize, meet, sift  # noqa: F401

#: A word, everywhere in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def without(docs: DataFrame, ids: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """Rows of docs whose doc_id is not in ids (one column, no nulls). ids are broadcast only if there are at most max_broadcast."""
    ids = materialize(ids.select(F.col(ids.columns[0]).alias("_leadspark_id")).distinct(), "ids")
    small = ids.count() <= max_broadcast
    return docs.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_leadspark_id"), "left_anti")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers, so that near keys get far hashes."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def encode(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of texts (None: none), A-Z lower-cased: distinct words, an id for each word, and offsets of each text's words."""
    ids: dict[bytes, int] = {}
    get, out, counts = ids.setdefault, [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words = text.encode().lower().split()
            counts[i + 1] = len(words)
            out.append(np.fromiter((get(w, len(ids)) for w in words), np.int32, len(words)))
    return list(ids), np.concatenate(out) if out else np.zeros(0, np.int32), np.cumsum(counts)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def slices(batches, column: str = "text", limit: int = 3_000_000):
    """Record batches cut so that each holds about limit bytes of column (one row at least): memory stays bounded."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)


def lists(values: np.ndarray, lengths: np.ndarray):
    """An Arrow list array of int64 with these lengths."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False) if values.dtype != np.uint64 else values.view(np.int64)))


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    words, ids, at = encode(texts)
    if not len(ids):
        return [np.zeros(0, np.uint64)] * len(texts)
    h = mix64(word_hashes(words))[ids]
    acc = h.copy()
    acc[: len(h) - k + 1] = 0
    n = len(h) - k + 1
    if n > 0:
        part = h[:n].copy()
        for j in range(1, k):
            part = mix64(part * U64(0x9E3779B97F4A7C15) + h[j : j + n])
        acc[:n] = part
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            one = h[a : a + 1] + U64(b - a)
            for j in range(a + 1, b):
                one = mix64(one * U64(0x9E3779B97F4A7C15) + h[j : j + 1])
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
