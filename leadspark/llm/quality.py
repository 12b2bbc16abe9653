"""Quality rules: text statistics and cross-document line frequency.

One Arrow pass gives each document's statistics and the hashes of its normalised lines. Lines are counted per host in
distinct documents (copies with the same text count once); a line in more documents of its host than the limit is
removed everywhere but in the host's first document with it, and a document that this leaves with too little is
rejected. Only hashes and counts are shuffled; counts combine before the shuffle, so a hot host or line is no hot key.
Frequent lines are joined back by (host, line): broadcast while a count shows that they are few, else shuffled with each
line dealt to as many tasks as its rows need. Texts move only where the cleaned text itself is asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import U64, lists, materialize, meet, mix64, slices

SYMBOLS = "#*$%&|<>"
_DIGITS = bytes(ord("0") if chr(c).isdigit() else c for c in range(128)) + bytes(range(128, 256))
SCHEMA = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line long, lines array<long>, line_words array<long>"


def line_key(line: bytes) -> bytes:
    """A line without its case (A-Z), its digits' values and its white space's lengths; empty if it has no word."""
    return b" ".join(line.lower().translate(_DIGITS).split())


def repeats(ids: np.ndarray, at: np.ndarray, window: int = 5) -> np.ndarray:
    """For each text (words ids[at[i]:at[i+1]]): words in windows of 5 words that the text holds twice or more."""
    n, docs = len(ids), len(at) - 1
    if n < window:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(at))
    word = mix64(ids.astype(np.uint64) + U64(1))
    key = mix64(doc[: n - window + 1].astype(np.uint64) + U64(77))
    for j in range(window):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + word[j : n - window + 1 + j])
    start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    _, inverse, count = np.unique(key[start], return_inverse=True, return_counts=True)
    twice = start[count[inverse] > 1]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + window, -1)
    return np.bincount(doc, weights=np.cumsum(mark[:n]) > 0, minlength=docs).astype(np.int64)


def _features(batches):
    import pyarrow as pa
    import xxhash

    h64 = xxhash.xxh3_64_intdigest
    for batch in slices(batches):
        ids: dict[bytes, int] = {}
        word_ids, at, stats, keys, words_in, counts = [], [0], [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            raw = text.encode()
            words = raw.split()
            word_ids += [ids.setdefault(w, len(ids)) for w in words]
            at.append(len(word_ids))
            seen, duplicates, own = set(), 0, {}
            for line in raw.split(b"\n"):
                if key := line_key(line):
                    if line in seen:
                        duplicates += 1
                    seen.add(line)
                    h = h64(key)
                    own[h] = own.get(h, 0) + key.count(b" ") + 1
            white = sum(text.count(c) for c in " \t\n\v\f\r")
            stats.append((len(words), len(text) - white, sum(text.count(c) for c in SYMBOLS), duplicates, len(own)))
            keys += own.keys()
            words_in += own.values()
            counts.append(len(own))
        at, s, n = np.array(at), np.array(stats, np.int64).reshape(-1, 5), np.array(counts, np.int64)
        columns = [batch.column("text_hash"), *(pa.array(s[:, i]) for i in range(4)), pa.array(repeats(np.array(word_ids, np.int64), at)), pa.array(s[:, 4]), lists(np.array(keys, np.uint64), n), lists(np.array(words_in, np.int64), n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])


def judge(docs: DataFrame, host: str = "source", min_words: int = 10, max_repeat_percent: int = 20, min_line_docs: int = 50, line_docs_percent: float = 0.0,
          min_left_percent: int = 20, max_broadcast: int = 500_000) -> DataFrame:
    """A row for each of docs (doc_id, text, host): statistics, base_failed, removed_words, drop_lines (hashes) and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of the words in repeated 5-word windows. A line
    is frequent when more than min_line_docs of its host's distinct documents have it, whatever the host's size; a caller
    may also ask for more than line_docs_percent of them.
    Depleted: under min_words words, or under min_left_percent of its words, are left. kept: neither failed nor depleted.
    A null text is empty; a null host is a host; rows that repeat count once and get the same verdict; of equal
    frequent lines in one host, the smallest doc_id's stay (null last); an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    stats = materialize(source.mapInArrow(_features, SCHEMA), "quality")
    texts = stats.groupBy("host", "text_hash").agg(F.min("doc_id").alias("first"), F.first("lines").alias("lines"), F.count("*").alias("copies"))
    # copies share their lines: a line's documents are counted over distinct texts
    by_line = texts.select("host", "first", "copies", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.sum("copies").alias("_n"))
    key = lambda h: F.concat(F.when(h.isNull(), "").otherwise("="), F.coalesce(h, F.lit(""))).alias("_key")
    hosts = texts.groupBy("host").agg(F.count("*").alias("of"))
    many = by_line.where(F.col("docs") > min_line_docs).alias("l").join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    many = many.where(F.col("docs") * 100 > F.col("of") * line_docs_percent).select(key(F.col("l.host")), F.col("line").alias("_line"), F.col("first").alias("_first"), "_n")
    many = materialize(many, "lines")
    once = stats.dropDuplicates(["doc_id", "host", "text_hash"]).select("doc_id", "host", "text_hash", key(F.col("host")), F.explode(F.arrays_zip("lines", "line_words")).alias("z"))
    once = once.select("doc_id", "host", "text_hash", "_key", F.col("z.lines").alias("_line"), F.col("z.line_words").alias("_words"))
    by = ["_key", "_line"]
    hit = once.join(F.broadcast(many.drop("_n")), by) if many.count() <= max_broadcast else meet(once, many, by, "_n", ["doc_id", "text_hash"])
    hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    gone = hit.groupBy(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("text_hash").alias("_t")).agg(
        F.sum("_words").alias("_removed"), F.collect_list("_line").alias("_drop"))  # no longer than the document
    out = stats.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_hash") == F.col("_t")), "left")
    removed = F.coalesce("_removed", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - removed
    depleted = (removed > 0) & ((left < min_words) | (100 * left < min_left_percent * F.col("n_words")))
    return out.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      removed.alias("removed_words"), F.col("_drop").alias("drop_lines"), (~failed & ~depleted).alias("kept"))


def _clean(columns: list[str]):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in slices(batches):
            texts = []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("_leadspark_drop").to_pylist(), strict=True):
                if drop:
                    gone = {x & (2**64 - 1) for x in drop}
                    text = "\n".join(line for line in text.split("\n") if not (k := line_key(line.encode())) or xxhash.xxh3_64_intdigest(k) not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)
    return run


def filter_documents(docs: DataFrame, host: str = "source", **rules) -> DataFrame:
    """The documents that judge() keeps, without their frequent lines; n_chars, if there, follows the text.

    docs has doc_id, text and the host; other columns stay as they are.
    """
    verdicts = judge(docs, host, **rules).where("kept").select(F.col("doc_id").alias("_leadspark_d"), F.col("host").alias("_leadspark_h"), F.col("text_hash").alias("_leadspark_t"), F.col("drop_lines").alias("_leadspark_drop"))
    verdicts = verdicts.dropDuplicates(["_leadspark_d", "_leadspark_h", "_leadspark_t"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_leadspark_d")) & F.col(host).cast("string").eqNullSafe(F.col("_leadspark_h")) & (F.xxhash64("text") == F.col("_leadspark_t"))
    out = docs.join(verdicts, same).select(*docs.columns, "_leadspark_drop").mapInArrow(_clean(docs.columns), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
