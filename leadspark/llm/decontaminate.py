"""Benchmark decontamination (native): size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by the size q of their shingle set into classes with upper bounds u = 2, 4, 8, ... The MinHash
sketch of an item is its k smallest shingle hashes, with k = floor((1 - t) * u) + 1 of its class: a document that holds
a share t or more of the item misses at most floor((1 - t) * q) < k shingles, so it holds at least
k - floor((1 - t) * q) >= 1 of the sketch. No containment is missed, however long the document is, and an item is
looked up by a fifth of its shingles.

Documents stream past the sketches once: words, shingle hashes, a hash join. The sketches are broadcast only while they
are at most max_broadcast rows (counted first); beyond it the join is shuffled, with the same result, and Spark's skew
join splits a common shingle's rows (an aggregation with its own shuffle follows). Candidates, few,
are joined with the texts and verified on the shingles themselves. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import materialize

SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def hashes(w: Column, k: int) -> Column:
    """Distinct hashes of the runs of k words, of the whole sequence if shorter; w must be a column, not an expression that each run would repeat."""
    run = lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k)))
    runs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))), run)
    return F.when(F.size(w) >= k, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))


def texts(w: Column, k: int) -> Column:
    """Distinct runs of k words, or the whole sequence if shorter, as strings."""
    runs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", F.slice(w, i + 1, k)))
    return F.when(F.size(w) >= k, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.concat_ws(" ", w)))


def _shares(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = 5, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, _u, item_id, n_item, n_shared) as contained(), for each text of a document (_u: its hash)."""
    i = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", "w", hashes(F.col("w"), k).alias("h")).where(F.size("h") > 0)
    q = F.size("h")
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(q.cast("double")))).cast("int")
    length = F.least(q, F.floor(bound * (100 - percent) / 100).cast("int") + 1)
    i = i.withColumn("_k", length).withColumn("_least", F.col("_k") - F.floor(q * (100 - percent) / 100).cast("int"))
    sketch = i.select("item_id", "_least", F.explode(F.slice(F.array_sort("h"), F.lit(1), F.col("_k"))).alias("h"))
    sketch = materialize(sketch, "sketch")
    small = sketch.count() <= max_broadcast
    d = docs.select("doc_id", F.xxhash64("text").alias("_t"), words(F.col("text")).alias("w"))
    d = d.select("doc_id", "_t", F.explode(hashes(F.col("w"), k)).alias("h"))
    hits = d.join(F.broadcast(sketch) if small else sketch, "h")
    found = hits.groupBy("doc_id", "_t", "item_id", "_least").agg(F.count_distinct("h").alias("_hits")).where("_hits >= _least").select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "item_id")
    full = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_u")))
    full = full.select("doc_id", "_u", F.col("item_id").alias("_i"), words(F.col("text")).alias("w")).select("doc_id", "_u", "_i", texts(F.col("w"), k).alias("_have"))
    want = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", texts(F.col("w"), k).alias("_want"))
    both = full.join(want, F.col("_i").eqNullSafe(F.col("item_id"))).select("doc_id", "_u", "item_id", F.size("_want").alias("n_item"), F.size(F.array_intersect("_have", "_want")).alias("n_shared"))
    return both.where((F.col("n_item") > 0) & (100 * F.col("n_shared") >= percent * F.col("n_item")))


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = 5, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items of which a document holds percent or more of the distinct k-word shingles.

    docs: doc_id, text. items: item_id, text. Texts with fewer than k words are one shingle, the whole sequence; null and
    empty texts hold nothing and are found nowhere. Rows that repeat an id with other texts give the largest share; equal
    rows give one. Null ids stay, as ids of their own. Empty tables give no rows.
    """
    best = _shares(docs, items, percent, k, max_broadcast).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("s"), "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"))


def remove_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = 5, max_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of docs (doc_id, text, others) whose text holds no item, rows without doc_id included. Rows of one doc_id are judged each by its text."""
    bad = _shares(docs, items, percent, k, max_broadcast).select(F.col("doc_id").alias("_leadspark_d"), F.col("_u").alias("_leadspark_h")).distinct()
    bad = materialize(bad, "contaminated")
    small = bad.count() <= max_broadcast
    return docs.join(F.broadcast(bad) if small else bad, F.col("doc_id").eqNullSafe(F.col("_leadspark_d")) & (F.xxhash64("text") == F.col("_leadspark_h")), "left_anti")
