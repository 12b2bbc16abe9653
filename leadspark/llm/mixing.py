"""Mixing sources to target weights (native): capped water-filling and seeded repetition.

Each source gets a share of the budget by weight, but at most `max_epochs` times its size; what capped sources leave
is shared again by weight until no source is above its cap. The fixed point is one water level: sorted by cap/weight,
a prefix of the sources is capped and all others get level * weight, so two prefix sums over the table of sources
(one row each) replace the rounds. Documents are then repeated floor(target/size) times, and the fraction that is
left goes to the documents first in a seeded order, up to the document whose middle crosses the target.

Plan: two aggregations (by source, and by source and order bucket, of which there are 4096 or more; map-side combined,
so a hot source is only as many rows after them), one small window, and a join of the documents with one row per source. That table is
broadcast only after a count has shown it to be small; then documents with their texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.llm.common import materialize, word_count


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, weight): weights 1..cycle, repeating, by the sources' code points, null last. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select("source").distinct().select("source", ((F.row_number().over(order) - 1) % cycle + 1).cast("double").alias("weight"))


def fill(sizes: DataFrame, weights: DataFrame, max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """(source, source_size, target) for sizes (source, source_size) and weights (source, weight).

    A source without a weight, or with a weight of 0 or less, gets nothing. The budget is the sum of all sizes unless given.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select(
        "s.source", "source_size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double").alias("_w"))
    s = s.withColumn("_cap", F.when(F.col("_w") > 0, F.col("source_size") * F.lit(float(max_epochs))).otherwise(0.0))
    s = s.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(0.0))
    s = s.withColumns({
        "_budget": F.lit(budget).cast("double") if budget is not None else F.sum("source_size").over(everything).cast("double"),
        "_weights": F.sum("_w").over(everything)})
    level = lambda cap, weight: F.try_divide(F.col("_budget") - cap, F.col("_weights") - weight)
    s = s.withColumn("_level", level(F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_capped", (F.col("_w") <= 0) | F.coalesce(F.col("_ratio") <= F.col("_level"), F.lit(True)))
    s = s.withColumns({k: F.sum(F.when(F.col("_capped"), F.col(c)).otherwise(0.0)).over(everything) for k, c in (("_caps", "_cap"), ("_used", "_w"))})
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least("_cap", level(F.col("_caps"), F.col("_used")) * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"))


def order_key(doc_id: Column, seed: int) -> Column:
    """The seeded order: hexadecimal MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 0, budget: float | None = None,
        bucket_digits: int | None = None, size: Column | None = None, max_broadcast: int = 100_000) -> DataFrame:
    """docs with size, source_size, target, repeats (times the mix takes the document) and taken (words it takes).

    docs needs doc_id, text and source. A null text has size 0; null is a source of its own; rows that repeat are each
    a document; a table without rows gives none. Columns of docs with these result names are replaced.
    The same rows and seed give the same mix, however they are partitioned. The order is cut into 16 ** bucket_digits
    buckets a source, of which one is sorted; unless given, they grow with the rows, and the mix is the same.
    """
    added = ("size", "source_size", "target", "repeats", "taken")
    keep = [c for c in docs.columns if c not in added]
    size = word_count(F.col("text")) if size is None else size
    tie = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))) if "text" in docs.columns else F.lit(b"")
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), tie.alias("tie")), "mix")
    if bucket_digits is None:
        bucket_digits = max(3, math.ceil(math.log(max(1, sized.count() / 100_000), 16)))
    rank = order_key(F.col("doc_id"), seed)
    bucket = F.substring(rank, 1, bucket_digits)
    parts = sized.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_part"))
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = fill(total, cyclic_weights(total) if weights is None else weights, max_epochs, budget)
    epochs = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = targets.withColumn("_whole", F.floor(epochs).cast("int")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # the bucket in which the fraction ends: the only one whose documents need a running sum
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.withColumn("_start", F.coalesce(F.sum("_part").over(run), F.lit(0)))
    t, c = targets.alias("t"), cut.alias("c")
    cut = t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")) & (F.col("_start") <= F.col("_rest")) & (F.col("_start") + F.col("_part") > F.col("_rest"))).select(
        F.col("t.source").alias("_source"), "_bucket", "_start", "_rest")
    inside = sized.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (bucket == F.col("_bucket")))
    # equal rows (one id and text) are one entry with their number; the last entry that is taken gives some of its rows
    inside = inside.groupBy("_source", "_bucket", "_start", "_rest", rank.alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"), F.col("tie").alias("t")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("_source", "_bucket").orderBy("k", "d", "s", "t").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_free", F.col("_rest") - F.col("_start") - F.coalesce(F.sum(F.col("s") * F.col("n")).over(run), F.lit(0)))
    fits = F.when(F.col("s") == 0, F.when(F.col("_free") >= 0, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor((2 * F.col("_free") - F.col("s")) / (2 * F.col("s"))) + 1))
    last = inside.withColumn("_fits", fits).where("_fits > 0").groupBy("_source").agg(F.max(F.struct("k", "d", "s", "t", F.col("_fits").alias("f"), "n")).alias("_last"))
    cut = cut.alias("c").join(last.alias("l"), F.col("c._source").eqNullSafe(F.col("l._source")), "left").select("c._source", "c._bucket", "l._last")
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_leadspark_source"), "source_size", "target", F.col("_whole").alias("_leadspark_whole"), F.col("_bucket").alias("_leadspark_cut"),
        F.when(F.col("_last").isNotNull(), F.struct("_last.k", "_last.d", "_last.s", "_last.t")).alias("_leadspark_last"), F.when(F.col("_last.f") < F.col("_last.n"), F.col("_last.f")).alias("_leadspark_few"))
    plan = materialize(plan, "plan")
    some = plan.where("_leadspark_few is not null").limit(1).count() > 0
    plan = F.broadcast(plan) if plan.count() <= max_broadcast else plan  # a row per source
    out = docs.select(*keep, size.alias("size")).join(plan, F.col("source").eqNullSafe(F.col("_leadspark_source")), "left")
    place = F.struct(rank.alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"), tie.alias("t"))
    in_cut = bucket == F.col("_leadspark_cut")
    extra = F.coalesce((bucket < F.col("_leadspark_cut")) | (in_cut & (place <= F.col("_leadspark_last"))), F.lit(False))

    def taken(rows: DataFrame, extra: Column) -> DataFrame:
        repeats = F.col("_leadspark_whole") + extra.cast("int")
        return rows.select(*keep, "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))

    if not some:
        return taken(out, extra)
    # of equal rows at the end of a source's share, the first few are taken: they alone are numbered
    equal = F.coalesce(F.col("_leadspark_few").isNotNull() & in_cut & (place == F.col("_leadspark_last")), F.lit(False))
    number = F.row_number().over(Window.partitionBy("_leadspark_source").orderBy("size"))
    return taken(out.where(~equal), extra).unionByName(taken(out.where(equal).withColumn("_leadspark_i", number), F.col("_leadspark_i") <= F.col("_leadspark_few")))
