"""Exact quantiles by distributed selection: counts per range of values, then only the range that holds the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.scratch import discard, materialize, meet

#: Ranges that a group's values are cut into in each round.
RANGES = 1024


def quantiles(rows: DataFrame, groups: list[str], value: str, wanted: dict[str, tuple[float, str]], ranges: int = RANGES, max_broadcast: int = 100_000) -> DataFrame:
    """(groups, a column for each of wanted): exact quantiles of value in each group. wanted: name -> (share, "linear" or "nearest").

    linear: between the two values next to place share * (n - 1); nearest: the value of rank ceil(share * n). Null values do
    not count; a group without values has no row; null is a group like any other; without groups there is one row at most.

    A round counts the values of each range of equal width in which a wanted rank is known to lie, with their least and
    greatest (combined before the shuffle: `ranges` rows a group and rank), and goes on with the one range that holds the
    rank, until all its values are one. A round leaves a thousandth of the width, so two or three do for most data; no
    task holds the values of a group.
    """
    kept = rows.select(*groups, F.to_json(F.struct(*groups, F.lit(1).alias("_"))).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    kept = materialize(kept, "values")
    sizes = kept.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), *(F.first(c).alias(c) for c in groups))
    sizes = materialize(sizes, "sizes")
    n, ranks = F.col("_n"), []
    for name, (share, kind) in wanted.items():
        low = F.floor((n - 1) * F.lit(share)) if kind == "linear" else F.greatest(F.ceil(n * F.lit(share)) - 1, F.lit(0))
        high = F.ceil((n - 1) * F.lit(share)) if kind == "linear" else low
        ranks += [F.struct(F.lit(f"{name}:{end}").alias("id"), at.cast("long").alias("rank")) for end, at in (("low", low), ("high", high))]
    state = sizes.select("_g", F.explode(F.array(*ranks)).alias("_t"), "lo", "hi").select("_g", "_t.id", "_t.rank", F.lit(0).cast("long").alias("before"), "lo", "hi")
    state, few = materialize(state, "ranks"), sizes.count() <= max_broadcast
    counts = sizes.select("_g", "_n")
    while state.where("lo < hi").limit(1).count():
        open_ = state.where("lo < hi").groupBy("_g").agg(F.collect_list(F.struct("id", "rank", "before", "lo", "hi")).alias("_open"))  # two for each of wanted
        met = kept.select("_g", "_v").join(F.broadcast(open_), "_g") if few else meet(kept.select("_g", "_v"), open_.join(counts, "_g"), ["_g"], "_n", ["_v"])
        inside = met.select("_g", "_v", F.explode(F.filter("_open", lambda t: (t["lo"] <= F.col("_v")) & (F.col("_v") <= t["hi"]))).alias("t"))
        at = F.least(F.lit(ranges - 1), F.floor((F.col("_v") / ranges - F.col("t.lo") / ranges) / (F.col("t.hi") / ranges - F.col("t.lo") / ranges) * ranges)).cast("int")
        counted = inside.groupBy("_g", "t", at.alias("_at")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        run = Window.partitionBy("_g", "t.id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.col("t.before") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
        held = counted.where((F.col("_before") <= F.col("t.rank")) & (F.col("t.rank") < F.col("_before") + F.col("_c")))
        new = held.select("_g", "t.id", "t.rank", F.col("_before").alias("before"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).unionByName(state.where("lo >= hi"))
        new = materialize(new, "ranks")
        discard(state)
        state = new
    found = state.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("id", "lo"))).alias("_f"))
    out = []
    for name, (share, kind) in wanted.items():
        low, high = F.col("_f")[f"{name}:low"], F.col("_f")[f"{name}:high"]
        place = (n - 1) * F.lit(share)
        out.append((F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high) if kind == "linear" else low).alias(name))
    return sizes.join(found, "_g").select(*groups, *out)


def with_quantiles(stats: DataFrame, found: DataFrame, groups: list[str]) -> DataFrame:
    """stats, a row for each group, with the columns of found; null where a group has no values."""
    if not groups:
        return stats.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    renamed = found.select(*(F.col(c).alias(f"_{c}") if c in groups else F.col(c) for c in found.columns))
    condition = F.lit(True)
    for c in groups:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stats.join(renamed, condition, "left").drop(*(f"_{c}" for c in groups))
