"""Matching of product texts against the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.functions.fields import normalize_model_text
from leadspark.scratch import discard, materialize

FUZZY = 0.90


def _keys(catalog: DataFrame) -> DataFrame:
    """(skus, key, brand): rows of SKUs with each key that they have; products of one brand and line are normalised once."""
    lines = catalog.groupBy("brand", "line").agg(F.collect_set("sku").alias("skus"))
    brand, line = normalize_model_text(F.col("brand")), normalize_model_text(F.col("line"))
    keys = F.array_distinct(F.array(normalize_model_text(F.concat_ws(" ", "brand", "line")), line, F.concat_ws(" ", brand, line)))
    named = F.array_append(F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.struct(k.alias("key"), F.lit(False).alias("brand"))), F.struct(brand.alias("key"), F.lit(True).alias("brand")))
    return lines.select("skus", F.explode(named).alias("k")).select("skus", "k.key", "k.brand")


def catalog_index(catalog: DataFrame) -> DataFrame:
    """(key, skus, brand): SKUs, sorted, of each key (brand and line, or line) and of each brand key (brand true)."""
    return _keys(catalog).groupBy("key", "brand").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("skus")))).alias("skus"))


def _few_skus(catalog: DataFrame) -> DataFrame:
    """catalog_index() with the first and last SKU of each key: one is one, two are several."""
    ends = _keys(catalog).select("key", "brand", F.array_min("skus").alias("a"), F.array_max("skus").alias("b")).groupBy("key", "brand")
    return ends.agg(F.array_compact(F.array_distinct(F.array(F.min("a"), F.max("b")))).alias("skus"))


def _prefixes(c):
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))


def _grams(c, q: int):
    """Runs of q characters, numbered by their repetition: two texts share as many of these as runs with repetition.

    The runs are bound once, as the element of an array: named inside the inner lambda, they would be cut anew for each run.
    """
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.substring(c, i, F.lit(q)))
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    return F.when(F.length(c) >= q, F.element_at(F.transform(F.array(runs), numbered), 1)).otherwise(F.array().cast("array<string>"))


def _ratios(batches):
    import difflib

    import pandas as pd

    m = difflib.SequenceMatcher()
    for part in batches:
        score = []
        for a, b in zip(part["key"], part["other"], strict=True):
            m.set_seqs(a, b)
            score.append(m.ratio())
        yield pd.DataFrame({"key": part["key"], "skus": part["skus"], "score": score})


def _candidates(t: DataFrame, k: DataFrame, least_ratio: float, q: int, shared: int = 4, block: int = 1_000_000, max_broadcast: int = 1_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """(key, other, skus), and the tables it reads: pairs of t (key, least) and k (other, skus) among which all of a ratio of the text's least or more are; least_ratio is at most any least.

    A ratio of 2 m / (a + b) >= r leaves s = a - m characters of one text and u = b - m of the other unmatched, with
    (2 - r) s + r u <= 2 a (1 - r). Each of the former breaks q of a text's runs of q characters, each of the latter
    q - 1, so at most `broken` of its runs. By one order for both sides the first `broken` + shared runs of each hold the
    first `shared` common runs (or all that must be left). The order is by rarity; an equi-join on these runs counts
    them, and lengths and the number of all common runs cut the pairs further. A run with many pairs is dealt to several
    tasks: the longer of its two lists by hash, the shorter in copies.
    """
    t = materialize(t.select("key", "least", _grams(F.col("key"), q).alias("g")), "grams")
    k = materialize(k.select(F.col("key").alias("other"), "skus", _grams(F.col("key"), q).alias("h")), "grams")
    count = lambda df, grams, n: df.select(F.explode(grams).alias("r")).groupBy("r").agg(F.count("*").alias(n))
    # a row for each run of q characters of normalised texts, with its number of repetitions
    often = count(k, "h", "nk").join(count(t, "g", "nt"), "r", "full").select("r", F.coalesce("nk", F.lit(0)).alias("nk"), F.coalesce("nt", F.lit(0)).alias("nt"))
    often = materialize(often.withColumn("parts", F.greatest(F.lit(1), F.least(F.ceil(F.col("nk") * F.col("nt") / block), F.greatest("nk", "nt"))).cast("int")), "runs")
    few_runs = often.count() <= max_broadcast

    def rare(df, name, grams, mine, theirs, least):
        held = df.select(name, least.alias("_r"), F.explode(grams).alias("r")).join(F.broadcast(often) if few_runs else often, "r")
        ranked = held.groupBy(name, "_r").agg(F.array_sort(F.collect_list(F.struct("nk", "r", "nt", "parts"))).alias("o")).withColumn("most", F.greatest(q / (2 - F.col("_r")), (q - 1) / F.col("_r")) * 2 * (1 - F.col("_r")))
        broken = F.floor(F.length(name) * F.col("most") + 1e-9).cast("int")
        least = F.least(F.lit(shared), F.size("o") - broken).alias(f"_{name}")
        first = ranked.select(name, least, F.explode(F.slice("o", F.lit(1), broken + shared)).alias("_r"))
        longer = (F.col(f"_r.{mine}") > F.col(f"_r.{theirs}")) | ((F.col(f"_r.{mine}") == F.col(f"_r.{theirs}")) & F.lit(mine == "nt"))
        own = F.pmod(F.xxhash64(name), F.col("_r.parts")).cast("int")
        return first.where(F.col(f"_r.{theirs}") > 0).select(name, f"_{name}", F.col("_r.r").alias("r"), F.explode(F.when(longer, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("_r.parts") - 1))).alias("part"))

    pairs = rare(t, "key", "g", "nt", "nk", F.col("least")).join(rare(k, "other", "h", "nk", "nt", F.lit(least_ratio)), ["r", "part"])
    a, b = F.length("key"), F.length("other")
    near = lambda x, y, r: x * r <= y * (2 - r) + 1e-9
    pairs = pairs.where(near(a, b, F.lit(least_ratio)) & near(b, a, F.lit(least_ratio))).groupBy("key", "other", "_key", "_other").agg(F.count("*").alias("_n"))
    pairs = pairs.where(F.col("_n") >= F.greatest("_key", "_other")).select("key", "other")
    m = F.ceil((a + b) * (F.col("least") / 2) - 1e-9)
    pairs = pairs.join(t, "key").where(near(a, b, F.col("least")) & near(b, a, F.col("least"))).join(k, "other").where(F.size(F.array_intersect("g", "h")) >= F.size("g") - q * (a - m) - (q - 1) * (b - m))
    return pairs.select("key", "other", "skus"), [t, k, often]


def _best(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """(key, skus, score): the highest ratio of each key of pairs (key, other, skus) and the SKUs of all keys that have it."""
    scored = pairs.mapInPandas(_ratios, "key string, skus array<string>, score double")
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.groupBy("key", "score").agg(F.array_distinct(F.flatten(F.collect_list("skus"))).alias("skus")).groupBy("key").agg(F.max_by("skus", "score").alias("skus"), F.max("score").alias("score"))


#: Levels of nearest keys below FUZZY: least ratio, length of the runs, shortest text whose runs of that length can be counted.
BELOW = ((0.8, 2, 4), (0.7, 2, 14), (0.5, 1, 1), (0.3, 1, 1), (0.0, 1, 1))


def similar_keys(texts: DataFrame, keys: DataFrame, levels: tuple[tuple[float, int], ...] = ((0.96, 3), (FUZZY, 2)), below: bool = True) -> DataFrame:
    """(key, score, fuzzy_sku): texts (key) with the ratio of the most similar keys (key, skus); fuzzy_sku: their SKU if it is only one and the ratio that of the last level or more.

    levels: (ratio, length of the runs), falling. A level finds all keys of its ratio (_candidates), so a text that it
    finds a key for has its most similar ones there, and only the others go on to the next, wider level. Texts without a
    key of the last level go on to nearest_keys(), or without `below` have no row. The result does not depend on levels.
    """
    found = []
    for ratio, q in levels:
        pairs, tables = _candidates(texts.select("key", F.lit(ratio).alias("least")), keys, ratio, q)
        found.append(materialize(_best(pairs, ratio), "similar"))
        discard(*tables)
        texts = texts.join(found[-1].select("key"), "key", "left_anti")
    if below:
        rest = materialize(texts.select("key"), "rest")
        if rest.limit(1).count():
            found.append(nearest_keys(rest, keys))
    best = reduce(DataFrame.unionByName, found)
    return best.select("key", F.round("score", 4).alias("score"), F.when((F.size("skus") == 1) & (F.col("score") >= levels[-1][0]), F.get("skus", F.lit(0))).alias("fuzzy_sku"))


def nearest_keys(texts: DataFrame, keys: DataFrame, seeds: int = 20) -> DataFrame:
    """(key, score, skus): the highest ratio that any of keys (key, skus) has to each of texts (key), whatever it is; 0 where no character is shared.

    First a lower bound: the best of some keys that share a rare pair of characters with the text, `seeds` for each of its
    rarest pairs. No key counts from there on whose shared runs rule that ratio out, so each text meets only the keys whose
    upper bound reaches what it has already; a text is done in one level, that of its own bound, and keys need only be
    laid out for the levels that some text has. The bound changes the work and not the result.
    """
    runs = lambda df, name: df.select(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(2))))).alias("r"))
    k = keys.select(F.col("key").alias("other"), "skus")
    mine = runs(texts, "key")
    nearby = runs(k, "other").join(mine.select("r").distinct(), "r")
    some = nearby.withColumn("_i", F.row_number().over(Window.partitionBy("r").orderBy(F.xxhash64("other"), "other"))).where(F.col("_i") <= seeds)
    often = nearby.groupBy("r").agg(F.count("*").alias("n"))
    rarest = mine.join(often, "r").withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy("n", "r"))).where("_i <= 4")
    seeded = _best(rarest.select("key", "r").join(some.select("r", "other"), "r").select("key", "other").distinct().join(k, "other"))
    bounds = materialize(texts.join(seeded.select("key", "score"), "key", "left").select("key", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.001)).alias("least")), "bounds")
    level = F.lit(len(BELOW) - 1)
    for i, (ratio, _, shortest) in reversed(list(enumerate(BELOW))):
        level = F.when((F.col("least") >= ratio) & (F.length("key") >= shortest), i).otherwise(level)
    bounds = bounds.withColumn("level", level)
    found, done = [], []
    for i in sorted(r.level for r in bounds.select("level").distinct().collect()):
        ratio, q, _ = BELOW[i]
        pairs, tables = _candidates(bounds.where(F.col("level") == i), keys, max(ratio, 0.001), q)
        found.append(materialize(_best(pairs), "nearest"))
        done += tables
    discard(*done)
    best = reduce(DataFrame.unionByName, found)
    return texts.join(best, "key", "left").select("key", F.coalesce("skus", F.array().cast("array<string>")).alias("skus"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _begun(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, other): texts (key) with the keys that they begin or that begin them."""
    other = keys.select(F.col("key").alias("other"))
    longer = other.select(F.explode(_prefixes(F.col("other"))).alias("key"), "other").join(texts, "key")
    shorter = texts.select("key", F.explode(_prefixes(F.col("key"))).alias("other")).join(other, "other")
    return longer.select("key", "other").unionByName(shorter.select("key", "other"))


def _lists(known: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, candidates): the SKUs, joined by |, of each of known (key, match_type) that is ambiguous."""
    index = materialize(catalog_index(catalog), "index")
    keys, brands = index.where("not brand").select("key", "skus"), index.where("brand").select("key", "skus")
    of = lambda kind: known.where(F.col("match_type") == kind).select("key")
    begun = _begun(of("prefijo_ambiguo"), keys).join(keys.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("skus")))).alias("skus"))
    out = of("directo_ambiguo").join(keys, "key").unionByName(of("solo_marca").join(brands, "key")).unionByName(begun)
    return out.select("key", F.array_join("skus", "|").alias("candidates"))


def candidate_lists(matched: DataFrame, catalog: DataFrame, text: str = "model_text_raw") -> DataFrame:
    """(text, candidates): a row for each ambiguous text of matched, the result of match_models(); joined to it on the text, it is the column candidates."""
    texts = matched.where("match_state = 'ambiguous'").select(text, "match_type").distinct().withColumn("key", normalize_model_text(F.col(text)))
    texts = materialize(texts, "ambiguous")
    return texts.select(text, "key").join(_lists(texts.select("key", "match_type").distinct(), catalog), "key").select(text, "candidates")


def _with_lists(rows: DataFrame, lists: DataFrame, spread: list[str], most_bytes: int = 64 << 20, page: int = 1 << 18, task_bytes: int = 2 << 30) -> DataFrame:
    """rows (_key, null if it has no list) with candidates of lists (key, candidates). spread: columns by whose hash rows of one key are dealt.

    Lists of at most most_bytes together are broadcast, after rows are dealt so that a task meets lists of about `page`
    bytes together, or one long one: a Parquet writer then keeps each list once in its dictionary, where otherwise it would
    drop that and hold thousands of copies of the longest lists until it looks at its size again. A long list's rows are
    dealt to as many tasks as they give output of task_bytes. With more lists than that, each is copied to as many tasks,
    and rows stay in the order they come in and are not sorted by key, so short and long lists mix.
    """
    lists = materialize(lists.withColumnRenamed("key", "_key"), "lists")
    length = F.octet_length("candidates")
    total = lists.agg(F.sum(length)).first()[0] or 0
    if total <= 2 * page:
        return rows.join(F.broadcast(lists), "_key", "left")
    n = materialize(rows.groupBy("_key").agg(F.count("*").alias("_n")), "sizes")
    parts = F.greatest(F.lit(1), F.least("_n", F.ceil(F.col("_n") * length / task_bytes))).cast("int").alias("_parts")
    own = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1)))
    if total <= most_bytes:
        many = 1_000_000  # rows of a task
        long = lists.join(n, "_key").where((length > page // 4) | (F.col("_n") > many)).select("_key", F.greatest(parts, F.ceil(F.col("_n") / many).cast("int")).alias("_parts"))
        # at most most_bytes / page * 4 lists are long, and one in a million rows
        long = materialize(long.withColumn("_first", F.sum("_parts").over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1))), "long")
        short = max(-(-total // page), -(-(n.agg(F.sum("_n")).first()[0] or 0) // (many // 10)))
        tasks = short + (long.agg(F.sum("_parts")).first()[0] or 0)
        place = F.when(F.col("_parts").isNotNull(), short + F.coalesce("_first", F.lit(0)) + own).otherwise(F.pmod(F.when(F.col("_key").isNotNull(), F.xxhash64("_key")).otherwise(F.xxhash64(*spread)), F.lit(short)))
        dealt = rows.join(F.broadcast(long), "_key", "left").withColumn("_task", place.cast("int")).drop("_parts", "_first")
        return dealt.repartitionById(tasks, "_task").drop("_task").join(F.broadcast(lists), "_key", "left")
    parts = materialize(lists.join(n, "_key").select("_key", parts), "parts")
    copies = lists.join(parts, "_key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = rows.join(F.broadcast(parts) if parts.count() <= 1_000_000 else parts, "_key", "left").withColumn("_part", own.cast("int"))
    return dealt.join(copies.hint("shuffle_hash"), ["_key", "_part"], "left").drop("_part", "_parts")


def match_models(leads: DataFrame, catalog: DataFrame, text: str = "model_text_raw", fuzzy: bool = True, candidates: bool = True, spread: list[str] | None = None, max_broadcast: int = 500_000) -> DataFrame:
    """leads with sku, match_state, match_type, match_score, and with `candidates` the column candidates (joined by |).

    Texts are matched once each: distinct texts are normalised, and the cascade runs on distinct keys, cheap steps first:
    the key itself, a brand alone, a prefix either way (equi-joins on prefixes), then similarity of at least 0.9 to one
    SKU's keys (similar_keys). match_score is the ratio of the most similar keys for every text that the steps before
    leave, matched or not. Until then at most two SKUs of a key are carried, which tell one from several. Whole lists of
    candidates grow with the catalogue and stand in each lead of a brand, so only callers that read them ask for them. spread: columns that tell leads apart, all if not given.
    """
    raw = leads.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    raw = materialize(raw.withColumn("_key", normalize_model_text(F.col("_text"))), "texts")
    texts = raw.select(F.col("_key").alias("key")).where("key <> ''").distinct()
    index = materialize(_few_skus(catalog), "index")  # each step and level reads it
    keys, brands = index.where("not brand").select("key", "skus"), index.where("brand").select("key", F.col("skus").alias("brand_skus"))
    step = materialize(texts.join(keys, "key", "left").join(brands, "key", "left"), "direct")
    rest = step.where("skus is null and brand_skus is null").select("key")
    near = materialize(_begun(rest, keys), "prefixes")
    prefix = near.join(keys.select(F.col("key").alias("other"), "skus"), "other").withColumn("s", F.explode("skus")).groupBy("key").agg(F.array_distinct(F.array(F.min("s"), F.max("s"))).alias("prefix_skus"))
    step = step.join(prefix, "key", "left")
    found = F.coalesce("skus", "brand_skus", "prefix_skus")
    score, fuzzy_sku = F.lit(None).cast("double"), F.lit(None).cast("string")
    if fuzzy:
        step = materialize(step, "cascade")
        step = step.join(similar_keys(step.where(found.isNull()).select("key"), keys), "key", "left")
        score, fuzzy_sku = F.col("score"), F.col("fuzzy_sku")
    kind = (F.when(F.size("skus") == 1, "directo_unico").when(F.size("skus") > 1, "directo_ambiguo").when(F.col("brand_skus").isNotNull(), "solo_marca")
            .when(F.size("prefix_skus") == 1, "prefijo_unico").when(F.size("prefix_skus") > 1, "prefijo_ambiguo").when(fuzzy_sku.isNotNull(), "fuzzy").otherwise("sin_match"))
    step = step.withColumn("match_type", kind).withColumn("match_score", score)
    single = F.col("match_type").isin("directo_unico", "prefijo_unico")
    several = F.col("match_type").isin("directo_ambiguo", "solo_marca", "prefijo_ambiguo")
    step = step.select("key", F.when(single, F.get(found, F.lit(0))).otherwise(fuzzy_sku).alias("sku"), F.when(several, "ambiguous").when(F.col("match_type") == "sin_match", "unmatched").otherwise("matched").alias("match_state"), "match_type", "match_score")
    each = materialize(raw.join(step, F.col("_key") == F.col("key"), "left").drop("key"), "matches")
    each = each if candidates else each.drop("_key")
    out = leads.join(F.broadcast(each) if each.count() <= max_broadcast else each, F.col(text) == F.col("_text"), "left").drop("_text")
    if candidates:
        known = each.where("match_state = 'ambiguous'").select(F.col("_key").alias("key"), "match_type").distinct()
        out = _with_lists(out.withColumn("_key", F.when(F.col("match_state") == "ambiguous", F.col("_key"))), _lists(known, catalog), spread or leads.columns).drop("_key").withColumn("candidates", F.coalesce("candidates", F.lit("")))
    empty = F.col("match_state").isNull()
    # a text without letters and digits has no key: nothing matches it
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    return out.withColumns({"match_state": F.when(empty, F.when(blank, "empty").otherwise("unmatched")).otherwise(F.col("match_state")), "match_type": F.when(empty, F.when(blank, "vacio").otherwise("sin_match")).otherwise(F.col("match_type"))})
