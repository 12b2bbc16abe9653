"""Evaluation of extractions: rates, confusion by field, availability, exposure, and samples of conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import signals as g
from leadspark.functions.text import normalize_key
from leadspark.operators.quantiles import quantiles, with_quantiles
from leadspark.scratch import materialize


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def benchmark_metrics(rows: DataFrame) -> DataFrame:
    """One row from parsed outcomes (payload, latency_ms): success and schema rates, latency of successes, evidence rate."""
    ok = F.coalesce(F.col("payload.success"), F.lit(False))
    extracted, proven = F.sum(g.fields_extracted(F.col("payload"))), F.sum(g.fields_with_evidence(F.col("payload")))
    median = quantiles(rows.select(F.when(ok, F.col("latency_ms")).alias("ms")), [], "ms", {"median_ms": (0.5, "linear")})
    stats = rows.agg(F.count("*").alias("requests"), _rate(F.count_if(ok), F.count("*")).alias("success_rate"), _rate(F.count_if(F.col("payload.schema_valid")), F.count("*")).alias("schema_rate"), F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_ms"),
                     extracted.alias("fields_extracted"), proven.alias("fields_with_evidence"), _rate(proven, extracted).alias("evidence_rate"))
    return with_quantiles(stats, median, [])


def availability(rows: DataFrame) -> DataFrame:
    """One row from attempts (ok, latency_ms, error if there): rates and latency; p95 by nearest rank."""
    e = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    share = lambda cond: _rate(F.count_if(F.coalesce(cond, F.lit(False))), F.count("*"))
    x = F.col("latency_ms")
    places = quantiles(rows, [], "latency_ms", {"median_ms": (0.5, "linear"), "p95_ms": (0.95, "nearest")}).withColumn("p95_ms", F.col("p95_ms").cast("long"))
    stats = rows.agg(F.count("*").alias("attempts"), share(F.col("ok")).alias("ok_rate"), share(g.is_rate_limit(e)).alias("rate_limited"), share(g.is_timeout(e)).alias("timeouts"), F.avg(x).alias("mean_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"))
    return with_quantiles(stats, places, [])


def _class(name: str, gold: Column, pred: Column) -> Column:
    if name in g.BOOLS:
        a, b = F.coalesce(gold, F.lit(False)), F.coalesce(pred, F.lit(False))
        return F.when(a & b, "tp").when(~a & ~b, "tn").when(b, "fp").otherwise("fn")
    if name in g.AMOUNTS:
        same = F.abs(gold - pred) <= F.greatest(F.lit(1.0), F.abs(gold) * 0.10)
    else:
        gold, pred = F.nullif(normalize_key(gold), F.lit("")), F.nullif(normalize_key(pred), F.lit(""))
        same = gold == pred
    return F.when(gold.isNull() & pred.isNull(), "tn").when(gold.isNull(), "fp").when(pred.isNull(), "fn").when(same, "tp").otherwise("wrong")


def field_confusion(gold: DataFrame, pred: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, field, class) for the eight fields: tp, fp, fn, tn or wrong."""
    a, b = gold.alias("a"), pred.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    rows = F.array(*(F.struct(F.lit(n).alias("field"), _class(n, F.col(f"a.{n}"), F.col(f"b.{n}")).alias("class")) for n in g.FIELDS))
    return both.select(F.col(f"a.{key}").alias(key), F.explode(rows).alias("r")).select(key, "r.field", "r.class")


def field_metrics(confusion: DataFrame) -> DataFrame:
    """A row per field and one for all: a wrong value counts as false positive and as false negative."""
    n = {c: F.count_if(F.col("class") == c) for c in ("tp", "fp", "fn", "tn", "wrong")}
    counts = confusion.groupBy("field").agg(F.count("*").alias("total"), n["tp"].alias("tp"), (n["fp"] + n["wrong"]).alias("fp"), (n["fn"] + n["wrong"]).alias("fn"), n["tn"].alias("tn"), n["wrong"].alias("wrong"), (n["tn"] + n["fn"]).alias("_null"))
    both = counts.unionByName(counts.agg(F.lit("overall").alias("field"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "wrong", "_null"))).withColumn("total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).select(*counts.columns))
    return both.select("field", "total", "tp", "fp", "fn", "tn", "wrong", _rate(F.col("tp") + F.col("tn"), F.col("total")).alias("accuracy"), _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _rate(F.col("_null"), F.col("total")).alias("null_rate"))


def error_analysis(gold: DataFrame, pred: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, field, kind) of the mismatches: the class, or the two confusions between down payment and budget or payment form."""
    miss = field_confusion(gold, pred, key).where("class not in ('tp', 'tn')").select(key, "field", F.col("class").alias("kind"))
    a, b = gold.alias("a"), pred.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    budget = both.where("a.cuota_inicial is not null and a.presupuesto is null and b.presupuesto = a.cuota_inicial").select(F.col(f"a.{key}").alias(key), F.lit("presupuesto").alias("field"), F.lit("down_payment_as_budget").alias("kind"))
    implied = both.where("a.cuota_inicial is not null and a.forma_pago is null and b.forma_pago = 'financiacion'").select(F.col(f"a.{key}").alias(key), F.lit("forma_pago").alias("field"), F.lit("down_payment_implies_financing").alias("kind"))
    return miss.unionByName(budget).unionByName(implied)


PATTERNS = {"inicial": ["inicial", "entrada", "enganche"], "sin_inicial": ["no tengo inicial", "sin inicial"], "financiacion": ["financiad", "credito"], "contado": ["contado", "efectivo"], "cita": ["visit", "cita", "agendar", "voy"], "cotizacion": ["cotiz"],
            "precio": ["precio", "cuanto vale"], "objecion": ["caro", "cara", "no me alcanza", "descuento"], "interes": ["me interesa", "la quiero"], "mirando": ["mirando", "averiguando"], "presupuesto": ["presupuesto", "tengo hasta"], "monto": ["millon", "$"]}


def pattern_exposure(talks: DataFrame) -> DataFrame:
    """(pattern, n, share): conversations whose customer texts hold each pattern."""
    text = F.array_join(F.transform(g.customer_texts(F.col("messages")), normalize_key), " || ")
    flags = talks.select(text.alias("t")).select(*(reduce(lambda a, b: a | b, (F.col("t").contains(c) for c in cues)).alias(n) for n, cues in PATTERNS.items()))
    sums = flags.agg(F.count("*").alias("_all"), *(F.count_if(F.col(n)).alias(n) for n in PATTERNS))
    return sums.select("_all", F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n")) for n in PATTERNS))).alias("r")).select("r.pattern", "r.n", _rate(F.col("r.n"), F.col("_all")).alias("share"))


#: What a conversation's customer texts hold to count for a quota of the gold sample, in the order of the quotas.
QUOTAS = (("initial", ("inicial", "entrada", "enganche"), 18), ("no_initial", ("no tengo inicial", "sin inicial"), 4), ("payment_form", ("financiad", "credito", "contado"), 18),
          ("objection", ("muy caro", "muy cara", "otra marca", "mas economico", "solo mirando", "no me alcanza", "tasa", "descuento"), 15), ("appointment", ("visit", "pasar", "cita", "agendar", "manana voy", "voy manana"), 15),
          ("quote", ("cotiz", "mandela", "enviela", "mandemela"), 15), ("multi_model", (), 15), ("high_intent", ("me sirve", "la quiero", "ya voy", "hagale", "la separo"), 10), ("short", (), 10), ("long", (), 10),
          ("informative", ("informacion", "cuanto vale", "precio"), 10))


def quota_steps(text: Column, messages: Column, models: Column | None = None) -> list[tuple[str, Column, int]]:
    """The quotas of the gold sample as steps of take_in_order; models: how many products the customer named."""
    own = {"multi_model": F.lit(False) if models is None else models >= 2, "short": messages <= 4, "long": messages >= 8}
    return [(name, own[name] if name in own else reduce(lambda a, b: a | b, (text.contains(c) for c in cues)), quota) for name, cues, quota in QUOTAS]


def _heads(rows: DataFrame, steps: list[tuple[str, Column, int]], key: str, order: list[Column], most: int, *more: Column) -> dict[int, list]:
    """For each step the first `most` rows, by order, that meet its predicate: what a bounded choice can depend on. One job."""
    sort = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    parts = [rows.where(F.coalesce(predicate, F.lit(False))).orderBy(*order).limit(most).select(F.lit(i).alias("_step"), F.col(key).alias("_key"), *sort, *more) for i, (_, predicate, _) in enumerate(steps)]
    found: dict[int, list] = {i: [] for i in range(len(steps))}
    for r in reduce(DataFrame.unionByName, parts).collect():  # at most steps * most rows
        found[r["_step"]].append(r)
    return {i: sorted(v, key=lambda r: tuple(r[f"_o{j}"] for j in range(len(order)))) for i, v in found.items()}


def _labelled(rows: DataFrame, key: str, picked: dict) -> DataFrame:
    table = rows.sparkSession.createDataFrame([(k, label, i) for i, (k, label) in enumerate(picked.items())], f"`{key}` {dict(rows.dtypes)[key]}, label string, place int")
    return rows.join(F.broadcast(table), key)  # at most the sum of the quotas


def take_in_order(rows: DataFrame, steps: list[tuple[str, Column, int]], key: str, order: list[Column], forced: tuple = ()) -> DataFrame:
    """rows with label and place, picked by a list of (label, predicate, quota): each step takes the first quota rows, by
    order (ascending, no nulls), that none before has taken; `forced` keys that exist come first. A sampling operator."""
    steps = [("forced", F.col(key).isin(*forced), len(forced)), *steps] if forced else steps
    heads = _heads(rows, steps, key, order, sum(q for _, _, q in steps))
    picked: dict = {}
    for i, (label, _, quota) in enumerate(steps):
        new = [r["_key"] for r in heads[i] if r["_key"] not in picked][:quota]
        picked |= dict.fromkeys(new, label)
    return _labelled(rows, key, picked)


def row_index(rows: DataFrame, key: str) -> DataFrame:
    """(key, index) from 0 in the order of key: sorted ranges, and the sizes of those before each. No task holds all rows."""
    numbered = materialize(rows.select(key).orderBy(key).select(key, F.monotonically_increasing_id().alias("_i")), "numbered")
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["count"]) for r in numbered.groupBy(part.alias("p")).count().collect())  # one for each range
    starts = [(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes]
    table = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return numbered.join(F.broadcast(table), part == F.col("_p")).select(key, (F.col("_start") + place).alias("index"))


def stratified_sample(rows: DataFrame, steps: list[tuple[str, Column, int]], key: str, target: int, forced: tuple = ()) -> DataFrame:
    """take_in_order by key, then every n-th row of the whole table in key order until target is reached; the first target rows by key. label tells why."""
    picked = take_in_order(rows, steps, key, [F.col(key)], forced).select(*rows.columns, "label")
    n = picked.count()
    if n < target:
        stride = max(1, rows.count() // (target - n))
        more = row_index(rows, key).where(F.col("index") % stride == 0).select(key).join(picked.select(key), key, "left_anti").orderBy(key).limit(target - n)
        picked = picked.unionByName(rows.join(F.broadcast(more), key).withColumn("label", F.lit("fill")).select(*picked.columns))
    return picked.orderBy(key).limit(target)


def select_cases(rows: DataFrame, predicates: list[tuple[str, Column]], key: str, order: list[Column], length: Column, limit: int = 10) -> DataFrame:
    """One row not yet taken for each predicate, in order, then the shortest of the others, up to limit; label tells why."""
    cases = take_in_order(rows, [(label, p, 1) for label, p in predicates][:limit], key, order)
    left = rows.join(cases.select(key), key, "left_anti").orderBy(length, key).limit(max(0, limit - cases.count()))
    return cases.drop("place").unionByName(left.withColumn("label", F.lit("adicional")).select(*rows.columns, "label"))


def cover_cases(rows: DataFrame, categories: list[tuple[str, Column]], key: str, first: object = None, limit: int = 10) -> DataFrame:
    """Rows, with label and place, that cover the categories: `first` if there, then for each category that no taken row has
    the first row, by key, with it; then the first others up to limit. A sampling operator: what it may take is bounded."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in categories))).alias("_has")
    steps = [("must", F.col(key) == F.lit(first), 1), *((name, p, 1) for name, p in categories), ("fill", F.lit(True), limit)]
    heads = _heads(rows, steps, key, [F.col(key)], len(categories) + limit + 1, held)
    picked: dict = {}
    covered: set = set()
    for i, (label, _, quota) in enumerate(steps):
        if label in covered:
            continue
        for r in [r for r in heads[i] if r["_key"] not in picked][: quota if label != "fill" else max(0, limit - len(picked))]:
            picked[r["_key"]] = label
            covered.update(r["_has"])
    return _labelled(rows, key, dict(list(picked.items())[:limit]))
