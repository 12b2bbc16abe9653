"""Signals of conversations: extraction, validation against literal quotes, versions, and consolidation per lead."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import signals as g
from leadspark.functions.text import normalize_for_match, normalize_key, trim
from leadspark.scratch import materialize

OUTCOME = "conversation_id string, success boolean, latency_ms long, raw_text string, error string"
# Cues of the built-in extractor.
HIGH = ["me sirve", "esa si me sirve", "la quiero", "quiero esa", "la voy a comprar", "la separo", "separo la moto", "separemela", "separela", "ya voy", "voy en camino", "hagale pues", "como hago para sacarla", "me la llevo", "la compro", "ya tengo la plata", "voy esta tarde", "voy saliendo", "voy para alla", "voy hoy", "la necesito ya"]
MEDIUM = ["me interesa", "estoy interesado", "me gusta", "quisiera", "estoy buscando", "la necesito", "necesito la moto", "quiero una moto", "estoy pensando en comprar", "hablo con mi esposa"]
LOW = ["solo mirando", "solo estaba mirando", "estoy mirando", "estaba viendo una usada", "usada mas barata", "estoy averiguando", "averiguando", "mirando precios", "no tengo inicial", "no tengo con que dar la inicial", "mas economico", "otra marca", "estoy comparando", "comparando", "estoy pensando", "lo estoy pensando", "pensarlo", "aun no", "sin inicial", "por curiosidad", "curiosidad", "se me sale", "por encima de lo que tengo", "es mucho"]
INFORMATIVE = ["informacion", "cuanto vale", "cuanto cuesta", "horario", "ubicacion", "donde estan", "donde queda", "que precio tiene", "preguntar"]
FINANCED = ["financiada", "financiado", "financiacion", "a credito", "credito", "de credito"]
CASH = ["de contado", "al contado", "contado", "efectivo"]
DOWN = ["inicial", "entrada", "enganche"]
NO_DOWN = ["no tengo inicial", "sin inicial", "no tengo para la inicial", "no tengo con que dar la inicial", "no tengo plata", "no tengo con que"]
NOT_BUDGET = ["para la inicial", "de inicial", "para inicial"]
BUDGET = ["tengo hasta", "presupuesto", "puedo pagar", "cuento con", "tengo pensado gastar"]
OBJECTIONS = {
    "financiacion": ["tasa muy alta", "interes muy alto", "intereses muy altos", "esa tasa", "la inicial esta muy alta", "inicial esta muy alta"], "cuota": ["cuota muy alta", "cuota alta", "la cuota me queda alta", "cuota esta muy alta"],
    "precio": ["algo mas economico", "mas economico", "usada mas barata", "usadas mas baratas", "muy caro", "muy cara", "costosa", "costoso", "muy alta", "no me alcanza", "fuera de presupuesto", "se me sale del presupuesto", "se me sale", "descuento", "mejor precio", "interes esta caro", "esta caro"],
    "disponibilidad": ["no tienen usadas", "no hay usadas", "no manejan", "no hay disponible", "no tienen disponible", "disponibilidad"],
    "otra": ["otra marca", "otro modelo", "prefiero otra", "me gusta otra", "otra opcion", "otra por menos plata", "me estan ofreciendo otra", "datacredito", "reportado", "reporte viejo", "centrales de riesgo"]}
VISIT = ["a que hora los puedo visitar", "puedo pasar", "puedo ir", "los visito", "visitar", "pasar por", "ir al concesionario", "ir a la sucursal", "agendar", "cita", "voy manana", "manana voy", "voy esta tarde", "voy para alla", "voy saliendo", "me acerco", "hasta que hora abren", "vamos para", "voy hoy"]
QUOTE = ["cotiz", "mandela", "mandemela", "enviela", "enviemela", "pasame el precio", "me la cotiza", "cotizame"]
ACCEPTANCE = ["me sirve", "esa si", "esa me", "hagale", "listo", "de acuerdo", "perfecto", "si por favor", "separemela"]


def conversations(turns: DataFrame, chats: DataFrame) -> DataFrame:
    """chats with messages: array of (turn, sender, text) in order. A conversation's turns are a bounded group."""
    m = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "sender", "text"))).alias("messages"))
    return chats.join(m, "conv_id")


def _has(text: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(c) for c in cues))


def weak_labels(talks: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """talks (with messages) and what rules read from the customer's texts alone: the eight signals and a confidence.

    intent: the last cue decides; objection: of each kind's last cue, the earliest; amounts: the largest in the texts.
    The model is the last one that the customer named; one that followed another needs a later acceptance.
    """
    keys = F.transform(g.customer_texts(F.col("messages")), normalize_key)
    t = talks.withColumn("_texts", keys).withColumn("_t", F.array_join("_texts", " || "))
    text = F.col("_t")
    marks = F.array_compact(F.array(*(F.when(g.last_cue(text, cues).isNotNull(), F.struct(g.last_cue(text, cues)["place"].alias("place"), F.lit(-i).alias("o"), F.lit(level).alias("level"))) for i, (level, cues) in enumerate((("alta", HIGH), ("media", MEDIUM), ("baja", LOW))))))
    intent = F.coalesce(F.array_max(marks)["level"], F.when(_has(text, INFORMATIVE), "informativa"))
    fin, cash = g.last_cue(text, FINANCED)["place"], g.last_cue(text, CASH)["place"]
    pay = F.when(fin.isNotNull() & (cash.isNull() | (fin > cash)), "financiacion").when(cash.isNotNull(), "contado")
    amount = F.array_max(g.amounts_in_text(text))
    down = F.when(_has(text, NO_DOWN), 0.0).when(_has(text, DOWN), amount)
    budget = F.when(~_has(text, NOT_BUDGET) & _has(text, BUDGET), amount)
    kinds = F.array_compact(F.array(*(F.when(g.last_cue(text, cues).isNotNull(), F.struct(g.last_cue(text, cues)["place"].alias("place"), F.lit(i).alias("o"), F.lit(kind).alias("kind"))) for i, (kind, cues) in enumerate(OBJECTIONS.items()))))
    objection = F.array_min(kinds)["kind"]
    t = t.withColumns({"intencion_compra": intent, "forma_pago": pay, "cuota_inicial": down, "presupuesto": budget, "objecion": objection, "solicitud_cita": F.when(_has(text, VISIT), True), "solicitud_cotizacion": F.when(_has(text, QUOTE), True)})
    model_low, model_mid = F.lit(False), F.lit(False)
    t = t.withColumn("model_interes", F.lit(None).cast("string"))
    if catalog is not None:
        t = _with_models(t, catalog)
        model_mid = (F.col("_models") > 1) & F.col("model_interes").isNotNull()
        model_low = (F.col("_models") > 1) & F.col("model_interes").isNull()
    low = model_low | (F.col("objecion") == "disponibilidad")
    strong_intent = F.size(marks) > 0
    medium = model_mid | ~strong_intent | (F.col("cuota_inicial").isNull() & _has(text, DOWN)) | F.col("presupuesto").isNotNull()
    confidence = F.when(F.coalesce(low, F.lit(False)), "low").when(F.coalesce(medium, F.lit(False)), "medium").otherwise("high")
    return t.withColumn("confidence", confidence).drop("_texts", "_t", "_models")


def labels_as_extractions(labels: DataFrame) -> DataFrame:
    """Weak labels of linked conversations as rows for consolidate(): without evidence, in the order of their conversation_id."""
    proof = {f"{n}_evidence": F.lit(None).cast("string") for n in ("forma_pago", "objecion", "presupuesto", "cuota_inicial")}
    return labels.where("lead_id is not null").withColumns(proof).withColumn("extraction_id", F.col("conversation_id"))


def mentions(texts: DataFrame, lines: DataFrame, piece: int = 2000, max_broadcast: int = 200_000) -> DataFrame:
    """(id, at, line): which of lines (line, distinct) each of texts (id, at, text) holds, anywhere and inside of words too.

    All lines at once: a place of a text is looked up by its first characters among the beginnings of lines, and only there
    the runs of the lengths that lines with this beginning have are cut out and joined with the whole lines. Beginnings
    are as long as the shortest line, four characters at most. Long texts are read in overlapping pieces. Empty lines are
    in no text. Beginnings are broadcast if there are at most max_broadcast; lines meet by an ordinary join on equality.
    """
    known = lines.where("line <> ''")
    size = known.agg(F.min(F.length("line")).alias("least"), F.max(F.length("line")).alias("most")).first()
    if size.least is None:
        return texts.select("id", "at", F.col("text").alias("line")).limit(0)
    q = min(4, size.least)
    heads = known.groupBy(F.substring("line", 1, q).alias("head")).agg(F.collect_set(F.length("line")).alias("sizes"))
    if known.select(F.substring("line", 1, q)).distinct().count() <= max_broadcast:
        heads = F.broadcast(heads)
    pieces = texts.where(F.length("text") >= q).select("id", "at", F.explode(F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(piece)), lambda i: F.substring(F.col("text"), i, F.lit(piece + size.most - 1)))).alias("text"))
    places = pieces.where(F.length("text") >= q).select("id", "at", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(piece), F.length("text") - (q - 1))), lambda i: F.substring(F.col("text"), i, F.lit(size.most)))).alias("ahead"))
    cut = places.withColumn("head", F.substring("ahead", 1, q)).join(heads, "head").select("id", "at", "ahead", F.explode("sizes").alias("n")).where(F.length("ahead") >= F.col("n"))
    return cut.select("id", "at", F.substring(F.col("ahead"), F.lit(1), F.col("n")).alias("line")).distinct().join(known.select("line"), "line").select("id", "at", "line")


def _with_models(t: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds model_interes and _models (how many). Of lines with one key the last model by name counts; of models first named in one text too."""
    lines = catalog.select(normalize_key(F.col("line")).alias("line"), F.concat_ws(" ", F.trim("brand"), F.trim("line")).alias("_model")).where("line <> ''").groupBy("line").agg(F.max("_model").alias("_model"))
    lines = materialize(lines, "lines")
    texts = t.select(F.col("conv_id").alias("id"), F.posexplode("_texts").alias("at", "text"))
    hits = mentions(texts, lines.select("line")).join(lines, "line").groupBy(F.col("id").alias("conv_id"), "_model").agg(F.min("at").alias("_at"))
    last = hits.groupBy("conv_id").agg(F.max(F.struct("_at", "_model")).alias("_l"), F.count("*").alias("_models"))
    t = t.join(last, "conv_id", "left").withColumn("_models", F.coalesce("_models", F.lit(0)))
    after = F.array_join(F.slice("_texts", F.coalesce(F.col("_l._at"), F.lit(0)) + 1, F.size("_texts") + 1), " || ")
    sure = (F.col("_models") == 1) | _has(after, ACCEPTANCE) | _has(after, HIGH) | _has(after, MEDIUM)
    return t.withColumn("model_interes", F.when(sure, F.col("_l._model"))).drop("_l")


def apply_extractor(talks: DataFrame, extract: Callable[[str, str], dict], model: str = "custom") -> DataFrame:
    """Runs extract(conversation_id, transcript) -> {"raw_text": ..., "latency_ms": ...} on every conversation.

    An exception makes an error row, with the first 500 characters of its text, and the batch goes on. The function is shipped to the executors and works on Arrow
    batches of its partition.
    """
    import pandas as pd

    def run(batches):
        for part in batches:
            rows = []
            for cid, text in zip(part["conversation_id"], part["transcript"], strict=True):
                try:
                    r = extract(cid, text)
                    rows.append((cid, True, r.get("latency_ms"), r.get("raw_text"), None))
                except Exception as e:  # noqa: BLE001  the protocol's way to report a failure
                    rows.append((cid, False, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    some = talks.select("conversation_id", g.build_transcript(F.col("messages")).alias("transcript"))
    return some.mapInPandas(run, OUTCOME).withColumn("model", F.lit(model))


def parse_outcomes(outcomes: DataFrame) -> DataFrame:
    """outcomes with payload (parsed raw_text), status success or error, and error."""
    p = outcomes.withColumn("payload", g.parse_payload(F.col("raw_text")))
    good = F.coalesce(F.col("payload.success") & F.col("payload.schema_valid"), F.lit(False))
    error = F.when(good, None).when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(F.col("payload.success"), F.lit(False)), "invalid JSON").otherwise(F.concat(F.lit("schema validation failed: "), F.col("payload.errors"), F.lit(" error(s)")))
    return p.withColumns({"status": F.when(good, "success").otherwise("error"), "error": error})


def validate_extractions(rows: DataFrame) -> DataFrame:
    """rows (payload, messages) with each value and its evidence kept only if the customer's own words prove it.

    Adds the eight fields and evidences, invalidated (field:reason, joined by ,) and validated (joined by ,).
    Texts are normalised once per conversation.
    """
    r = rows.withColumns({"_client": F.transform(g.customer_texts(F.col("messages")), normalize_for_match), "_others": F.transform(g.other_texts(F.col("messages")), normalize_for_match)})
    r = r.withColumns({f"_why_{n}": g.invalid_reason(n, F.col(f"payload.{n}"), F.col(f"payload.{n}_evidence"), F.col("_client"), F.col("_others")) for n in g.FIELDS})
    kept = {}
    for n in g.FIELDS:
        kept[n] = F.when(F.col(f"_why_{n}").isNull(), F.col(f"payload.{n}"))
        kept[f"{n}_evidence"] = F.when(F.col(f"_why_{n}").isNull(), F.col(f"payload.{n}_evidence"))
    bad = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_why_{n}").isNotNull(), F.concat(F.lit(f"{n}:"), F.col(f"_why_{n}"))) for n in g.FIELDS))), ",")
    good = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"payload.{n}").isNotNull() & F.col(f"_why_{n}").isNull(), n) for n in g.FIELDS))), ",")
    out = r.withColumns({**kept, "invalidated": bad, "validated": good})
    return out.drop("_client", "_others", *(f"_why_{n}" for n in g.FIELDS))


def upsert_extractions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (conversation_id, input_hash). stored and new: conversation_id, input_hash, extraction_id, status, fields; stored also is_current.

    A stored success is reused and stays; a stored error is replaced in place by the retry; an error never becomes
    current and never displaces a success. Of a conversation's successes the one just made or reused is current, else
    the latest.
    """
    a, b = stored.alias("a"), new.alias("b")
    both = a.join(b, (F.col("a.conversation_id") == F.col("b.conversation_id")) & (F.col("a.input_hash") == F.col("b.input_hash")), "full")
    reuse = F.col("a.status") == "success"
    pick = lambda c: F.when(F.coalesce(reuse, F.lit(False)) | F.col("b.conversation_id").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    rows = both.select(F.coalesce("a.conversation_id", "b.conversation_id").alias("conversation_id"), F.coalesce("a.input_hash", "b.input_hash").alias("input_hash"), F.coalesce("a.extraction_id", "b.extraction_id").alias("extraction_id"),
                       pick("status").alias("status"), pick("fields").alias("fields"), F.col("b.conversation_id").isNotNull().alias("_touched"), F.coalesce("a.is_current", F.lit(False)).alias("_was"))
    rank = F.struct(F.col("_touched").alias("t"), F.col("_was").alias("w"), F.col("extraction_id").alias("i"))
    best = rows.where("status = 'success'").groupBy("conversation_id").agg(F.max(rank).alias("_m")).select("conversation_id", F.col("_m.i").alias("_best"))
    return rows.join(best, "conversation_id", "left").select("conversation_id", "input_hash", "extraction_id", "status", "fields", F.coalesce((F.col("status") == "success") & (F.col("extraction_id") == F.col("_best")), F.lit(False)).alias("is_current"))


def consolidate(rows: DataFrame) -> DataFrame:
    """A row per lead from its successful extractions (lead_id, extraction_id, the eight fields and evidences), with the extraction that gave each value.

    intent: the highest, then the latest. Booleans: the latest true, else the first false. Words and amounts: with
    evidence first, then the latest. Plain maxima of structs: one pass, combined before the shuffle.
    """
    x = F.col("extraction_id")
    token = lambda n: F.nullif(F.lower(trim(F.col(n))), F.lit(""))
    rank = F.when(token("intencion_compra") == "alta", 4).when(token("intencion_compra") == "media", 3).when(token("intencion_compra") == "baja", 2).when(token("intencion_compra") == "informativa", 1)
    aggs = [F.max(F.when(rank.isNotNull(), F.struct(rank.alias("r"), x.alias("id"), token("intencion_compra").alias("v")))).alias("intencion_compra")]
    for n in g.BOOLS:
        aggs += [F.max(F.when(F.col(n), x)).alias(f"_{n}_t"), F.min(F.when(~F.col(n), x)).alias(f"_{n}_f")]
    for n in ("forma_pago", "objecion", *g.AMOUNTS):
        v = F.col(n) if n in g.AMOUNTS else token(n)
        aggs.append(F.max(F.when(v.isNotNull(), F.struct((F.coalesce(trim(F.col(f"{n}_evidence")), F.lit("")) != "").alias("e"), x.alias("id"), v.alias("v")))).alias(n))
    r = rows.groupBy("lead_id").agg(*aggs)
    named = ("intencion_compra", "forma_pago", "objecion", *g.AMOUNTS)
    yes = lambda n: F.when(F.col(f"_{n}_t").isNotNull(), True).when(F.col(f"_{n}_f").isNotNull(), False)
    return r.select("lead_id", *(F.col(f"{n}.v").alias(n) for n in named), *(yes(n).alias(n) for n in g.BOOLS), *(F.col(f"{n}.id").alias(f"{n}_source") for n in named), *(F.coalesce(f"_{n}_t", f"_{n}_f").alias(f"{n}_source") for n in g.BOOLS))


def affected_leads(rows: DataFrame) -> DataFrame:
    """Distinct leads that successful extractions touch."""
    return rows.where("status = 'success' and lead_id is not null").select("lead_id").distinct()


def revalidate(stored: DataFrame, talks: DataFrame) -> DataFrame:
    """Stored extractions (conversation_id and the payload's values and evidences) checked again against their conversations.

    Adds changed: whether a value that was stored does not hold.
    """
    payload = F.struct(*(F.col(c) for n in g.FIELDS for c in (n, f"{n}_evidence")))
    rest = [c for c in stored.columns if c not in g.FIELDS and not any(c == f"{n}_evidence" for n in g.FIELDS)]
    rows = stored.select(*rest, payload.alias("payload")).join(talks.select("conversation_id", "messages"), "conversation_id")
    out = validate_extractions(rows)
    return out.withColumn("changed", F.col("invalidated") != "").drop("payload", "messages")


def batch_report(outcomes: DataFrame) -> DataFrame:
    """One row from a batch's outcomes (status success, error or failed; reused): candidates, processed, success, reused, errors, failed.

    failed did not come back at all; an error came back without a result, and a reused one is no error."""
    failed, reused = F.col("status") == "failed", F.coalesce(F.col("reused"), F.lit(False))
    errors = F.count_if(~failed & ~reused & (F.col("status") == "error"))
    processed = F.count_if(~failed)
    return outcomes.agg(F.count("*").alias("candidates"), processed.alias("processed"), (processed - errors).alias("success"), F.count_if(~failed & reused).alias("reused"), errors.alias("errors"), F.count_if(failed).alias("failed"))


def batch_reasons(outcomes: DataFrame) -> DataFrame:
    """(reason, n) of the outcomes' errors; null: none."""
    return outcomes.groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))
