"""Rule scores with reasons: commercial, quality and urgency, as one expression tree from a dict of parameters."""

from __future__ import annotations

import copy
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.scratch import materialize

#: The parameters of version v1. A weight of 0 turns a rule off.
PARAMS = {
    "score_version": "v1", "base_gestionable": 20, "intencion_points": {"alta": 30, "media": 15, "baja": 5, "informativa": 0}, "cita_points": 20, "cotizacion_points": 10,
    "presupuesto_compatible_points": 10, "presupuesto_insuficiente_points": -10, "cuota_suficiente_points": 5, "cuota_suficiente_ratio": 0.20, "forma_pago_points": 5,
    "objecion_points": {"precio": -10, "cuota": -8, "financiacion": -8, "disponibilidad": -5, "tiempo": -3, "modelo": -5, "ubicacion": -5, "otra": -5},
    "ticket_weight": 1.0, "ticket_max_points": 10, "catalog_min_price": 4990000.0, "catalog_max_price": 24900000.0,
    "quality_points": {"phone": 30, "model": 25, "email": 20, "city": 15, "registration_date": 10},
    "estado_base": {"Sin gestión": 70, "No contesta": 60, "Cotización enviada": 55, "Contactado": 40, "En proceso": 30, "Descartado": 0}, "estado_desconocido_base": 30,
    "antiguedad_points": {"mas_48h": 20, "24_48h": 10}, "cita_urgency_override": 100, "sin_gestion_mas_48h_min": 90, "queue_commercial_weight": 0.7, "queue_urgency_weight": 0.3,
    "band_alta_desde": 70, "band_media_desde": 45, "urgency_hoy_desde": 75, "urgency_24h_desde": 45}
SIGNALS = {"intencion_compra": "string", "solicitud_cita": "boolean", "solicitud_cotizacion": "boolean", "presupuesto": "double", "cuota_inicial": "double", "forma_pago": "string", "objecion": "string"}


def params(**changes) -> dict:
    return copy.deepcopy(PARAMS) | changes


def half_up(x: Column) -> Column:
    """Two decimals, halves up, by the same floating-point steps in every engine."""
    return F.floor(x * 100 + 0.5) / 100


def _clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), half_up(x)))


def _case(key: Column, table: dict, default=None) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in table.items():
        out = out.when(key == k, F.lit(float(v)))
    return out.otherwise(F.lit(None if default is None else float(default)).cast("double"))


def reference_date(leads: DataFrame, given: str | None = None) -> DataFrame:
    """One row: the latest trusted registration, else the date given, else now."""
    return leads.agg(F.coalesce(F.max("registration_at"), F.lit(given).cast("timestamp"), F.current_timestamp()).alias("reference_at"))


def lead_signals(leads: DataFrame, catalog: DataFrame, consolidated: DataFrame | None = None, conversations: DataFrame | None = None, given: str | None = None) -> DataFrame:
    """What scoring needs of each lead: price of its SKU, presence of fields, whole days since registration, chat signals.

    The one-row reference date is a scalar that Spark broadcasts; days are floored, so they count from the moment.
    """
    prices = catalog.select(F.col("sku").alias("_sku"), F.col("list_price").cast("double").alias("list_price"))
    out = leads.join(prices, F.col("sku") == F.col("_sku"), "left").join(reference_date(leads, given))
    if consolidated is not None:
        out = out.join(consolidated.select("lead_id", *SIGNALS), "lead_id", "left")
    else:
        out = out.select("*", *(F.lit(None).cast(t).alias(n) for n, t in SIGNALS.items()))
    if conversations is not None:
        talks = conversations.select(F.col("lead_id").alias("_talk")).distinct()
        out = out.join(talks, F.col("lead_id") == F.col("_talk"), "left")
    else:
        out = out.withColumn("_talk", F.lit(None))
    days = F.floor((F.unix_micros("reference_at") - F.unix_micros("registration_at")) / 86_400_000_000)
    return out.select(
        "lead_id", "company_id", "point_of_sale_id", "list_price", F.col("sku").isNotNull().alias("model_resolved"), *SIGNALS, F.col("_talk").isNotNull().alias("has_conversation"), F.col("phone_normalized").isNotNull().alias("phone_valid"),
        F.col("email_normalized").isNotNull().alias("email_present"), F.col("city_raw").isNotNull().alias("city_present"), F.col("registration_at").isNotNull().alias("registration_trustworthy"), F.col("status").alias("estado_gestion"),
        days.alias("days_since_registration"), F.col("first_contact_at").isNotNull().alias("has_first_contact"))


def _rules(p: dict) -> list[tuple[str, Column, Column, Column]]:
    """(dimension, code, points, condition) in the order of the reasons."""
    c = F.col
    token = lambda n: F.nullif(F.lower(F.trim(c(n))), F.lit(""))
    yes = lambda x: F.coalesce(x, F.lit(False))
    num = lambda k: F.lit(float(p[k]))
    intent, objection = token("intencion_compra"), token("objecion")
    intent_points = _case(intent, p["intencion_points"])
    known_price = c("list_price").isNotNull()
    both = c("presupuesto").isNotNull() & known_price
    span = p["catalog_max_price"] - p["catalog_min_price"]
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("list_price") - p["catalog_min_price"]) / span)) if span > 0 else F.lit(0.0)
    q = p["quality_points"]
    state = _case(c("estado_gestion"), p["estado_base"])
    cita = yes(c("solicitud_cita"))
    aged = ~cita & c("registration_trustworthy") & c("days_since_registration").isNotNull()
    fresh = aged & ~c("has_first_contact")
    return [
        ("commercial", F.lit("BASE_GESTIONABLE"), num("base_gestionable"), F.lit(True)),
        ("commercial", F.concat(F.lit("INTENCION_"), F.upper(intent)), intent_points, intent_points.isNotNull()),
        ("commercial", F.lit("CLIENTE_PIDIO_CITA"), num("cita_points"), cita),
        ("commercial", F.lit("CLIENTE_PIDIO_COTIZACION"), num("cotizacion_points"), yes(c("solicitud_cotizacion"))),
        ("commercial", F.lit("PRESUPUESTO_COMPATIBLE"), num("presupuesto_compatible_points"), both & yes(c("presupuesto") >= c("list_price"))),
        ("commercial", F.lit("PRESUPUESTO_INSUFICIENTE"), num("presupuesto_insuficiente_points"), both & yes(c("presupuesto") < c("list_price"))),
        ("commercial", F.lit("CUOTA_SUFICIENTE"), num("cuota_suficiente_points"), yes((c("list_price") > 0) & (c("cuota_inicial") >= c("list_price") * p["cuota_suficiente_ratio"]))),
        ("commercial", F.lit("FORMA_PAGO_DECLARADA"), num("forma_pago_points"), token("forma_pago").isNotNull()),
        ("commercial", F.concat(F.lit("OBJECION_"), F.upper(objection)), _case(objection, p["objecion_points"], -5), objection.isNotNull()),
        ("commercial", F.lit("TICKET_REGLA_NEGOCIO"), half_up(place * float(p["ticket_max_points"]) * float(p["ticket_weight"])), known_price),
        ("quality", F.lit("TELEFONO_VALIDO"), F.lit(float(q["phone"])), c("phone_valid")), ("quality", F.lit("MODELO_RESUELTO"), F.lit(float(q["model"])), c("model_resolved")),
        ("quality", F.lit("EMAIL_PRESENTE"), F.lit(float(q["email"])), c("email_present")), ("quality", F.lit("CIUDAD_PRESENTE"), F.lit(float(q["city"])), c("city_present")),
        ("quality", F.lit("FECHA_CONFIABLE"), F.lit(float(q["registration_date"])), c("registration_trustworthy")),
        ("urgency", F.lit("ESTADO_OPERATIVO"), state, state.isNotNull()), ("urgency", F.lit("ESTADO_DESCONOCIDO"), num("estado_desconocido_base"), state.isNull()),
        ("urgency", F.lit("URGENCIA_HOY_CITA"), F.lit(0.0), cita),
        ("urgency", F.lit("SIN_CONTACTO_MAS_48H"), F.lit(float(p["antiguedad_points"]["mas_48h"])), fresh & yes(c("days_since_registration") >= 2)),
        ("urgency", F.lit("SIN_CONTACTO_24_48H"), F.lit(float(p["antiguedad_points"]["24_48h"])), fresh & yes(c("days_since_registration") == 1)),
        ("urgency", F.lit("SIN_GESTION_MAS_48H"), F.lit(0.0), F.lit(True)), ("urgency", F.lit("FECHA_NO_CONFIABLE"), F.lit(0.0), ~cita & ~aged)]


def _missing() -> Column:
    c, talk = F.col, F.col("has_conversation")
    names = [(n, talk & c(n).isNull()) for n in ("intencion_compra", "solicitud_cita", "solicitud_cotizacion", "presupuesto")]
    names += [("precio_modelo", c("list_price").isNull()), ("cuota_inicial", talk & c("cuota_inicial").isNull()), ("forma_pago", talk & c("forma_pago").isNull()), ("objecion", talk & c("objecion").isNull()), ("telefono", ~c("phone_valid")),
              ("modelo", ~c("model_resolved")), ("email", ~c("email_present")), ("ciudad", ~c("city_present")), ("fecha_registro_confiable", ~c("registration_trustworthy")), ("estado_gestion", _case(c("estado_gestion"), PARAMS["estado_base"]).isNull())]
    return F.array_compact(F.array(*(F.when(cond, n) for n, cond in names)))


def score_leads(signals: DataFrame, p: dict | None = None) -> DataFrame:
    """signals with commercial, quality, urgency, queue, band, urgency_band, reasons, missing and params_snapshot.

    One projection: no shuffle, no Python. reasons: array of (dimension, code, points).
    """
    p = PARAMS if p is None else p
    rules = _rules(p)
    total = lambda d: sum((F.when(cond, points).otherwise(0.0) for dim, _, points, cond in rules if dim == d), F.lit(0.0))
    s = signals.withColumns({"commercial": _clamp(total("commercial")), "quality": _clamp(total("quality")), "_urgency": total("urgency")})
    cita = F.coalesce(F.col("solicitud_cita"), F.lit(False))
    stuck = ~cita & F.col("registration_trustworthy") & F.coalesce((F.col("estado_gestion") == "Sin gestión") & (F.col("days_since_registration") >= 2), F.lit(False)) & (F.col("_urgency") < float(p["sin_gestion_mas_48h_min"]))
    urgency = F.when(cita, F.lit(float(p["cita_urgency_override"]))).when(stuck, F.lit(float(p["sin_gestion_mas_48h_min"]))).otherwise(F.col("_urgency"))
    s = s.withColumn("_stuck", stuck).withColumn("urgency", _clamp(urgency))
    s = s.withColumn("queue", half_up(F.col("commercial") * float(p["queue_commercial_weight"]) + F.col("urgency") * float(p["queue_urgency_weight"])))
    reasons = F.array_compact(F.array(*(F.when((F.col("_stuck") if i == len(rules) - 2 else cond), F.struct(F.lit(dim).alias("dimension"), code.alias("code"), points.alias("points"))) for i, (dim, code, points, cond) in enumerate(rules))))
    band = F.when(F.col("commercial") >= p["band_alta_desde"], "Alta").when(F.col("commercial") >= p["band_media_desde"], "Media").otherwise("Baja")
    soon = F.when(F.col("urgency") >= p["urgency_hoy_desde"], "Hoy").when(F.col("urgency") >= p["urgency_24h_desde"], "24 h").otherwise("Semana")
    return s.withColumns({"band": band, "urgency_band": soon, "reasons": reasons, "missing": _missing(), "score_version": F.lit(p["score_version"]), "params_snapshot": F.lit(json.dumps(p, ensure_ascii=False, sort_keys=True))}).drop("_urgency", "_stuck")


def version_scores(stored: DataFrame, new: DataFrame, run: int) -> DataFrame:
    """Stored score versions with is_current, plus the new ones that differ from their lead's current one.

    stored: lead_id, run_id, score_version, commercial, urgency, queue, band, params_snapshot, is_current.
    """
    columns = ("score_version", "commercial", "urgency", "queue", "band", "params_snapshot")
    now = stored.where("is_current").select(F.col("lead_id").alias("_lead"), *(F.col(c).alias(f"_{c}") for c in columns))
    same = F.col("_lead").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    fresh = new.join(now, F.col("lead_id") == F.col("_lead"), "left").where(~same).select("lead_id", F.lit(run).alias("run_id"), *columns, F.lit(True).alias("is_current"))
    old = stored.join(fresh.select(F.col("lead_id").alias("_new")), F.col("lead_id") == F.col("_new"), "left")
    return old.select("lead_id", "run_id", *columns, (F.col("is_current") & F.col("_new").isNull()).alias("is_current")).unionByName(fresh)


def score_distribution(scores: DataFrame) -> DataFrame:
    """(band, urgency_band, n, commercial and queue ranges and means), each band and urgency band."""
    stats = [f(c).alias(f"{c}_{n}") for c in ("commercial", "queue") for n, f in (("min", F.min), ("max", F.max), ("mean", lambda x: half_up(F.avg(x))))]
    return scores.groupBy("band", "urgency_band").agg(F.count("*").alias("n"), *stats)


def score_samples(scores: DataFrame, k: int = 2, reasons: int = 3) -> DataFrame:
    """(band, place, lead_id, commercial, urgency, queue, quality, top): the first k leads of each band by lead_id, with the reasons of most weight.

    k aggregations of one value a band, each a minimum of what comes after the one before: tasks hold a row a band and no
    band is sorted. top: code(points) of the `reasons` largest contributions, sign apart; of equal ones the first.
    """
    ids = scores.select("band", "lead_id")
    last = ids.groupBy("band").agg(F.min("lead_id").alias("lead_id")).withColumn("place", F.lit(1))
    found = [materialize(last, "samples")]  # a row a band
    for i in range(2, k + 1):
        after = ids.join(F.broadcast(found[-1].select("band", F.col("lead_id").alias("_last"))), "band").where("lead_id > _last")
        found.append(materialize(after.groupBy("band").agg(F.min("lead_id").alias("lead_id")).withColumn("place", F.lit(i)), "samples"))
    some = reduce(DataFrame.unionByName, found)
    weighed = F.transform("reasons", lambda r, i: F.struct((-F.abs(r["points"])).alias("w"), i.alias("i"), F.concat(r["code"], F.lit("("), F.when(r["points"] >= 0, "+").otherwise(""), F.round(r["points"], 2).cast("string"), F.lit(")")).alias("t")))
    top = F.array_join(F.transform(F.slice(F.array_sort(weighed), 1, reasons), lambda x: x["t"]), "; ")
    return scores.join(F.broadcast(some.select("lead_id", "place")), "lead_id").select("band", "place", "lead_id", "commercial", "urgency", "queue", "quality", top.alias("top"))
