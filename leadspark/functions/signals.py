"""Signals from chats: amounts, evidence, extraction payloads, transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.functions.text import lookup, normalize_for_match, strip_accents, trim

FIELDS = ("model_interes", "presupuesto", "cuota_inicial", "forma_pago", "intencion_compra", "objecion", "solicitud_cita", "solicitud_cotizacion")
AMOUNTS, BOOLS, TOKENS = ("presupuesto", "cuota_inicial"), ("solicitud_cita", "solicitud_cotizacion"), ("forma_pago", "intencion_compra", "objecion")
# Replies that prove nothing, sender names in quotes, and the words that extractions may use.
COURTESY = ("dale", "ok", "okay", "bueno", "buena", "buenas", "listo", "lista", "si", "claro", "gracias", "de acuerdo", "perfecto", "entendido", "vale", "hola",
            "buenos dias", "buenas tardes", "buenas noches", "ya", "esta bien", "muchas gracias")
QUOTED_SENDERS = {"cliente": "cliente", "client": "cliente", "customer": "cliente", "usuario": "cliente", "asesor": "asesor", "advisor": "asesor", "agent": "asesor", "agente": "asesor", "vendedor": "asesor"}
PAYMENTS = {"contado": "contado", "efectivo": "contado", "financiacion": "financiacion", "financiamiento": "financiacion", "financiado": "financiacion", "financiada": "financiacion",
            "credito": "credito", "tarjeta": "tarjeta", "transferencia": "transferencia", "otro": "otro"}
INTENTS = {"alta": "alta", "alto": "alta", "media": "media", "medio": "media", "baja": "baja", "bajo": "baja", "informativa": "informativa", "informativo": "informativa", "informacion": "informativa", "consulta": "informativa"}
OBJECTIONS = {"precio": "precio", "precios": "precio", "cuota": "cuota", "cuotas": "cuota", "financiacion": "financiacion", "disponibilidad": "disponibilidad", "tiempo": "tiempo",
              "modelo": "modelo", "ubicacion": "ubicacion", "lugar": "ubicacion", "otra": "otra", "otro": "otra"}
SYNONYMS = {"forma_pago": PAYMENTS, "intencion_compra": INTENTS, "objecion": OBJECTIONS}


def parse_local_number(c: Column) -> Column:
    """Comma: points group thousands and the comma is decimal. Points only: thousands if every later group has three digits, else decimal."""
    text = F.when(c.contains(","), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(c.rlike(r"^[^.]*(\.[^.]{3})+$"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c)
    return trim(text).try_cast("double")


def amounts_in_text(c: Column) -> Column:
    """Amounts in pesos, kind after kind: N millones or palos, N mil or k, $N, 1.500.000, five digits and more."""
    text = F.lower(strip_accents(F.coalesce(c, F.lit(""))))
    kinds = ((r"([0-9]+(?:[.,][0-9]+)?)\s*(?:millones|millon|palo|palos)", 1e6), (r"([0-9]+(?:[.,][0-9]+)?)\s*(?:mil|k)\b", 1e3), (r"\$\s*([0-9.,]+)", 1.0), (r"\b([0-9]{1,3}(?:[.,][0-9]{3})+)\b", 1.0))

    def scaled(pattern: str, factor: float) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: parse_local_number(x) * factor), lambda v: v.isNotNull())

    found = [scaled(p, m) for p, m in kinds]
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{5,})\b"), F.lit(1)), lambda x: x.cast("double"))
    return F.concat(*found, plain)


def amount_matches_evidence(value: Column, evidence: Column) -> Column:
    return F.exists(amounts_in_text(evidence), lambda a: F.abs(a - value) <= F.greatest(F.lit(1.0), F.abs(value) * 1e-6))


def split_sender(c: Column) -> Column:
    """struct(sender, body): a known sender before a colon, and the rest; else null and all."""
    sender = lookup(trim(F.lower(strip_accents(F.regexp_extract(c, r"(?s)^\s*([^\s:]+)\s*:\s*(.*)$", 1)))), QUOTED_SENDERS)
    return F.struct(sender.alias("sender"), F.when(sender.isNotNull(), F.regexp_extract(c, r"(?s)^\s*([^\s:]+)\s*:\s*(.*)$", 2)).otherwise(c).alias("body"))


def is_non_informative(c: Column) -> Column:
    return normalize_for_match(c).isin(*COURTESY)


def evidence_in(needle: Column, normalized: Column) -> Column:
    """Whether a quote stands in one of the messages; normalized: array of normalize_for_match texts."""
    key = normalize_for_match(needle)
    return (key != "") & F.exists(normalized, lambda m: F.contains(m, key))


def invalid_reason(name: str, value: Column, evidence: Column, client: Column, others: Column) -> Column:
    """Why a value does not count, null if it does. client, others: normalised texts of the customer and of all others."""
    parts = split_sender(evidence)
    body = parts["body"]
    out = (F.when(value.isNull(), None).when(F.coalesce(trim(evidence), F.lit("")) == "", "missing_evidence").when(trim(body) == "", "missing_evidence")
           .when(is_non_informative(body), "non_informative_evidence").when(parts["sender"] == "asesor", "advisor_evidence")
           .when(~evidence_in(body, client), F.when(evidence_in(body, others), "advisor_evidence").otherwise("evidence_not_in_conversation")))
    return out.when(~amount_matches_evidence(value, body), "amount_not_in_evidence") if name in AMOUNTS else out


def parse_controlled(c: Column, words: dict[str, str]) -> Column:
    """struct(value, error): the word's standard form; unknown words are errors."""
    token = F.nullif(strip_accents(F.lower(trim(c))), F.lit(""))
    value = lookup(token, words)
    return F.struct(value.alias("value"), (token.isNotNull() & value.isNull()).alias("error"))


def parse_bool_token(c: Column) -> Column:
    token = strip_accents(F.lower(trim(c)))
    value = F.when(token.isin("true", "si", "yes", "1"), True).when(token.isin("false", "no", "0"), False)
    return F.struct(value.alias("value"), (c.isNotNull() & value.isNull()).alias("error"))


def parse_amount_token(c: Column, number: Column) -> Column:
    """struct(value, error). number: whether JSON had a number there (taken as it is); of strings the digits count; a boolean is an error."""
    text = F.regexp_replace(trim(c), r"[$ ]", "")
    good = text.rlike(r"^[0-9.,]+$") & text.rlike("[0-9]")
    value = F.when(number, c.try_cast("double")).when(good, F.regexp_replace(text, "[^0-9]", "").try_cast("double"))
    return F.struct(value.alias("value"), (c.isNotNull() & (number | (text != "")) & value.isNull()).alias("error"))


def parse_payload(text: Column) -> Column:
    """struct(success, schema_valid, errors, the eight values and their evidences) of an extraction's JSON text.

    Invalid JSON: no success. A bad word, amount or boolean: success, but not schema_valid and no values. Evidence of a
    missing value is dropped; other keys are ignored.
    """
    v = F.try_parse_json(F.coalesce(text, F.lit("")))
    get = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    parsed = {}
    for n in FIELDS:
        if n in AMOUNTS:
            parsed[n] = parse_amount_token(get(n), F.coalesce(kind(n).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), F.lit(False)))
        elif n in BOOLS:
            parsed[n] = parse_bool_token(get(n))
        elif n in TOKENS:
            parsed[n] = parse_controlled(get(n), SYNONYMS[n])
        else:
            parsed[n] = F.struct(get(n).alias("value"), (get(n).isNotNull() & (kind(n) != "STRING")).alias("error"))
    errors = reduce(lambda a, b: a + b, (F.coalesce(p["error"], F.lit(False)).cast("int") for p in parsed.values()))
    # an object is needed; its error count is the number of bad fields
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    valid = is_object & (errors == 0)
    out = [v.isNotNull().alias("success"), valid.alias("schema_valid"), errors.alias("errors")]
    for n, p in parsed.items():
        value = F.when(valid, p["value"])
        out += [value.alias(n), F.when(value.isNotNull(), F.nullif(trim(get(f"{n}_evidence")), F.lit(""))).alias(f"{n}_evidence")]
    return F.struct(*out)


def fields_extracted(p: Column) -> Column:
    return reduce(lambda a, b: a + b, (p[n].isNotNull().cast("int") for n in FIELDS))


def fields_with_evidence(p: Column) -> Column:
    return reduce(lambda a, b: a + b, ((p[n].isNotNull() & p[f"{n}_evidence"].isNotNull()).cast("int") for n in FIELDS))


def build_transcript(messages: Column) -> Column:
    """Lines "sender: text" of the messages with a text, in order."""
    some = F.filter(messages, lambda m: trim(m["text"]) != "")
    return F.array_join(F.transform(some, lambda m: F.concat(trim(m["sender"]), F.lit(": "), trim(m["text"]))), "\n")


def input_hash(transcript: Column, prompt: str, schema: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(prompt).alias("prompt_version"), F.lit(schema).alias("schema_version"), transcript.alias("transcript"))), 256)


def customer_texts(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: (trim(m["text"]) != "") & (trim(m["sender"]) == "cliente")), lambda m: m["text"])


def other_texts(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: (trim(m["text"]) != "") & (F.coalesce(trim(m["sender"]), F.lit("")) != "cliente")), lambda m: m["text"])


def last_cue(text: Column, cues: list[str]) -> Column:
    """struct(place, cue) of the rightmost cue in a text; of cues at one place the first in the list; null without any."""
    n = F.length(text)
    hits = F.array(*(F.when(F.contains(text, F.lit(c)), F.struct((n - F.instr(F.reverse(text), c[::-1]) - len(c) + 1).alias("place"), F.lit(-i).alias("_order"), F.lit(c).alias("cue"))) for i, c in enumerate(cues)))
    best = F.array_max(F.array_compact(hits))
    return F.when(best.isNotNull(), F.struct(best["place"].alias("place"), best["cue"].alias("cue")))


# Error categories in the order in which they are tried, and what marks them.
ERRORS = (
    ("provider_rate_limit", ("429", "rate limit", "too many requests")), ("provider_auth", ("401", "403", "unauthorized", "forbidden", "invalid api key", "authentication")),
    ("provider_timeout", ("timeout", "timed out")), ("provider_unavailable", ("500", "502", "503", "504", "unavailable")), ("provider_bad_request", ("400", "bad request", "invalid_request")),
    ("invalid_model_response", ("no choices", "invalid json", "could not parse")), ("schema_validation", ("schema",)), ("evidence_validation", ("evidence",)),
    ("provider_unavailable", ("network", "urlerror", "connection", "unreachable", "refused")))
UNKNOWN_ERROR = "unknown_provider_error"
QUOTA_MARKS = ("daily limit", "requests per day", "per-day", "quota exceeded", "quota_exhausted", "try again tomorrow", "free-models-per-day")
WINDOW_MARKS = ("per minute", "per second", "try again in")
MESSAGES = {
    "provider_rate_limit": "El proveedor de IA está temporalmente limitado. Intenta nuevamente en unos minutos o selecciona otro proveedor.",
    "provider_auth": "El proveedor de IA no está correctamente configurado.", "provider_timeout": "El proveedor de IA tardó demasiado en responder.",
    "provider_unavailable": "No fue posible conectar con el proveedor de IA.", "provider_bad_request": "El proveedor de IA no pudo procesar esta conversación.",
    "invalid_model_response": "El proveedor de IA no pudo procesar esta conversación.", "schema_validation": "El proveedor de IA no pudo procesar esta conversación.",
    "evidence_validation": "El proveedor de IA no pudo procesar esta conversación."}
UNKNOWN_MESSAGE = "No fue posible completar el análisis."


def _any(text: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(m) for m in marks))


def classify_error(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(text == "", UNKNOWN_ERROR)
    for name, marks in ERRORS:
        out = out.when(_any(text, marks), name)
    return out.otherwise(UNKNOWN_ERROR)


def humanize_error(code: Column) -> Column:
    return lookup(code, MESSAGES, F.lit(UNKNOWN_MESSAGE))


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def http_status(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"HTTP\s+([0-9]{3})", 1), F.lit("")).cast("int")


def is_rate_limit(c: Column) -> Column:
    return _any(_low(c), ("429", "rate limit", "rate_limit"))


def is_quota_exhausted(c: Column) -> Column:
    """A daily or global quota is used up: a mark says so, none remains, or a rate limit was reached and no short window is named."""
    return _any(_low(c), QUOTA_MARKS) | _low(c).rlike(r"remaining[\"']?\s*[:=]\s*0(?![0-9])") | (_low(c).contains("rate limit reached") & ~_any(_low(c), WINDOW_MARKS))


def is_timeout(c: Column) -> Column:
    return _any(_low(c), ("timeout", "timed out"))


def is_server_error(c: Column) -> Column:
    return _any(F.coalesce(c, F.lit("")), ("HTTP 500", "HTTP 502", "HTTP 503", "HTTP 504"))


def is_transient(c: Column) -> Column:
    return (is_rate_limit(c) & ~is_quota_exhausted(c)) | is_timeout(c) | is_server_error(c)
