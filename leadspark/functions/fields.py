"""Fields of a lead: channel, status, city, phone, e-mail, dates, product text, sender."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.functions.text import blank_to_null, lookup, normalize_key, trim

# They must equal what upstream systems write.
CHANNELS = {"whatsapp": "WhatsApp", "meta ads": "Meta Ads", "formulario web": "Formulario Web"}
STATUSES = {"contactado": "Contactado", "sin gestion": "Sin gestión", "cotizacion enviada": "Cotización enviada",
            "en proceso": "En proceso", "no contesta": "No contesta", "descartado": "Descartado"}
CITIES = {"bogota": "Bogotá", "medellin": "Medellín", "bello": "Bello", "monteria": "Montería", "soacha": "Soacha", "soledad": "Soledad",
          "cartagena": "Cartagena", "barranquilla": "Barranquilla", "santa marta": "Santa Marta", "itagui": "Itagüí", "rionegro": "Rionegro", "cali": "Cali"}
CITY_ALIASES = {"bogota d.c.": "bogota", "bogota dc": "bogota", "cartagena de indias": "cartagena", "sta marta": "santa marta",
                "rio negro": "rionegro", "b/quilla": "barranquilla"}
BRAND_TYPOS = {"bajai": "bajaj", "hnda": "honda", "heroo": "hero", "suzuky": "suzuki"}
SENDERS = {"cliente": "cliente", "client": "cliente", "customer": "cliente", "asesor": "asesor", "advisor": "asesor", "agent": "asesor", "agente": "asesor"}
OPEN = ("Sin gestión", "Contactado", "No contesta", "Cotización enviada", "En proceso")
TERMINAL = ("Cerrado", "Perdido", "Descartado")
CLOSE_REASONS = ("Venta realizada", "Cliente desistió", "No interesado", "Datos inválidos", "Otro")


def normalize_channel(c: Column) -> Column:
    key = normalize_key(c)
    rules = F.when(key == "", None).when(key.contains("whats"), "WhatsApp").when(key.contains("meta"), "Meta Ads").when(key.contains("form"), "Formulario Web").otherwise(trim(c))
    return lookup(key, CHANNELS, rules)


def normalize_status(c: Column) -> Column:
    key = normalize_key(c)
    return F.when(key != "", lookup(key, STATUSES, trim(c)))


def resolve_canonical(c: Column, catalog: dict[str, str], aliases: dict[str, str], method: str) -> Column:
    """struct(raw, key, canonical, status, method): alias, then catalogue; no guessing."""
    own = normalize_key(c)
    key = lookup(own, aliases, own)
    canonical = lookup(key, catalog)
    status = F.when(own == "", "empty").when(canonical.isNotNull(), "resolved").otherwise("unresolved")
    return F.struct(blank_to_null(c).alias("raw"), F.when(own == "", "").otherwise(key).alias("key"), canonical.alias("canonical"), status.alias("status"), F.lit(method).alias("method"))


def resolve_city(c: Column) -> Column:
    return resolve_canonical(c, CITIES, CITY_ALIASES, "city_canonical")


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def normalize_phone(c: Column) -> Column:
    digits = phone_digits(c)
    return F.when(F.length(digits).isin(11, 12) & digits.startswith("57"), F.substring(digits, 3, 20)).otherwise(F.nullif(digits, F.lit("")))


def is_valid_phone(c: Column) -> Column:
    return F.coalesce(F.length(normalize_phone(c)) == 10, F.lit(False))


#: Formats of a phone number, the first that matches in full.
PHONE_FORMATS = (
    ("plano_10", r"^[0-9]{10}$"), ("prefijo_57_sin_signo", r"^57[0-9]{10}$"), ("prefijo_57_con_signo", r"^\+57[0-9]{10}$"),
    ("prefijo_57_separado", r"^\+?57[\s-]?[0-9]{3}[\s-]?[0-9]{3}[\s-]?[0-9]{4}$"), ("separado_10", r"^[0-9]{3}[\s-][0-9]{3}[\s-][0-9]{4}$"),
    ("parentesis", r"^\([0-9]{3}\)[\s-]?[0-9]{3}[\s-]?[0-9]{4}$"))


def phone_format(c: Column) -> Column:
    text = trim(F.coalesce(c, F.lit("")))
    out = F.when(text == "", "vacio")
    for name, pattern in PHONE_FORMATS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("otro")


def normalize_email(c: Column) -> Column:
    return F.nullif(F.lower(trim(c)), F.lit(""))


def is_valid_email(c: Column) -> Column:
    return F.coalesce(trim(c).rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


SLASH, DASH = "DD/MM/YYYY vs MM/DD/YYYY", "DD-MM-YYYY"


def classify_date(c: Column) -> Column:
    """struct(format, ambiguous, parsed). ISO forms; slash dates by which part exceeds 12; dash dates as day first."""
    text = trim(F.coalesce(c, F.lit("")))
    parse = lambda f: F.try_to_timestamp(text, F.lit(f))
    iso = [(parse("yyyy-M-d'T'H:m:s"), r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "ISO_T"),
           (parse("yyyy-M-d H:m:s"), r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "ISO_SPACE"),
           (parse("yyyy-M-d"), r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "ISO_DATE")]
    timed = text.contains(" ")
    some = lambda f: F.when(timed, parse(f + " H:m")).otherwise(parse(f))
    shape = r"^([0-9]{1,2})%s([0-9]{1,2})%s([0-9]{4})(\s+[0-9]{1,2}:[0-9]{2})?$"
    slash, dash = shape % ("/", "/"), shape % ("-", "-")
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    made = lambda f, a, p: F.struct(F.lit(f).alias("format"), (a if isinstance(a, Column) else F.lit(a)).alias("ambiguous"), p.cast("timestamp").alias("parsed"))
    none = F.lit(None).cast("timestamp")
    out = F.when(text == "", made("vacio", False, none))
    for parsed, pattern, name in iso:
        out = out.when(text.rlike(pattern) & parsed.isNotNull(), made(name, False, parsed))
    out = out.when(text.rlike(slash), F.when(part(slash, 1) > 12, made("DD/MM/YYYY", False, some("d/M/yyyy"))).when(part(slash, 2) > 12, made("MM/DD/YYYY", False, some("M/d/yyyy"))).otherwise(made(SLASH, True, some("d/M/yyyy"))))
    out = out.when(text.rlike(dash), made(DASH, (part(dash, 1) <= 12) & (part(dash, 2) <= 12), some("d-M-yyyy")))
    return out.otherwise(made("desconocido", False, none))


def trusted_date(info: Column) -> Column:
    """parsed, but null for a slash date that could be either; dash dates count as day first."""
    return F.when((info["format"] == DASH) | ~info["ambiguous"], info["parsed"])


def date_reason(info: Column) -> Column:
    return (F.when(info["format"] == "vacio", "empty value").when(info["parsed"].isNull(), "unrecognized or impossible date")
            .when(info["format"] == SLASH, "slash date ambiguous between DD/MM and MM/DD")
            .when((info["format"] == DASH) & info["ambiguous"], "dash date with day and month <= 12, parsed as DD-MM by documented convention").otherwise("unambiguous"))


def normalize_model_text(c: Column) -> Column:
    """Product text for matching: no years 19xx and 20xx, letters and digits only, brand typos mended."""
    text = F.regexp_replace(normalize_key(c), r"\b(19|20)[0-9]{2}\b", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9 ]", " "), " +", " "))
    text = F.array_join(F.transform(F.split(text, " "), lambda t: lookup(t, BRAND_TYPOS, t)), " ")
    return F.regexp_replace(F.replace(text, F.lit("a k t"), F.lit("akt")), r"\br 3\b", "r3")


def normalize_sender(c: Column) -> Column:
    return lookup(normalize_key(c), SENDERS, trim(F.coalesce(c, F.lit(""))))


def is_terminal(c: Column) -> Column:
    return F.coalesce(c.isin(*TERMINAL), F.lit(False))


def is_open(c: Column) -> Column:
    """Anything that is not terminal, unknown and null included."""
    return ~is_terminal(c)


def is_known_status(c: Column) -> Column:
    return F.coalesce(c.isin(*OPEN, *TERMINAL), F.lit(False))


def normalize_close_reason(c: Column) -> Column:
    return F.when(trim(c).isin(*CLOSE_REASONS), trim(c))
