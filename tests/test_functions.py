"""Golden cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadspark.functions import fields as f
from leadspark.functions import signals as g
from leadspark.functions import text as t
from leadspark.functions.similarity import jaro_winkler_value


def value(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_text(spark):
    assert value(spark, t.normalize_key, "  ÁRBOL   Ñandú ", None, "ﬁn ½") == ["arbol nandu", "", "ﬁn 1⁄2"]
    assert value(spark, t.display_name, "BRAYAN TORRES OSORIO", "MismoPos", "  ", None, "o'neil pérez-díaz") == ["Brayan Torres Osorio", "MismoPos", None, None, "O'Neil Pérez-Díaz"]
    assert value(spark, t.normalize_for_match, "¡Sí, señor!  ¿Cómo?", None) == ["si senor como", ""]


def test_fields(spark):
    assert value(spark, f.normalize_phone, "+57 350 2258611", "322-624-9127", "300123", "", None) == ["3502258611", "3226249127", "300123", None, None]
    assert value(spark, f.is_valid_phone, "+57 350 2258611", "300123", None, "57300123456") == [True, False, False, False]
    cities = value(spark, lambda c: f.resolve_city(c)["canonical"], "bogota d.c.", "b/quilla", "sta marta", "rio negro", "MONTERIA", "Ciudad X", "")
    assert cities == ["Bogotá", "Barranquilla", "Santa Marta", "Rionegro", "Montería", None, None]
    assert value(spark, f.normalize_channel, "WHATSAPP business", "meta", "formulario", "Otro", "") == ["WhatsApp", "Meta Ads", "Formulario Web", "Otro", None]
    assert value(spark, f.normalize_model_text, "Hnda CB.125 2024", "A K T nkd", "R 3") == ["honda cb 125", "akt nkd", "r3"]
    assert value(spark, f.phone_format, "3001234567", "573001234567", "+573001234567", "+57 300 123 4567", "300-123-4567", "(300) 123-4567", "12", "") == ["plano_10", "prefijo_57_sin_signo", "prefijo_57_con_signo", "prefijo_57_separado", "separado_10", "parentesis", "otro", "vacio"]


@pytest.mark.parametrize("text,fmt,ambiguous,parsed,trusted", [
    ("2026-05-04T10:20:30", "ISO_T", False, dt.datetime(2026, 5, 4, 10, 20, 30), True), ("2026-05-04", "ISO_DATE", False, dt.datetime(2026, 5, 4), True), ("25/04/2026 10:20", "DD/MM/YYYY", False, dt.datetime(2026, 4, 25, 10, 20), True),
    ("04/25/2026", "MM/DD/YYYY", False, dt.datetime(2026, 4, 25), True), ("04/05/2026", f.SLASH, True, dt.datetime(2026, 5, 4), False), ("04-05-2026 9:05", f.DASH, True, dt.datetime(2026, 5, 4, 9, 5), True), ("2026-08-33", "desconocido", False, None, False), ("", "vacio", False, None, False), (None, "vacio", False, None, False)])
def test_dates(spark, text, fmt, ambiguous, parsed, trusted):
    x = spark.createDataFrame([(text,)], "x string").select(f.classify_date(F.col("x")).alias("i")).select("i.*", f.trusted_date(F.col("i")).alias("t")).first()
    assert (x.format, x.ambiguous, x.parsed, x.t) == (fmt, ambiguous, parsed, parsed if trusted else None)


def test_amounts(spark):
    assert value(spark, g.amounts_in_text, "tengo 2,0 millones", "cuota de $480.000", "18 millones", "2000000", "nada", None) == [[2e6], [480000.0, 480000.0], [18e6], [2e6], [], []]


def test_payload(spark):
    rows = ['{"presupuesto": "$1.500.000", "presupuesto_evidence": " x ", "solicitud_cita": "SI", "objecion_evidence": "gone", "other": 1}', '{"presupuesto": true}', "{broken", '{"forma_pago": "EFECTIVO", "intencion_compra": "raro"}', "[1]"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(g.parse_payload(F.col("x"))).collect()]
    assert (got[0].success, got[0].schema_valid, got[0].presupuesto, got[0].presupuesto_evidence, got[0].solicitud_cita, got[0].objecion_evidence) == (True, True, 1500000.0, "x", True, None)
    assert [(x.success, bool(x.schema_valid)) for x in got[1:]] == [(True, False), (False, False), (True, False), (True, False)]


def test_jaro_winkler():
    assert jaro_winkler_value("", "") == 1.0 and jaro_winkler_value("", "a") == 0.0
    assert jaro_winkler_value("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler_value("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_errors(spark):
    assert value(spark, g.classify_error, "HTTP 429", "timed out", "weird", None) == ["provider_rate_limit", "provider_timeout", "unknown_provider_error", "unknown_provider_error"]
    assert value(spark, g.is_quota_exhausted, "rate limit reached, try again in 3s", "rate limit reached", None) == [False, True, False]


def test_labels_of_unknown_codes_are_whole(spark):
    from leadspark.functions.labels import reason_label

    row = spark.createDataFrame([("A" + "_B" * 1500,)], "c string").select(reason_label(F.col("c")).alias("x")).first()
    assert row.x == "A" + " b" * 1500
