"""Codes as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.functions.text import lookup, trim

# Labels shown for codes, dimensions and senders.
REASONS = {
    "BASE_GESTIONABLE": "Base gestionable", "INTENCION_ALTA": "Intención de compra alta", "INTENCION_MEDIA": "Intención de compra media", "INTENCION_BAJA": "Intención de compra baja", "INTENCION_INFORMATIVA": "Intención informativa",
    "CLIENTE_PIDIO_CITA": "El cliente pidió cita", "CLIENTE_PIDIO_COTIZACION": "El cliente pidió cotización", "PRESUPUESTO_COMPATIBLE": "Presupuesto compatible", "PRESUPUESTO_INSUFICIENTE": "Presupuesto insuficiente",
    "CUOTA_SUFICIENTE": "Cuota inicial suficiente", "FORMA_PAGO_DECLARADA": "Forma de pago declarada", "OBJECION_PRECIO": "Objeción: precio", "OBJECION_CUOTA": "Objeción: cuota", "OBJECION_FINANCIACION": "Objeción: financiación",
    "OBJECION_DISPONIBILIDAD": "Objeción: disponibilidad", "OBJECION_TIEMPO": "Objeción: tiempo", "OBJECION_MODELO": "Objeción: modelo", "OBJECION_UBICACION": "Objeción: ubicación", "OBJECION_OTRA": "Objeción: otra", "TICKET_REGLA_NEGOCIO": "Regla de ticket",
    "TELEFONO_VALIDO": "Teléfono contactable", "MODELO_RESUELTO": "Modelo identificado", "EMAIL_PRESENTE": "Email registrado", "CIUDAD_PRESENTE": "Ciudad registrada", "FECHA_CONFIABLE": "Fecha de registro confiable", "ESTADO_OPERATIVO": "Estado operativo",
    "ESTADO_DESCONOCIDO": "Estado de gestión desconocido", "URGENCIA_HOY_CITA": "Urgencia: cita hoy", "SIN_CONTACTO_MAS_48H": "Sin contacto por más de 48 h", "SIN_CONTACTO_24_48H": "Sin contacto entre 24 y 48 h", "SIN_GESTION_MAS_48H": "Sin gestión por más de 48 h",
    "FECHA_NO_CONFIABLE": "Fecha no confiable", "DUPLICADO_PROBABLE": "Duplicado probable"}
DIMENSIONS = {"commercial": "Comercial", "quality": "Calidad", "urgency": "Urgencia"}
SENDERS = {"cliente": "Cliente", "asesor": "Asesor"}


def reason_label(c: Column) -> Column:
    """The label of a reason; an unknown code as a sentence (SOME_CODE: Some code); Razón for none."""
    words = F.lower(F.trim(F.replace(trim(c), F.lit("_"), F.lit(" "))))
    sentence = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    return F.coalesce(lookup(trim(c), REASONS), F.nullif(sentence, F.lit("")), F.lit("Razón"))


def dimension_label(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(trim(c)), DIMENSIONS, trim(c)), F.lit(""))


def sender_label(c: Column) -> Column:
    """Unknown senders keep their name; nothing is assumed about them."""
    text = trim(c)
    return F.when(F.coalesce(text, F.lit("")) == "", "Emisor desconocido").otherwise(lookup(F.lower(text), SENDERS, text))
