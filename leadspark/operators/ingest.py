"""Ingestion of leads and conversations: first rows, branch checks, normalised fields, anomalies, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import fields as f
from leadspark.functions.text import blank_to_null, clean_display
from leadspark.operators.models import match_models
from leadspark.scratch import materialize, ranked

RAW = ("lead_id", "fecha_registro", "canal", "empresa_id", "punto_venta_id", "nombre_cliente", "telefono", "email", "ciudad", "modelo_interes_texto", "estado_gestion", "fecha_primer_contacto", "campania")


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def first_occurrence(rows: DataFrame, key: str = "lead_id", order: str = "row_number") -> DataFrame:
    """The first row of each key in file order, with n_rows, row_numbers (joined by ,) and identical.

    One aggregation and one shuffle: the first row is the minimum of a struct that starts with the row number, so rows of
    one key meet as partial minima and not as a sorted group; they are identical if the least hash is the greatest.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    g = rows.withColumn("_row", F.struct(order, *rest)).withColumn("_hash", content_hash(*[c for c in rest]))
    g = g.groupBy(key).agg(F.min("_row").alias("_first"), F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(order)), ",").alias("row_numbers"), (F.min("_hash") == F.max("_hash")).alias("identical"))
    return g.select(key, *(F.col(f"_first.{c}").alias(c) for c in (order, *rest)), "n_rows", "row_numbers", "identical")


def check_organization(leads: DataFrame, org: DataFrame) -> DataFrame:
    """leads with org_error: null, unknown_point_of_sale or foreign_company. The branch table is small; AQE picks its join."""
    o = org.select(F.col("point_of_sale_id").alias("_pos"), F.col("company_id").alias("_owner"))
    out = leads.join(o, F.trim("punto_venta_id") == F.col("_pos"), "left")
    error = F.when(F.col("_owner").isNull(), "unknown_point_of_sale").when(F.col("_owner") != F.trim("empresa_id"), "foreign_company")
    return out.withColumn("org_error", error).drop("_pos", "_owner")


def anomalies() -> Column:
    """Codes of what is odd about a normalised lead, in a fixed order."""
    c = F.col
    flags = (
        ("ambiguous_registration_date", c("reg.format") == f.SLASH), ("ambiguous_first_contact_date", c("cont.format") == f.SLASH),
        ("unknown_registration_date", c("reg.format") == "desconocido"), ("unknown_first_contact_date", c("cont.format") == "desconocido"),
        ("first_contact_before_registration", ~c("reg.ambiguous") & ~c("cont.ambiguous") & (c("first_contact_at") < c("registration_at"))),
        ("managed_without_first_contact", (c("status") != "Sin gestión") & (F.coalesce(F.trim("fecha_primer_contacto"), F.lit("")) == "")),
        ("invalid_phone", c("phone_normalized").isNull()), ("missing_city", c("city_raw").isNull()), ("unmatched_city", c("city_raw").isNotNull() & c("city_normalized").isNull()),
        ("ambiguous_model", c("match_state") == "ambiguous"), ("unmatched_model", c("match_state") == "unmatched"), ("missing_channel", c("channel").isNull()), ("duplicate_lead_id", c("n_rows") > 1))
    return F.array_compact(F.array(*(F.when(cond, name) for name, cond in flags)))


def normalize_leads(rows: DataFrame, org: DataFrame, catalog: DataFrame, fuzzy: bool = True, candidates: bool = True) -> DataFrame:
    """A row for each lead of raw rows with a valid branch: normalised fields, match, dates, anomalies and hashes; candidates as in match_models().

    First rows are kept as they came, since the distinct product texts and the leads are read from them; what follows is
    one projection, of which Spark computes only the columns that are asked for.
    """
    first = first_occurrence(rows.select("row_number", *RAW))
    ok = materialize(check_organization(first, org).where("org_error is null"), "first")
    n = ok.select(
        "lead_id", "row_number", F.trim("empresa_id").alias("company_id"), F.trim("punto_venta_id").alias("point_of_sale_id"), f.normalize_channel(F.col("canal")).alias("channel"), f.normalize_status(F.col("estado_gestion")).alias("status"),
        clean_display(F.col("nombre_cliente")).alias("customer_name"), F.nullif("telefono", F.lit("")).alias("phone_raw"), F.when(f.is_valid_phone(F.col("telefono")), f.normalize_phone(F.col("telefono"))).alias("phone_normalized"),
        blank_to_null(F.col("email")).alias("email_raw"), F.when(f.is_valid_email(F.col("email")), f.normalize_email(F.col("email"))).alias("email_normalized"), blank_to_null(F.col("ciudad")).alias("city_raw"), f.resolve_city(F.col("ciudad"))["canonical"].alias("city_normalized"),
        blank_to_null(F.col("modelo_interes_texto")).alias("model_text_raw"), f.classify_date(F.col("fecha_registro")).alias("reg"), f.classify_date(F.col("fecha_primer_contacto")).alias("cont"), "fecha_primer_contacto",
        blank_to_null(F.col("campania")).alias("campaign"), "n_rows", "row_numbers", "identical", content_hash(*RAW).alias("record_hash"))
    n = n.withColumns({"registration_at": f.trusted_date(F.col("reg")), "first_contact_at": f.trusted_date(F.col("cont"))})
    n = match_models(n, catalog, fuzzy=fuzzy, candidates=candidates, spread=["lead_id"])
    content = ("company_id", "point_of_sale_id", "channel", "status", "customer_name", "phone_normalized", "email_normalized", "city_raw", "city_normalized", "model_text_raw", "sku", "registration_at", "first_contact_at", "campaign")
    return n.withColumn("anomalies", anomalies()).withColumn("content_hash", content_hash(*content))


def ingestion_counters(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: what was read, kept and odd."""
    has = lambda code: F.count_if(F.array_contains("anomalies", code))
    kept = leads.agg(
        F.count("*").alias("persisted"), F.count_if(F.col("n_rows") > 1).alias("duplicated_ids"), has("ambiguous_registration_date").alias("ambiguous_registration"), has("ambiguous_first_contact_date").alias("ambiguous_first_contact"),
        F.count_if((F.col("reg.format") == f.DASH) & F.col("reg.ambiguous")).alias("ambiguous_by_convention"), has("first_contact_before_registration").alias("chronology"), has("managed_without_first_contact").alias("managed_without_first_contact"),
        has("invalid_phone").alias("invalid_phones"), F.count("city_normalized").alias("cities_normalized"), has("unmatched_city").alias("cities_unmatched"),
        *(F.count_if(F.col("match_state") == s).alias(f"models_{s}") for s in ("matched", "ambiguous", "unmatched", "empty")))
    read = rows.agg(F.count("*").alias("read"), F.count_distinct("lead_id").alias("lead_ids"))
    return read.join(kept).select("read", (F.col("read") - F.col("lead_ids")).alias("duplicates"), (F.col("lead_ids") - F.col("persisted")).alias("invalid_references"), *kept.columns)


def link_conversations(chats: DataFrame, leads: DataFrame) -> DataFrame:
    """chats with company_id, linked_lead and status linked or orphan; leads are never invented."""
    known = leads.select(F.col("lead_id").alias("_lead"), F.col("company_id").alias("_company"))
    out = chats.join(known, F.col("lead_id") == F.col("_lead"), "left")
    return out.select(*chats.columns, F.col("_lead").alias("linked_lead"), F.col("_company").alias("company_id"), F.when(F.col("_lead").isNotNull(), "linked").otherwise("orphan").alias("status"))


def upsert_diff(stored: DataFrame, new: DataFrame, run: int, key: str = "lead_id", digest: str = "content_hash") -> DataFrame:
    """A full snapshot: stored rows with their fate. change: inserted, updated, unchanged, or absent (kept as it was).

    stored has the same columns plus first_seen_run and last_seen_run.
    """
    rest = [c for c in new.columns if c != key]
    a, b = stored.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    here = F.col(f"b.{key}").isNotNull()
    change = F.when(F.col(f"a.{key}").isNull(), "inserted").when(~here, "absent").when(F.col(f"a.{digest}").eqNullSafe(F.col(f"b.{digest}")), "unchanged").otherwise("updated")
    return both.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(F.when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in rest), F.coalesce("a.first_seen_run", F.lit(run)).alias("first_seen_run"),
                       F.when(here, F.lit(run)).otherwise(F.col("a.last_seen_run")).alias("last_seen_run"), change.alias("change"))


def latest_current(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last current row of each key by the order columns: a maximum per key, no sort."""
    rest = [c for c in rows.columns if c not in order]
    last = rows.where("is_current").groupBy(key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_rest"))).alias("_r"))
    return last.select(*(F.col(f"_r.{c}") if c in order else F.col(f"_r._rest.{c}") for c in rows.columns))


def priority_rank(rows: DataFrame) -> DataFrame:
    """rows with priority_rank: 1, 2, ... in each company and branch by queue (null last) and lead_id."""
    return ranked(rows, ["company_id", "point_of_sale_id"], [F.col("queue").desc_nulls_last(), F.col("lead_id").asc()], "priority_rank")
