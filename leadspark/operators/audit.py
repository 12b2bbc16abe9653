"""Quality audit of raw tables: profiles, duplicates, variants, formats, cross-table checks, history and an issue list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.functions import fields as f
from leadspark.functions.text import normalize_key, trim
from leadspark.operators.quantiles import quantiles, with_quantiles
from leadspark.scratch import materialize


def unpivot(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) of string columns: one pass over the table."""
    names = columns or rows.columns
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names))).alias("r")).select("r.column", "r.value")


def value_class(c: Column) -> Column:
    """Kind of a value: integer, decimal, date, phone, e-mail or text."""
    v = trim(c)
    digits = f.phone_digits(v)
    return (F.when(v == "", "blank").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}"), "date").when(v.rlike(r"^[+(]?[0-9][0-9() +-]*$") & F.length(digits).between(9, 12), "phone")
            .when(v.rlike(r"^-?[0-9]+$"), "integer").when(v.rlike(r"^-?[0-9]*[.][0-9]+$"), "decimal").when(f.is_valid_email(v), "email").otherwise("text"))


def profile_columns(rows: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """A row per column: n, nulls (null or blank), distinct, type (dates from 95 %), and the most common values with counts.

    Values are counted once per (column, value); the profile is an aggregation of these counts, and the top values are
    the largest of a bounded list per column.
    """
    counts = unpivot(rows, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    blank = F.coalesce(trim(F.col("value")), F.lit("")) == ""
    kind = value_class(F.col("value"))
    part = lambda k: F.sum(F.when(~blank & (kind == k), F.col("n")).otherwise(0))
    filled = F.sum(F.when(~blank, F.col("n")).otherwise(0))
    out = counts.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(~blank).alias("distinct"), filled.alias("_filled"), *(part(k).alias(f"_{k}") for k in ("date", "phone", "integer", "decimal", "email")))
    kind = F.when(F.col("_filled") == 0, "empty").when(F.col("_date") >= 0.95 * F.col("_filled"), "date")
    for k in ("phone", "integer", "email"):
        kind = kind.when(F.col(f"_{k}") == F.col("_filled"), k)
    kind = kind.when(F.col("_integer") + F.col("_decimal") == F.col("_filled"), "decimal").otherwise("text")
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    tops = counts.where(~blank).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top).groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda x: F.concat(x["value"], F.lit(":"), x["n"])), "|").alias("top"))
    return out.withColumn("type", kind).join(tops, "column", "left").select("column", "n", "nulls", "distinct", "type", "top")


def profile_conversations(talks: DataFrame, messages: str = "messages") -> DataFrame:
    """One row: conversations, messages, and the names, sorted, of columns and of message fields that hold a value anywhere."""
    own = [c for c in sorted(talks.columns)]
    parts = sorted(talks.schema[messages].dataType.elementType.names)
    filled = [F.max(F.col(c).isNotNull()).alias(f"_c{i}") for i, c in enumerate(own)]
    held = lambda name: F.exists(messages, lambda m: m[name].isNotNull())
    inner = [F.max(held(p)).alias(f"_m{i}") for i, p in enumerate(parts)]
    sums = talks.agg(F.count("*").alias("conversations"), F.coalesce(F.sum(F.size(messages)), F.lit(0)).alias("messages"), *filled, *inner)
    names = lambda mark, all_: F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{mark}{i}"), F.lit(c)) for i, c in enumerate(all_)))), ",")
    return sums.select("conversations", "messages", names("_c", own).alias("columns"), names("_m", parts).alias("message_columns"))


def missing_values(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, blank, share) of columns with blanks."""
    blank = F.coalesce(trim(F.col("value")), F.lit("")) == ""
    return unpivot(rows, columns).groupBy("column").agg(F.count_if(blank).alias("blank"), (F.count_if(blank) / F.count("*")).alias("share")).where("blank > 0")


def duplicate_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: groups of rows equal in all columns, and the extra rows in them."""
    return rows.groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extras"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def value_variants(rows: DataFrame, column: str, normalized: Column) -> DataFrame:
    """(value, variants, n): raw spellings behind each normalised value; null: blank."""
    return rows.groupBy(normalized.alias("value")).agg(F.count_distinct(column).alias("variants"), F.count("*").alias("n"))


def status_contact_matrix(rows: DataFrame) -> DataFrame:
    has = F.coalesce(trim(F.col("fecha_primer_contacto")), F.lit("")) != ""
    return rows.groupBy(f.normalize_status(F.col("estado_gestion")).alias("status")).agg(F.count_if(has).alias("with_contact"), F.count_if(~has).alias("without_contact"))


def name_analysis(rows: DataFrame) -> DataFrame:
    n = F.col("nombre_cliente")
    one = rows.agg(F.count_if((n != trim(n)) | n.rlike(r"\s{2,}")).alias("extra_spaces"), F.count_if((n == F.upper(n)) & (n != F.lower(n))).alias("upper_case"))
    again = rows.groupBy(normalize_key(n), f.normalize_phone(F.col("telefono"))).count().where("count > 1").agg(F.count("*").alias("repeated_name_phone"))
    return one.join(again)


def phone_analysis(rows: DataFrame) -> DataFrame:
    """One row. Looser than a lead's phone: 10 to 12 digits are valid here."""
    p = rows.withColumn("_p", f.normalize_phone(F.col("telefono")))
    digits = F.length(f.phone_digits(F.col("telefono")))
    one = p.agg(F.count_if(~digits.between(10, 12)).alias("invalid"))
    shared = p.where("_p is not null").groupBy("_p").agg(F.count_distinct("lead_id").alias("leads")).where("leads > 1").agg(F.count("*").alias("shared_phones"), F.max("leads").alias("most_leads"))
    return one.join(shared)


def email_analysis(rows: DataFrame) -> DataFrame:
    e = f.normalize_email(F.col("email"))
    one = rows.agg(F.count(e).alias("present"), F.count_if(e.isNull()).alias("missing"), F.count_if(e.isNotNull() & ~f.is_valid_email(F.col("email"))).alias("invalid"))
    return one.join(rows.where(e.isNotNull()).groupBy(e).count().where("count > 1").agg(F.count("*").alias("repeated")))


def date_formats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, format, n, ambiguous)."""
    long = unpivot(rows, columns).withColumn("i", f.classify_date(F.col("value")))
    return long.groupBy("column", F.col("i.format").alias("format")).agg(F.count("*").alias("n"), F.count_if(F.col("i.ambiguous")).alias("ambiguous"))


def chronology(rows: DataFrame) -> DataFrame:
    """One row: contacts before registration, pairs that do not parse, ambiguous pairs left out."""
    r = rows.select(f.classify_date(F.col("fecha_registro")).alias("a"), f.classify_date(F.col("fecha_primer_contacto")).alias("b"))
    both = F.col("a.parsed").isNotNull() & F.col("b.parsed").isNotNull()
    unsure = F.col("a.ambiguous") | F.col("b.ambiguous")
    return r.agg(F.count_if(both & ~unsure & (F.col("b.parsed") < F.col("a.parsed"))).alias("contact_before_registration"), F.count_if(~both).alias("unparsed"), F.count_if(both & unsure).alias("skipped_ambiguous"))


def chronology_examples(rows: DataFrame, k: int = 5) -> DataFrame:
    """(row_number, lead_id, fecha_registro, fecha_primer_contacto) of the first k rows whose contact is before the registration: a top-k, no sort of the table."""
    a, b = f.classify_date(F.col("fecha_registro")), f.classify_date(F.col("fecha_primer_contacto"))
    wrong = ~a["ambiguous"] & ~b["ambiguous"] & (b["parsed"] < a["parsed"])
    return rows.where(wrong).select("row_number", "lead_id", "fecha_registro", "fecha_primer_contacto").orderBy("row_number").limit(k)


def match_histogram(matched: DataFrame) -> DataFrame:
    return matched.groupBy("match_type").agg(F.count("*").alias("n"), F.count_distinct("model_text_raw").alias("texts"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """(dimension, value, n, price, units and branch ranges) for the whole catalogue, each brand, segment and engine size: one aggregation.

    units and branches (how many branches have it) come from availability, if the catalogue has it.
    """
    held = "availability" in catalog.columns
    units, branches = (F.col("availability.units_total"), F.size("availability.points_of_sale")) if held else (F.lit(None).cast("int"), F.lit(None).cast("int"))
    parts = F.array(F.struct(F.lit("all").alias("d"), F.lit("").alias("v")), *(F.struct(F.lit(c).alias("d"), F.col(c).cast("string").alias("v")) for c in ("brand", "segment", "engine_cc")))
    rows = catalog.select("line", "list_price", units.alias("u"), branches.alias("b"), F.explode(parts).alias("p"))
    return rows.groupBy(F.col("p.d").alias("dimension"), F.col("p.v").alias("value")).agg(
        F.count("*").alias("n"), F.count_distinct("line").alias("lines"), F.min("list_price").alias("price_min"), F.max("list_price").alias("price_max"), (F.floor(F.avg("list_price") * 100 + 0.5) / 100).alias("price_mean"),
        F.sum("u").alias("units_total"), F.min("u").alias("units_min"), F.max("u").alias("units_max"), F.min("b").alias("branches_min"), F.max("b").alias("branches_max"))


def advisor_summary(advisors: DataFrame, org: DataFrame) -> DataFrame:
    """(branch, company, advisors, active, capacity) of every branch, also of those without an active advisor."""
    a = advisors.groupBy("point_of_sale_id").agg(F.count("*").alias("advisors"), F.count_if("active").alias("active"), F.sum(F.when(F.col("active"), F.col("daily_capacity")).otherwise(0)).alias("capacity"))
    return org.select("point_of_sale_id", "company_id").join(a, "point_of_sale_id", "left").fillna(0, ["advisors", "active", "capacity"])


def conversation_stats(talks: DataFrame, leads: DataFrame) -> DataFrame:
    """One row on conversations (lead_id, messages): links, empties, first sender, and messages, characters and words of each (range, mean, median)."""
    m = F.col("messages")
    known = leads.select(F.col("lead_id").alias("_lead")).distinct()
    total = lambda each: F.aggregate(F.transform(m, each), F.lit(0), lambda a, x: a + x)
    text = lambda x: F.coalesce(x["text"], F.lit(""))
    measures = {"messages": F.size(m), "characters": total(lambda x: F.length(text(x))), "words": total(lambda x: F.regexp_count(text(x), F.lit(r"\S+")))}
    t = talks.select("lead_id", F.size(F.array_distinct(F.transform(m, lambda x: x["sender"]))).alias("_senders"), F.get(m, F.lit(0))["sender"].alias("_first"), *(v.cast("long").alias(k) for k, v in measures.items()))
    t = materialize(t.join(known, F.col("lead_id") == F.col("_lead"), "left"), "talks")
    ranges = [f(k).alias(f"{k}_{n}") for k in measures for n, f in (("min", F.min), ("max", F.max), ("mean", lambda x: F.floor(F.avg(x) * 10 + 0.5) / 10))]
    out = t.agg(F.count("*").alias("conversations"), F.count("_lead").alias("matched"), F.count_if(F.col("_lead").isNull()).alias("unmatched"), F.count_if(F.col("messages") == 0).alias("empty"), F.count_if(F.col("_first") != "cliente").alias("not_by_customer"),
                F.count_if(F.col("_senders") == 1).alias("single_sender"), F.sum("messages").alias("messages"), *ranges)
    for k in measures:
        out = with_quantiles(out, quantiles(t, [], k, {f"{k}_median": (0.5, "linear")}), [])
    return out


def sender_counts(talks: DataFrame) -> DataFrame:
    """(sender, n): messages of each sender."""
    return talks.select(F.explode("messages").alias("m")).groupBy(F.col("m.sender").alias("sender")).agg(F.count("*").alias("n"))


def chat_coverage(talks: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: leads without a conversation, lead ids with several, and conversations of unknown leads."""
    chats = talks.groupBy("lead_id").agg(F.count("*").alias("_n"))
    both = leads.select("lead_id").distinct().withColumn("_lead", F.lit(True)).join(chats, "lead_id", "full")
    return both.agg(F.count_if(F.col("_lead") & F.col("_n").isNull()).alias("leads_without_chat"), F.count_if(F.col("_n") > 1).alias("leads_with_several"), F.coalesce(F.sum(F.when(F.col("_lead").isNull(), F.col("_n"))), F.lit(0)).alias("unmatched"))


def key_overlap(a: DataFrame, b: DataFrame, key: str = "lead_id") -> DataFrame:
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), key, "full").agg(F.count("_a").alias("left_keys"), F.count("_b").alias("right_keys"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def branches_without_advisor(org: DataFrame, advisors: DataFrame) -> DataFrame:
    return org.select("point_of_sale_id").join(advisors.where("active").select("point_of_sale_id"), "point_of_sale_id", "left_anti")


def availability_check(catalog: DataFrame, org: DataFrame, advisors: DataFrame) -> DataFrame:
    """(kind, sku, point_of_sale_id) from the branches that the catalogue (sku, availability) says have a product.

    unknown_branch: no such branch, for each product; without_advisor: a branch of the catalogue without an active
    advisor, once each (sku null). Branches meet by equi-joins on the exploded lists.
    """
    each = catalog.select("sku", F.explode("availability.points_of_sale").alias("point_of_sale_id"))
    unknown = each.join(org.select("point_of_sale_id"), "point_of_sale_id", "left_anti").select(F.lit("unknown_branch").alias("kind"), "sku", "point_of_sale_id")
    staffed = advisors.where("active").select("point_of_sale_id").distinct()
    alone = each.select("point_of_sale_id").distinct().join(staffed, "point_of_sale_id", "left_anti").select(F.lit("without_advisor").alias("kind"), F.lit(None).cast("string").alias("sku"), "point_of_sale_id")
    return unknown.unionByName(alone)


def with_catalog_price(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """history with catalog_price: that of the model by brand and line, else by line alone, null if the catalogue has neither. Of rows with one key the highest price counts."""
    priced = lambda key, name: catalog.select(key.alias("_key"), F.col("list_price").alias("_p")).where("_key <> ''").groupBy("_key").agg(F.max("_p").alias(name))
    full, line = priced(f.normalize_model_text(F.concat_ws(" ", "brand", "line")), "_full"), priced(f.normalize_model_text(F.col("line")), "_line")
    out = history.withColumn("_key", f.normalize_model_text(F.col("model"))).join(full, "_key", "left").join(line, "_key", "left")
    return out.withColumn("catalog_price", F.coalesce("_full", "_line")).drop("_key", "_full", "_line")


def history_vs_catalog(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: history rows whose model the catalogue has (by brand and line, or by line), has not, or has at another price."""
    price = F.col("catalog_price")
    return with_catalog_price(history, catalog).agg(F.count(price).alias("known"), F.count_if(price.isNull()).alias("unknown"), F.count_if(price != F.col("price")).alias("price_differs"))


def unknown_models(history: DataFrame, catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """(dataset, text, n): models of the history that the catalogue has not, and product texts of leads without a match (matched: match_type, model_text_raw)."""
    old = with_catalog_price(history, catalog).where("catalog_price is null").groupBy(F.col("model").alias("text")).agg(F.count("*").alias("n"))
    new = matched.where("match_type = 'sin_match'").groupBy(F.col("model_text_raw").alias("text")).agg(F.count("*").alias("n"))
    return union([old.select(F.lit("history").alias("dataset"), "text", "n"), new.select(F.lit("leads").alias("dataset"), "text", "n")])


def history_distribution(history: DataFrame) -> DataFrame:
    """(company_id, channel, outcome, n) with subtotals, null for all: grouping sets in one pass."""
    c = {n: F.col(n) for n in ("company_id", "channel", "outcome")}
    sets = [[c["outcome"]], [c["company_id"]], [c["channel"]], [c["company_id"], c["outcome"]], [c["channel"], c["outcome"]]]
    g = history.groupingSets(sets, *c.values())
    return g.agg(F.count("*").alias("n"))


def history_numeric_stats(history: DataFrame, columns: list[str]) -> DataFrame:
    """(field, outcome, n, min, max, mean, median); blanks and non-numbers are left out."""
    long = history.select("outcome", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").try_cast("double").alias("v")) for c in columns))).alias("r")).select("outcome", "r.field", "r.v").where("v is not null")
    by = ["field", "outcome"]
    stats = long.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.floor(F.avg("v") * 100 + 0.5) / 100).alias("mean"))
    return with_quantiles(stats, quantiles(long, by, "v", {"median": (0.5, "linear")}), by)


def leakage_check(history: DataFrame, column: str, outcome: str) -> DataFrame:
    """One row: blanks and zeros of a column inside and outside one outcome."""
    blank, zero, inside = F.coalesce(trim(F.col(column).cast("string")), F.lit("")) == "", F.col(column).cast("string").try_cast("double") == 0, F.col("outcome") == outcome
    return history.agg(F.lit(column).alias("field"), F.count_if(blank & inside).alias("blank_inside"), F.count_if(blank & ~inside).alias("blank_outside"), F.count_if(zero & inside).alias("zero_inside"), F.count_if(zero & ~inside).alias("zero_outside"))


def conversion_rate(history: DataFrame, *by: str) -> DataFrame:
    won, lost = F.count_if(F.col("outcome") == "Cerrado"), F.count_if(F.col("outcome") == "Perdido")
    return history.groupBy(*by).agg((won + lost).alias("n"), F.try_divide(won.cast("double"), (won + lost).cast("double")).alias("rate"))


#: Issues found per lead row; id, field, kind, class of remedy.
ISSUES = (
    ("I01", "nombre_cliente", "extra_spaces", "auto"), ("I02", "telefono", "invalid_phone", "human"), ("I03", "email", "invalid_email", "human"), ("I04", "email", "missing", "keep"), ("I05", "ciudad", "missing", "keep"), ("I06", "ciudad", "unresolved", "human"),
    ("I07", "canal", "missing", "keep"), ("I08", "fecha_registro", "ambiguous_date", "rule"), ("I09", "fecha_registro", "unknown_date", "human"), ("I10", "fecha_primer_contacto", "missing", "keep"), ("I11", "estado_gestion", "variant_spelling", "auto"), ("I12", "campania", "missing", "keep"), ("I13", "modelo_interes_texto", "missing", "keep"))


def issue_catalog(rows: DataFrame) -> DataFrame:
    """(issue_id, field, kind, remedy, affected) for issues with at least one row: one conditional aggregation."""
    b = lambda c: F.coalesce(trim(F.col(c)), F.lit("")) == ""
    reg = f.classify_date(F.col("fecha_registro"))
    found = {
        "I01": (F.col("nombre_cliente") != trim(F.col("nombre_cliente"))) | F.col("nombre_cliente").rlike(r"\s{2,}"), "I02": ~f.is_valid_phone(F.col("telefono")), "I03": ~b("email") & ~f.is_valid_email(F.col("email")), "I04": b("email"), "I05": b("ciudad"),
        "I06": f.resolve_city(F.col("ciudad"))["status"] == "unresolved", "I07": b("canal"), "I08": reg["ambiguous"], "I09": reg["format"] == "desconocido", "I10": b("fecha_primer_contacto"), "I11": ~b("estado_gestion") & (f.normalize_status(F.col("estado_gestion")) != F.col("estado_gestion")), "I12": b("campania"), "I13": b("modelo_interes_texto")}
    sums = rows.agg(*(F.count_if(v).alias(k) for k, v in found.items()))
    long = sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("issue_id"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(remedy).alias("remedy"), F.col(i).alias("affected")) for i, field, kind, remedy in ISSUES))).alias("r"))
    return long.select("r.*").where("affected > 0")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: The issues of the whole audit; id, tables, field, kind, class of remedy.
ALL_ISSUES = (
    ("Q01", "leads", "lead_id", "duplicados", "auto"), ("Q02", "leads", "canal", "formatos", "auto"), ("Q03", "leads", "estado_gestion", "formatos", "auto"), ("Q04", "leads", "fecha_registro / fecha_primer_contacto", "fechas", "rule"), ("Q05", "leads", "fecha_registro", "fechas", "auto"),
    ("Q06", "leads", "fecha_primer_contacto", "integridad", "human"), ("Q07", "leads", "telefono", "formatos", "auto"), ("Q08", "leads", "telefono", "valores_invalidos", "human"), ("Q09", "leads", "telefono", "duplicados", "rule"), ("Q10", "leads", "email", "valores_faltantes", "rule"),
    ("Q11", "leads", "email", "duplicados", "human"), ("Q12", "leads", "ciudad", "formatos", "auto"), ("Q13", "leads", "ciudad", "valores_faltantes", "rule"), ("Q14", "leads", "modelo_interes_texto", "formatos", "rule"), ("Q15", "leads", "modelo_interes_texto", "formatos", "auto"),
    ("Q16", "leads", "modelo_interes_texto", "valores_faltantes", "rule"), ("Q17", "leads", "campania", "valores_faltantes", "keep"), ("Q18", "leads", "fecha_primer_contacto", "integridad", "rule"), ("Q19", "leads", "fecha_registro / fecha_primer_contacto", "fechas", "human"), ("Q20", "leads", "canal", "valores_faltantes", "rule"),
    ("Q21", "leads", "nombre_cliente", "formatos", "auto"), ("Q22", "leads", "nombre_cliente / telefono", "duplicados", "rule"), ("R01", "todos", "punto_venta_id / empresa_id", "referencias", "keep"), ("R02", "catalogo_motos", "puntos_venta_disponibles", "referencias", "keep"), ("R03", "leads / historico_cierres", "lead_id", "llave_compartida", "rule"),
    ("C01", "conversaciones", "lead_id", "referencia_rota", "human"), ("C02", "conversaciones", "lead_id", "duplicados", "rule"), ("C03", "leads", "lead_id", "cobertura", "keep"), ("H01", "historico_cierres", "horas_al_primer_contacto", "data_leakage", "rule"), ("H02", "historico_cierres", "numero_contactos", "data_leakage", "rule"),
    ("H03", "historico_cierres", "desenlace", "desbalance_clases", "keep"), ("K01", "catalogo_motos / historico_cierres", "modelo_cotizado / marca+linea", "consistencia", "keep"), ("K02", "catalogo_motos / historico_cierres", "precio_lista", "consistencia", "keep"), ("A01", "asesores", "activo", "estado", "keep"), ("A02", "asesores", "punto_venta_id / empresa_id", "referencias", "keep"))


def issues(rows: DataFrame, columns: list[str], matched: DataFrame, org: DataFrame, catalog: DataFrame, advisors: DataFrame, history: DataFrame, talks: DataFrame) -> DataFrame:
    """(issue_id, dataset, field, kind, remedy, affected): all issues of the audit, those with nothing affected too.

    rows: raw leads with the columns that make a row; matched: match_type of each row's product text by the cascade without
    similarity; catalog with availability; history: lead_id, model, price, outcome, contacts, hours. Row checks are one
    aggregation; groups, references and tables against tables are aggregations and equi-joins of their own, put together
    by union(). R03 counts keys that leads and history share; R01 and A02 count references to unknown branches and
    branches of another company, of leads and advisors and of advisors alone.
    """
    blank = lambda c: F.coalesce(trim(F.col(c)), F.lit("")) == ""
    reg, con = f.classify_date(F.col("fecha_registro")), f.classify_date(F.col("fecha_primer_contacto"))
    digits, status = F.length(f.phone_digits(F.col("telefono"))), f.normalize_status(F.col("estado_gestion"))
    name = F.col("nombre_cliente")
    by_row = {
        "Q02": ~blank("canal") & ~trim(F.col("canal")).isin("WhatsApp", "Meta Ads", "Formulario Web"), "Q03": ~trim(F.col("estado_gestion")).eqNullSafe(status), "Q04": reg["format"] == f.SLASH, "Q05": reg["format"].isin("ISO_T", "ISO_SPACE", f.DASH),
        "Q06": ~reg["ambiguous"] & ~con["ambiguous"] & (con["parsed"] < reg["parsed"]), "Q07": ~f.phone_format(F.col("telefono")).isin("plano_10", "vacio"), "Q08": ~digits.between(10, 12), "Q10": blank("email"), "Q13": blank("ciudad"), "Q16": blank("modelo_interes_texto"), "Q17": blank("campania"),
        "Q18": blank("fecha_primer_contacto") & ~status.eqNullSafe("Sin gestión"), "Q20": blank("canal"), "Q21": (name != trim(name)) | F.contains(name, F.lit("  "))}
    one = lambda i, df: df.select(F.lit(i).alias("issue_id"), F.col(df.columns[0]).cast("long").alias("affected"))
    counted = rows.agg(*(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in by_row.items()))
    groups = lambda keys, df=rows: df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    phone, mail, city = f.normalize_phone(F.col("telefono")), f.normalize_email(F.col("email")), trim(F.col("ciudad"))
    shared = rows.where(phone.isNotNull()).groupBy(phone.alias("p")).agg(F.count_distinct("lead_id").alias("_n")).where("_n > 1")
    unreadable = unpivot(rows, ["fecha_registro", "fecha_primer_contacto"]).where(f.classify_date(F.col("value"))["format"] == "desconocido").select("column", trim(F.col("value")).alias("v")).distinct()
    types = matched.agg(F.count_if(F.col("match_type").isin("solo_marca", "prefijo_ambiguo")).alias("Q14"), F.count_if(F.col("match_type").isin("directo_unico", "prefijo_unico")).alias("Q15"))
    cities = rows.where(~blank("ciudad")).agg((F.count_distinct(city) - F.count_distinct(f.resolve_city(F.col("ciudad"))["key"])).alias("n"))
    owner = org.select(F.col("point_of_sale_id").alias("_pos"), F.col("company_id").alias("_owner"))
    refs = lambda df, pos, company: df.select(F.col(pos).alias("_p"), F.col(company).alias("_c")).join(owner, F.col("_p") == F.col("_pos"), "left").where("_owner is null or (_c <> '' and _owner <> _c)")
    people = refs(advisors, "point_of_sale_id", "company_id")
    chats = chat_coverage(talks, rows)
    past = history.agg(F.count_if(F.coalesce(trim(F.col("hours").cast("string")), F.lit("")) == "").alias("H01"), F.count_if(F.col("contacts").cast("double") == 0).alias("H02"), F.count_if(F.col("outcome") == "Cerrado").alias("H03"))
    prices = history_vs_catalog(history, catalog)
    number = lambda df: df.agg(F.count("*").alias("n"))
    pivot = lambda df, names: df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("issue_id"), F.col(c).cast("long").alias("affected")) for i, c in names.items()))).alias("r")).select("r.*")
    found = union([
        pivot(counted, {k: k for k in by_row}), one("Q01", groups(columns).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))), one("Q09", number(shared)), one("Q11", number(groups([mail], rows.where(mail.isNotNull())))), one("Q12", cities), pivot(types, {"Q14": "Q14", "Q15": "Q15"}),
        one("Q19", number(unreadable)), one("Q22", number(groups([normalize_key(name), phone]))), one("R01", number(refs(rows, "punto_venta_id", "empresa_id").unionByName(people))), one("R02", number(availability_check(catalog, org, advisors).where("kind = 'unknown_branch'"))),
        one("R03", key_overlap(rows, history).select("both")), pivot(chats, {"C01": "unmatched", "C02": "leads_with_several", "C03": "leads_without_chat"}), pivot(past, {"H01": "H01", "H02": "H02", "H03": "H03"}), pivot(prices, {"K01": "unknown", "K02": "price_differs"}),
        one("A01", advisors.agg(F.count_if(~F.col("active")).alias("n"))), one("A02", number(people))])
    names = rows.sparkSession.createDataFrame(list(ALL_ISSUES), "issue_id string, dataset string, field string, kind string, remedy string")
    return names.join(F.broadcast(found), "issue_id")  # a row for each issue
