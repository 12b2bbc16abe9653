"""Registered queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions import fields as f
from leadspark.functions import labels
from leadspark.functions import signals as g
from leadspark.functions import text as t
from leadspark.operators import assign, audit, evaluate, identity, ingest, models, scoring, signals, views
from leadspark.plans import jobs
from leadspark.plans import oracles as o
from leadspark.scratch import materialize
from leadspark.sources import bridge, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATALOG_RANGE = {"catalog_min_price": 900.0, "catalog_max_price": 1000.0}
PARAMS = scoring.params(**CATALOG_RANGE)


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark, sf_dir, fuzzy=True, candidates=False):
    return ingest.normalize_leads(*(bridge.read(spark, sf_dir, n) for n in ("raw_leads", "org", "catalog")), fuzzy=fuzzy, candidates=candidates)


def kept_leads(spark, sf_dir):
    """The columns of leads() that others read, as a table, for plans that read it several times."""
    return materialize(leads(spark, sf_dir).select(*LEAD_COLUMNS), "leads")


def lead_scores(spark, sf_dir, n, p=None):
    return scoring.score_leads(scoring.lead_signals(n, bridge.read(spark, sf_dir, "catalog")), PARAMS if p is None else p)


def kept_scores(spark, sf_dir, n):
    """What views read of the scores, as a table."""
    return materialize(lead_scores(spark, sf_dir, n).select("lead_id", "queue", "band", "urgency_band"), "scores")


def scores(spark, sf_dir, p=None):
    return lead_scores(spark, sf_dir, kept_leads(spark, sf_dir), p)


def decisions(spark, sf_dir, n=None, s=None):
    """n, s: kept leads and their scores, where the query reads them too."""
    n = kept_leads(spark, sf_dir) if n is None else n
    s = lead_scores(spark, sf_dir, n) if s is None else s
    return assign.assign_leads(assign.eligible_candidates(n, s), bridge.read(spark, sf_dir, "advisors"))


# functions on text and fields

@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def f01_strip_accents(spark, d):
    return read(spark, d, "documents").select("doc_id", t.strip_accents(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {o.key('text')} AS key FROM documents")
def f02_normalize_key(spark, d):
    return read(spark, d, "documents").select("doc_id", t.normalize_key(F.col("text")).alias("key"))


@query(o.with_tables(f"SELECT row_number, {o.display('nombre_cliente')} AS shown FROM raw_leads", o.RAW))
def f03_clean_display(spark, d):
    return bridge.read(spark, d, "raw_leads").select("row_number", t.clean_display(F.col("nombre_cliente")).alias("shown"))


@query(o.with_tables(f"""SELECT row_number, array_to_string(list_transform(string_split({o.display('nombre_cliente')}, ' '), lambda w: CASE WHEN w = upper(w) OR w = lower(w) THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE w END), ' ') AS shown FROM raw_leads""", o.RAW))
def f04_display_name(spark, d):
    return bridge.read(spark, d, "raw_leads").select("row_number", t.display_name(F.col("nombre_cliente")).alias("shown"))


@query(o.with_tables(f"SELECT row_number, {o.channel('canal')} AS channel, {o.status('estado_gestion')} AS status FROM raw_leads", o.RAW))
def f05_f06_channel_status(spark, d):
    return bridge.read(spark, d, "raw_leads").select("row_number", f.normalize_channel(F.col("canal")).alias("channel"), f.normalize_status(F.col("estado_gestion")).alias("status"))


@query(o.with_tables(f"""SELECT row_number, CASE WHEN {o.key('ciudad')} = '' THEN '' ELSE {o.cases(o.key('ciudad'), f.CITY_ALIASES, o.key('ciudad'))} END AS key, {o.city('ciudad')} AS canonical,
 CASE WHEN {o.key('ciudad')} = '' THEN 'empty' WHEN {o.city('ciudad')} IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM raw_leads""", o.RAW))
def f07_resolve_city(spark, d):
    return bridge.read(spark, d, "raw_leads").select("row_number", f.resolve_city(F.col("ciudad")).alias("c")).select("row_number", "c.key", "c.canonical", "c.status")


@query(o.with_tables(f"SELECT row_number, {o.digits('telefono')} AS digits, {o.phone('telefono')} AS phone, coalesce(length({o.phone('telefono')}) = 10, false) AS valid FROM raw_leads", o.RAW))
def f08_phone(spark, d):
    p = F.col("telefono")
    return bridge.read(spark, d, "raw_leads").select("row_number", f.phone_digits(p).alias("digits"), f.normalize_phone(p).alias("phone"), f.is_valid_phone(p).alias("valid"))


@query(o.with_tables("SELECT CASE WHEN trim(telefono) = '' THEN 'vacio' " + " ".join(f"WHEN regexp_matches(trim(telefono), {o.quoted(p)}) THEN '{n}'" for n, p in f.PHONE_FORMATS) + " ELSE 'otro' END AS format, count(*) AS n FROM raw_leads GROUP BY 1", o.RAW))
def f09_phone_format(spark, d):
    return bridge.read(spark, d, "raw_leads").groupBy(f.phone_format(F.col("telefono")).alias("format")).agg(F.count("*").alias("n"))


@query(o.with_tables("SELECT row_number, nullif(lower(trim(email)), '') AS email, regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM raw_leads", o.RAW))
def f10_email(spark, d):
    return bridge.read(spark, d, "raw_leads").select("row_number", f.normalize_email(F.col("email")).alias("email"), f.is_valid_email(F.col("email")).alias("valid"))


@query(o.with_tables(f"SELECT row_number, {o.date_format('fecha_registro')} AS format, {o.date_ambiguous('fecha_registro')} AS ambiguous, {o.date_parsed('fecha_registro')} AS parsed, {o.trusted('fecha_registro')} AS trusted FROM raw_leads", o.RAW))
def f11_f12_dates(spark, d):
    x = bridge.read(spark, d, "raw_leads").select("row_number", f.classify_date(F.col("fecha_registro")).alias("i"))
    return x.select("row_number", "i.format", "i.ambiguous", F.col("i.parsed").cast("timestamp_ntz").alias("parsed"), f.trusted_date(F.col("i")).cast("timestamp_ntz").alias("trusted"))


@query(o.with_tables(f"""SELECT CASE WHEN {o.date_format('fecha_primer_contacto')} = 'vacio' THEN 'empty value' WHEN {o.date_parsed('fecha_primer_contacto')} IS NULL THEN 'unrecognized or impossible date'
 WHEN {o.date_format('fecha_primer_contacto')} = '{f.SLASH}' THEN 'slash date ambiguous between DD/MM and MM/DD' WHEN {o.date_ambiguous('fecha_primer_contacto')} THEN 'dash date with day and month <= 12, parsed as DD-MM by documented convention' ELSE 'unambiguous' END AS reason, count(*) AS n FROM raw_leads GROUP BY 1""", o.RAW))
def f13_date_reason(spark, d):
    x = bridge.read(spark, d, "raw_leads").select(f.classify_date(F.col("fecha_primer_contacto")).alias("i"))
    return x.groupBy(f.date_reason(F.col("i")).alias("reason")).agg(F.count("*").alias("n"))


@query(o.with_tables(f"SELECT row_number, {o.model('modelo_interes_texto')} AS key FROM raw_leads", o.RAW))
def f14_model_text(spark, d):
    return bridge.read(spark, d, "raw_leads").select("row_number", f.normalize_model_text(F.col("modelo_interes_texto")).alias("key"))


@query(f"SELECT conv_id, turn, {o.cases(o.key('role'), f.SENDERS, 'trim(role)')} AS sender FROM conversations")
def f15_sender(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", f.normalize_sender(F.col("role")).alias("sender"))


PRICES = "(SELECT o_orderkey AS k, CASE cast(o_orderkey % 6 AS int) WHEN 0 THEN concat('tengo ', cast(floor(o_totalprice / 1000) AS bigint), ',', cast(o_orderkey % 10 AS int), ' millones') WHEN 1 THEN concat('son $', cast(floor(o_totalprice) AS bigint), ' pesos') WHEN 2 THEN concat('unos ', cast(floor(o_totalprice / 1000) AS bigint), ' mil') WHEN 3 THEN concat('1.', lpad(concat('', cast(floor(o_totalprice) AS bigint) % 1000), 3, '0'), '.000 de cuota') WHEN 4 THEN concat('pago ', cast(floor(o_totalprice) AS bigint)) ELSE 'nada' END AS said, floor(o_totalprice) AS price FROM orders)"
NUMBER = "try_cast(trim(CASE WHEN contains({0}, ',') THEN replace(replace({0}, '.', ''), ',', '.') WHEN regexp_matches({0}, '^[^.]*([.][^.]{{3}})+$') THEN replace({0}, '.', '') ELSE {0} END) AS DOUBLE)".format("x")
AMOUNTS_SQL = "list_concat(" + ", ".join(f"list_filter(list_transform(regexp_extract_all(said, '{p}', 1), lambda x: {NUMBER} * {m}), lambda v: v IS NOT NULL)" for p, m in (("([0-9]+(?:[.,][0-9]+)?)\\s*(?:millones|millon|palos|palo)", 1e6), ("([0-9]+(?:[.,][0-9]+)?)\\s*(?:mil|k)\\b", 1e3), ("\\$\\s*([0-9.,]+)", 1.0), ("\\b([0-9]{1,3}(?:[.,][0-9]{3})+)\\b", 1.0))) + ", list_transform(regexp_extract_all(said, '\\b([0-9]{5,})\\b', 1), lambda x: cast(x AS DOUBLE)))"


def _said(spark, d):
    return spark.sql(PRICES[1:-1].replace("FROM orders", "FROM {orders}"), orders=read(spark, d, "orders"))


@query(f"SELECT k, coalesce(list_sum({AMOUNTS_SQL}), 0) AS total, len({AMOUNTS_SQL}) AS n FROM {PRICES}")
def f17_f18_amounts(spark, d):
    a = g.amounts_in_text(F.col("said"))
    return _said(spark, d).select("k", F.aggregate(a, F.lit(0.0), lambda x, v: x + v).alias("total"), F.size(a).alias("n"))


@query(f"SELECT k, len(list_filter({AMOUNTS_SQL}, lambda a: abs(a - price) <= greatest(1.0, abs(price) * 1e-6))) > 0 AS proven FROM {PRICES}")
def f19_amount_matches(spark, d):
    return _said(spark, d).select("k", g.amount_matches_evidence(F.col("price").cast("double"), F.col("said")).alias("proven"))


@query(f"SELECT conv_id, turn, {o.match_key('text')} AS key, {o.match_key('text')} IN ({', '.join(map(o.quoted, g.COURTESY))}) AS courtesy FROM conversations")
def f20_f22_match_text(spark, d):
    c = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", t.normalize_for_match(c).alias("key"), g.is_non_informative(c).alias("courtesy"))


@query(o.with_tables("SELECT conv_id, string_agg(trim(sender) || ': ' || trim(text, ' \t\n\r'), '\n' ORDER BY turn) AS transcript FROM chat_turns WHERE trim(text, ' \t\n\r') <> '' GROUP BY conv_id", o.CHATS))
def f29_transcript(spark, d):
    from leadspark.operators import signals

    talks = signals.conversations(bridge.read(spark, d, "chat_turns"), bridge.read(spark, d, "chats"))
    return talks.select("conv_id", g.build_transcript(F.col("messages")).alias("transcript"))


LOG = "(SELECT event_id, CASE cast(event_id % 11 AS int) WHEN 0 THEN 'HTTP 429: rate limit reached, try again in 5s' WHEN 1 THEN 'HTTP 401 unauthorized' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'HTTP 503 unavailable' WHEN 4 THEN 'HTTP 400 bad request' WHEN 5 THEN 'no choices in answer' WHEN 6 THEN 'schema mismatch' WHEN 7 THEN 'evidence missing' WHEN 8 THEN 'connection refused' WHEN 9 THEN 'quota exceeded' ELSE concat('odd ', event_type) END AS message FROM events)"


def _any(marks):
    return "(" + " OR ".join(f"contains(lower(message), '{m}')" for m in marks) + ")"


@query(f"SELECT event_id, CASE WHEN message = '' THEN '{g.UNKNOWN_ERROR}' " + " ".join(f"WHEN {_any(m)} THEN '{n}'" for n, m in g.ERRORS) + f" ELSE '{g.UNKNOWN_ERROR}' END AS category, try_cast(nullif(regexp_extract(message, 'HTTP\\s+([0-9]{{3}})', 1), '') AS int) AS http, {_any(('429', 'rate limit', 'rate_limit'))} AS limited, {_any(g.QUOTA_MARKS)} AS quota FROM {LOG}")
def f32_f33_errors(spark, d):
    log = spark.sql(LOG[1:-1].replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    m = F.col("message")
    return log.select("event_id", g.classify_error(m).alias("category"), g.http_status(m).alias("http"), g.is_rate_limit(m).alias("limited"), g.is_quota_exhausted(m).alias("quota"))


@query(f"WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents), y AS (SELECT doc_id, unnest(range(0, 3)) AS i, unnest(['the', 'der', 'que']) AS cue, s FROM x), z AS (SELECT doc_id, i, cue, length(s) - instr(reverse(s), reverse(cue)) - length(cue) + 1 AS place FROM y WHERE contains(s, cue)) SELECT doc_id, arg_max(cue, place * 10 - i) AS cue, max(place) AS place FROM z GROUP BY doc_id")
def f39_last_cue(spark, d):
    x = read(spark, d, "documents").select("doc_id", g.last_cue(F.lower(F.coalesce("text", F.lit(""))), ["the", "der", "que"]).alias("c"))
    return x.where("c is not null").select("doc_id", "c.cue", F.col("c.place").cast("long").alias("place"))


# sources, organisation and models

@query(o.with_tables("SELECT point_of_sale_id, arg_max(CASE WHEN row_number % 40 = 7 THEN 'EMP-00' ELSE company_id END, row_number) AS company_id FROM (SELECT *, cast(right(advisor_id, 5) AS bigint) AS row_number FROM advisors) GROUP BY 1", o.ORG, o.ADVISORS))
def a06_org_dimension(spark, d):
    """The last row of a branch in the roster decides its company; some rows name another one."""
    rows = bridge.read(spark, d, "advisors").withColumn("row_number", F.substring("advisor_id", 4, 9).cast("long"))
    return files.org_dimension(rows.withColumn("company_id", F.when(F.col("row_number") % 40 == 7, "EMP-00").otherwise(F.col("company_id"))))


@query(o.with_tables("SELECT advisor_id, name, company_id, point_of_sale_id, CASE WHEN k % 13 <> 0 THEN daily_capacity END AS daily_capacity, active, CASE WHEN k % 11 <> 0 THEN DATE '2024-01-01' + cast(k % 300 AS int) END AS start_date FROM (SELECT *, cast(right(advisor_id, 5) AS bigint) AS k FROM advisors)", o.ORG, o.ADVISORS))
def a05_advisors(spark, d):
    """The roster as a file has it, text with stray spaces and odd values, and typed again by the operator."""
    k = F.substring("advisor_id", 4, 9).cast("int")
    rows = bridge.read(spark, d, "advisors").select(
        F.concat(F.lit(" "), "advisor_id").alias("asesor_id"), F.concat("name", F.lit("  ")).alias("nombre"), F.col("point_of_sale_id").alias("punto_venta_id"), F.concat(F.lit("  "), "company_id", F.lit(" ")).alias("empresa_id"),
        F.when(k % 13 == 0, "muchos").otherwise(F.concat(F.col("daily_capacity").cast("string"), F.lit(" "))).alias("capacidad_diaria_leads"), F.when(F.col("active"), F.when(k % 2 == 0, "si ").otherwise("SI")).otherwise("No").alias("activo"),
        F.when(k % 11 == 0, "ayer").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k % 300), "yyyy-MM-dd")).alias("fecha_ingreso"))
    return files.load_advisors(rows)


@query(o.with_tables("SELECT row_number, CASE WHEN o.point_of_sale_id IS NULL THEN 'unknown_point_of_sale' WHEN o.company_id <> r.empresa_id THEN 'foreign_company' END AS org_error FROM raw_leads r LEFT JOIN org o ON o.point_of_sale_id = r.punto_venta_id", o.RAW, o.ORG))
def j01_validate_org(spark, d):
    return ingest.check_organization(bridge.read(spark, d, "raw_leads"), bridge.read(spark, d, "org")).select("row_number", "org_error")


@query(o.with_tables("SELECT key, false AS brand, array_to_string(skus, '|') AS skus FROM keys UNION ALL SELECT key, true, array_to_string(skus, '|') FROM brands", o.CATALOG, o.MATCH))
def j05_catalog_index(spark, d):
    return models.catalog_index(bridge.read(spark, d, "catalog")).select("key", "brand", F.array_join("skus", "|").alias("skus"))


@query(o.with_leads("SELECT lead_id, sku, match_state, match_type, candidates FROM leads", fuzzy=False))
def j06_match_model(spark, d):
    """The cascade without its similarity step."""
    return leads(spark, d, fuzzy=False, candidates=True).select("lead_id", "sku", "match_state", "match_type", "candidates")


@query(o.with_leads("SELECT lead_id, sku, match_state, match_type, match_score, candidates FROM leads"))
def j06_match_model_fuzzy(spark, d):
    return leads(spark, d, candidates=True).select("lead_id", "sku", "match_state", "match_type", "match_score", "candidates")


@query(o.with_tables("SELECT lead_id, row_number, n_rows, punto_venta_id FROM first_rows", o.RAW, o.FIRST))
def x01_first_occurrence(spark, d):
    return ingest.first_occurrence(bridge.read(spark, d, "raw_leads")).select("lead_id", "row_number", "n_rows", "punto_venta_id")


LEAD_COLUMNS = ("lead_id", "row_number", "company_id", "point_of_sale_id", "channel", "status", "customer_name", "phone_normalized", "email_normalized", "city_raw", "city_normalized", "model_text_raw", "sku", "match_state", "match_type", "registration_at", "first_contact_at", "campaign")


@query(o.with_leads(f"SELECT {', '.join(LEAD_COLUMNS)}, anomalies FROM leads"))
def k01_w01_normalize_leads(spark, d):
    n = leads(spark, d)
    return n.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else F.col(c) for c in LEAD_COLUMNS), F.array_join("anomalies", ",").alias("anomalies"))


@query(o.with_leads(f"""SELECT (SELECT count(*) FROM raw_leads) AS read, (SELECT count(*) - count(DISTINCT lead_id) FROM raw_leads) AS duplicates, (SELECT count(DISTINCT lead_id) FROM raw_leads) - count(*) AS invalid_references, count(*) AS persisted,
 count_if(n_rows > 1) AS duplicated_ids, count_if(reg_format = '{f.SLASH}') AS ambiguous_registration, count_if(cont_format = '{f.SLASH}') AS ambiguous_first_contact, count_if(reg_format = '{f.DASH}' AND reg_ambiguous) AS ambiguous_by_convention,
 count_if(contains(anomalies, 'first_contact_before')) AS chronology, count_if(contains(anomalies, 'managed_without')) AS managed_without_first_contact, count_if(phone_normalized IS NULL) AS invalid_phones, count(city_normalized) AS cities_normalized,
 count_if(contains(anomalies, 'unmatched_city')) AS cities_unmatched, count_if(match_state = 'matched') AS models_matched, count_if(match_state = 'ambiguous') AS models_ambiguous, count_if(match_state = 'unmatched') AS models_unmatched, count_if(match_state = 'empty') AS models_empty FROM leads"""))
def q14_ingestion_counters(spark, d):
    return ingest.ingestion_counters(bridge.read(spark, d, "raw_leads"), leads(spark, d))


@query(o.with_leads("SELECT c.conv_id, c.lead_id, l.company_id, CASE WHEN l.lead_id IS NULL THEN 'orphan' ELSE 'linked' END AS status FROM chats c LEFT JOIN leads l USING (lead_id)", o.CHATS))
def j03_link_conversations(spark, d):
    return ingest.link_conversations(bridge.read(spark, d, "chats"), leads(spark, d)).select("conv_id", "lead_id", "company_id", "status")




@query("WITH " + o.RAW + ", raw_once_rows AS (SELECT * FROM raw_leads WHERE row_number < 1000000000), s AS (SELECT lead_id, estado_gestion FROM raw_once_rows WHERE row_number % 100 <> 2), n AS (SELECT lead_id, CASE WHEN row_number % 10 = 0 THEN 'Cambiado' ELSE estado_gestion END AS estado_gestion FROM raw_once_rows WHERE row_number % 50 <> 1) "
       "SELECT coalesce(n.lead_id, s.lead_id) AS lead_id, coalesce(n.estado_gestion, s.estado_gestion) AS estado_gestion, CASE WHEN s.lead_id IS NULL THEN 2 ELSE 1 END AS first_seen_run, CASE WHEN n.lead_id IS NULL THEN 1 ELSE 2 END AS last_seen_run, "
       "CASE WHEN s.lead_id IS NULL THEN 'inserted' WHEN n.lead_id IS NULL THEN 'absent' WHEN s.estado_gestion = n.estado_gestion THEN 'unchanged' ELSE 'updated' END AS change FROM s FULL JOIN n ON s.lead_id = n.lead_id")
def u01_upsert_diff(spark, d):
    raw = bridge.read(spark, d, "raw_leads").where("row_number < 1000000000")
    hashed = lambda x: x.withColumn("content_hash", ingest.content_hash("estado_gestion"))
    stored = hashed(raw.where("row_number % 100 <> 2").select("lead_id", "estado_gestion")).withColumns({"first_seen_run": F.lit(1), "last_seen_run": F.lit(1)})
    new = hashed(raw.where("row_number % 50 <> 1").select("lead_id", F.expr("case when row_number % 10 = 0 then 'Cambiado' else estado_gestion end").alias("estado_gestion")))
    return ingest.upsert_diff(stored, new, 2).drop("content_hash")


# scores and assignment

def _score_sql(p: dict = PARAMS, chats: bool = False) -> str:
    """ref, sig, pts, urg and scored; with chats from the consolidated signals `con` too."""
    case = lambda k, table, default: f"CASE {k} " + " ".join(f"WHEN {o.quoted(a)} THEN {float(b)}::DOUBLE" for a, b in table.items()) + f" ELSE {float(default)}::DOUBLE END"
    q = p["quality_points"]
    names = ("intencion_compra", "solicitud_cita", "solicitud_cotizacion", "presupuesto", "cuota_inicial", "forma_pago", "objecion")
    said = ", ".join(f"n.{x}" for x in names) if chats else ", ".join(f"NULL::{'BOOLEAN' if x.startswith('solicitud') else 'DOUBLE' if x in g.AMOUNTS else 'VARCHAR'} AS {x}" for x in names)
    rules = [("true", f"{float(p['base_gestionable'])}::DOUBLE", "'BASE_GESTIONABLE'"), (f"intencion_compra IN ({', '.join(map(o.quoted, p['intencion_points']))})", case("intencion_compra", p["intencion_points"], 0), "'INTENCION_' || upper(intencion_compra)"),
             ("cita", f"{p['cita_points']}::DOUBLE", "'CLIENTE_PIDIO_CITA'"), ("coalesce(solicitud_cotizacion, false)", f"{p['cotizacion_points']}::DOUBLE", "'CLIENTE_PIDIO_COTIZACION'"), ("presupuesto >= list_price", f"{p['presupuesto_compatible_points']}::DOUBLE", "'PRESUPUESTO_COMPATIBLE'"),
             ("presupuesto < list_price", f"({p['presupuesto_insuficiente_points']})::DOUBLE", "'PRESUPUESTO_INSUFICIENTE'"), (f"list_price > 0 AND cuota_inicial >= list_price * {p['cuota_suficiente_ratio']}::DOUBLE", f"{p['cuota_suficiente_points']}::DOUBLE", "'CUOTA_SUFICIENTE'"),
             ("forma_pago IS NOT NULL", f"{p['forma_pago_points']}::DOUBLE", "'FORMA_PAGO_DECLARADA'"), ("objecion IS NOT NULL", case("objecion", p["objecion_points"], -5), "'OBJECION_' || upper(objecion)"),
             ("list_price IS NOT NULL", o.half_up(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (list_price - {p['catalog_min_price']}::DOUBLE) / {p['catalog_max_price'] - p['catalog_min_price']}::DOUBLE)) * {float(p['ticket_max_points'])}::DOUBLE * {p['ticket_weight']}::DOUBLE"), "'TICKET_REGLA_NEGOCIO'")]
    points = " + ".join(f"CASE WHEN {when} THEN {what} ELSE 0 END" for when, what, _ in rules)
    codes = ", ".join(f"CASE WHEN {when} THEN {code} END" for when, _, code in rules)
    return f"""
 ref AS (SELECT max(registration_at) AS reference_at FROM leads),
 sig AS (SELECT l.*, c.list_price::DOUBLE AS list_price, floor((epoch_us(reference_at) - epoch_us(registration_at)) / 86400000000)::BIGINT AS days, {said}, coalesce({'n.solicitud_cita' if chats else 'false'}, false) AS cita FROM leads l LEFT JOIN catalog c USING (sku) {'LEFT JOIN con n USING (lead_id)' if chats else ''}, ref),
 pts AS (SELECT *, {o.clamp(points)} AS commercial, array_to_string(list_filter([{codes}], lambda x: x IS NOT NULL), ',') AS codes,
   {o.clamp(f"(CASE WHEN phone_normalized IS NOT NULL THEN {q['phone']} ELSE 0 END + CASE WHEN sku IS NOT NULL THEN {q['model']} ELSE 0 END + CASE WHEN email_normalized IS NOT NULL THEN {q['email']} ELSE 0 END + CASE WHEN city_raw IS NOT NULL THEN {q['city']} ELSE 0 END + CASE WHEN registration_at IS NOT NULL THEN {q['registration_date']} ELSE 0 END)::DOUBLE")} AS quality,
   {case('status', p['estado_base'], p['estado_desconocido_base'])} + CASE WHEN NOT cita AND registration_at IS NOT NULL AND first_contact_at IS NULL THEN CASE WHEN days >= 2 THEN {float(p['antiguedad_points']['mas_48h'])}::DOUBLE WHEN days = 1 THEN {float(p['antiguedad_points']['24_48h'])}::DOUBLE ELSE 0 END ELSE 0 END AS u FROM sig),
 urg AS (SELECT *, {o.clamp(f"CASE WHEN cita THEN {float(p['cita_urgency_override'])}::DOUBLE WHEN registration_at IS NOT NULL AND status = 'Sin gestión' AND days >= 2 AND u < {p['sin_gestion_mas_48h_min']} THEN {float(p['sin_gestion_mas_48h_min'])}::DOUBLE ELSE u END")} AS urgency FROM pts),
 scored AS (SELECT *, {o.half_up(f"commercial * {p['queue_commercial_weight']}::DOUBLE + urgency * {p['queue_urgency_weight']}::DOUBLE")} AS queue, CASE WHEN commercial >= {p['band_alta_desde']} THEN 'Alta' WHEN commercial >= {p['band_media_desde']} THEN 'Media' ELSE 'Baja' END AS band,
   CASE WHEN urgency >= {p['urgency_hoy_desde']} THEN 'Hoy' WHEN urgency >= {p['urgency_24h_desde']} THEN '24 h' ELSE 'Semana' END AS urgency_band FROM urg)"""


SCORED = _score_sql()


@query(o.with_leads("SELECT lead_id, commercial, quality, urgency, queue, band, urgency_band FROM scored", SCORED))
def k03_score_leads(spark, d):
    return scores(spark, d).select("lead_id", "commercial", "quality", "urgency", "queue", "band", "urgency_band")


@query(o.with_leads("SELECT max(registration_at) AS reference_at FROM leads"))
def g02_reference_date(spark, d):
    return scoring.reference_date(leads(spark, d)).select(F.col("reference_at").cast("timestamp_ntz").alias("reference_at"))


@query(o.with_leads(f"SELECT band, urgency_band, count(*) AS n, min(commercial) AS commercial_min, max(commercial) AS commercial_max, {o.half_up('avg(commercial)')} AS commercial_mean, min(queue) AS queue_min, max(queue) AS queue_max, {o.half_up('avg(queue)')} AS queue_mean FROM scored GROUP BY 1, 2", SCORED))
def g08_score_distribution(spark, d):
    return scoring.score_distribution(scores(spark, d))


def _assign_sql(secondary: str | None = None, again: bool = False) -> str:
    """cand, ranked and decided; without leads of the relation `secondary`. again: a second run over `kept` and `load`, its relations end with 2."""
    n = "2" if again else ""
    outside = f" AND lead_id NOT IN (SELECT lead_id FROM {secondary})" if secondary else ""
    remaining = "greatest(0, daily_capacity - coalesce(load, 0))" if again else "daily_capacity"
    return f"""
 cand{n} AS (SELECT lead_id, company_id, point_of_sale_id, queue FROM scored WHERE (status IS NULL OR status NOT IN ({', '.join(map(o.quoted, f.TERMINAL))})){outside}),
 ranked{n} AS (SELECT *, row_number() OVER (PARTITION BY company_id, point_of_sale_id ORDER BY queue DESC NULLS LAST, lead_id) AS priority_rank FROM cand{n}),
 pool{n} AS (SELECT company_id, point_of_sale_id, advisor_id, {remaining} AS remaining FROM advisors {'LEFT JOIN load USING (advisor_id)' if again else ''} WHERE active AND daily_capacity > 0),
 stays{n} AS (SELECT r.lead_id, {'k.advisor_id' if again else 'NULL::VARCHAR AS advisor_id'} FROM ranked{n} r {f'JOIN kept k USING (lead_id) JOIN pool{n} p ON p.advisor_id = k.advisor_id AND p.company_id = r.company_id AND p.point_of_sale_id = r.point_of_sale_id' if again else 'WHERE false'}),
 slots{n} AS (SELECT *, row_number() OVER (PARTITION BY company_id, point_of_sale_id ORDER BY r DESC, advisor_id) AS slot FROM (SELECT company_id, point_of_sale_id, advisor_id, unnest(range(1, remaining + 1)) AS r FROM pool{n})),
 free{n} AS (SELECT lead_id, company_id, point_of_sale_id, row_number() OVER (PARTITION BY company_id, point_of_sale_id ORDER BY priority_rank) AS slot FROM ranked{n} WHERE lead_id NOT IN (SELECT lead_id FROM stays{n})),
 decided{n} AS (SELECT r.lead_id, r.company_id, r.point_of_sale_id, queue, priority_rank, coalesce(t.advisor_id, s.advisor_id) AS advisor_id, CASE WHEN coalesce(t.advisor_id, s.advisor_id) IS NULL THEN 'overflow' ELSE 'assigned' END AS status,
   CASE WHEN t.advisor_id IS NOT NULL THEN 'kept' WHEN s.advisor_id IS NULL THEN 'full' ELSE 'rank' END AS way FROM ranked{n} r LEFT JOIN stays{n} t USING (lead_id) LEFT JOIN free{n} e USING (lead_id) LEFT JOIN slots{n} s ON s.company_id = e.company_id AND s.point_of_sale_id = e.point_of_sale_id AND s.slot = e.slot)"""


ASSIGNED = _assign_sql()
DECIDED = (o.ADVISORS, SCORED, ASSIGNED)


@query(o.with_leads("SELECT * EXCLUDE (way) FROM decided", *DECIDED))
def k04_assign_leads(spark, d):
    return decisions(spark, d).drop("reason")


@query(o.with_leads("SELECT lead_id, company_id, point_of_sale_id, priority_rank FROM ranked", SCORED, ASSIGNED.split(" pool AS")[0].rstrip(", \n")))
def x03_priority_rank(spark, d):
    n = kept_leads(spark, d)
    return ingest.priority_rank(assign.eligible_candidates(n, scoring.score_leads(scoring.lead_signals(n, bridge.read(spark, d, "catalog")), PARAMS))).drop("queue")


@query(o.with_leads("SELECT company_id, point_of_sale_id, count(*) AS candidates, count_if(status = 'assigned') AS assigned, count_if(status = 'overflow') AS overflow, count(DISTINCT advisor_id) AS advisors FROM decided GROUP BY 1, 2", *DECIDED))
def g05_assignment_summary(spark, d):
    return assign.assignment_summary(decisions(spark, d))


@query(o.with_leads("SELECT lead_id, CASE right(lead_id, 1) WHEN '1' THEN 'unknown_point_of_sale' WHEN '2' THEN 'foreign_company' ELSE 'foreign_advisor' END AS violation FROM decided WHERE right(lead_id, 1) IN ('1', '2') OR (right(lead_id, 1) = '3' AND advisor_id IS NOT NULL)", *DECIDED))
def j02_check_decisions(spark, d):
    """Decisions of which three in ten are spoilt: the violations, and nothing of the others."""
    end = F.right("lead_id", F.lit(1))
    spoilt = decisions(spark, d).withColumns({"point_of_sale_id": F.when(end == "1", "PV-999").otherwise(F.col("point_of_sale_id")), "company_id": F.when(end == "2", "EMP-99").otherwise(F.col("company_id")), "advisor_id": F.when((end == "3") & F.col("advisor_id").isNotNull(), "AS-none").otherwise(F.col("advisor_id"))})
    return assign.check_decisions(spoilt, bridge.read(spark, d, "org"), bridge.read(spark, d, "advisors")).select("lead_id", "violation")


@query(o.with_leads("SELECT advisor_id, priority_rank, d.lead_id, customer_name, band, urgency_band, d.queue FROM decided d JOIN scored USING (lead_id) WHERE d.status = 'assigned'", *DECIDED))
def l01_work_queue(spark, d):
    """Today's list of every advisor by rank: which leads, and why first."""
    n = kept_leads(spark, d)
    s = kept_scores(spark, d, n)
    out = decisions(spark, d, n, s).where("status = 'assigned'")
    return out.join(s.select("lead_id", "band", "urgency_band"), "lead_id").join(n.select("lead_id", "customer_name"), "lead_id").select("advisor_id", "priority_rank", "lead_id", "customer_name", "band", "urgency_band", "queue")


# identity

JW = "(x.name = y.name OR jaro_winkler_similarity(x.name, y.name) >= 0.9)"
PAIRS = f"""
 idk AS (SELECT lead_id, company_id, {o.key('customer_name')} AS name, phone_normalized AS phone, email_normalized AS email, city_normalized AS city FROM leads),
 pairs AS (SELECT x.lead_id AS a, y.lead_id AS b, CASE WHEN x.email = y.email THEN '{identity.STRONG}' WHEN {JW} THEN '{identity.POSSIBLE}' END AS rule FROM idk x JOIN idk y ON x.company_id = y.company_id AND x.phone = y.phone AND x.lead_id < y.lead_id)"""
WEAK_PAIRS = f"""
 weak_pairs AS (SELECT x.lead_id AS a, y.lead_id AS b, '{identity.WEAK}' AS rule FROM idk x JOIN idk y ON x.company_id = y.company_id AND x.name = y.name AND x.city = y.city AND x.lead_id < y.lead_id AND x.name <> ''
   WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = x.lead_id AND p.b = y.lead_id AND p.rule IS NOT NULL))"""
EDGES = f"""
 edges AS (SELECT a, b, rule FROM pairs WHERE rule IS NOT NULL UNION ALL SELECT a, b, rule FROM weak_pairs),
 sides AS (SELECT a, b, rule FROM edges UNION ALL SELECT b, a, rule FROM edges)"""
ORDER = f"CASE rule WHEN '{identity.STRONG}' THEN 0 WHEN '{identity.POSSIBLE}' THEN 1 ELSE 2 END"


@query(o.with_leads(f"""SELECT 'lead' AS kind, k.lead_id, CASE WHEN k.called THEN min(k.lead_id) OVER (PARTITION BY company_id, phone) END AS phone_class, CASE WHEN k.called AND email IS NOT NULL THEN min(k.lead_id) OVER (PARTITION BY company_id, phone, email) END AS mail_class,
  CASE WHEN k.called THEN min(k.lead_id) OVER (PARTITION BY company_id, phone, name) END AS name_class, NULL::VARCHAR AS other_class, coalesce(strong, 0) AS strong, coalesce(possible, 0) AS possible, coalesce(discarded, 0) AS discarded, NULL::DOUBLE AS name_similarity
  FROM (SELECT *, phone IS NOT NULL AND company_id IS NOT NULL AS called FROM idk) k LEFT JOIN linked USING (lead_id)
 UNION ALL SELECT 'pair', NULL, NULL, NULL, x.m, y.m, coalesce(strong, 0), coalesce(possible, 0), 0, floor(10000 * jaro_winkler_similarity(x.name, y.name) + 0.5) / 10000
  FROM idn x JOIN idn y ON x.company_id = y.company_id AND x.phone = y.phone AND x.name < y.name AND jaro_winkler_similarity(x.name, y.name) >= 0.9 LEFT JOIN named n ON n.company_id = x.company_id AND n.phone = x.phone AND n.x = x.name AND n.y = y.name""",
    PAIRS, "idn AS (SELECT company_id, phone, name, min(lead_id) AS m, count(*) AS n FROM idk WHERE phone IS NOT NULL GROUP BY ALL)",
    f"linked AS (SELECT lead_id, count_if(rule = '{identity.STRONG}') AS strong, count_if(rule = '{identity.POSSIBLE}') AS possible, count_if(rule IS NULL) AS discarded FROM (SELECT a AS lead_id, rule FROM pairs UNION ALL SELECT b, rule FROM pairs) GROUP BY ALL)",
    f"named AS (SELECT p.company_id, p.phone, least(p.name, q.name) AS x, greatest(p.name, q.name) AS y, count_if(rule = '{identity.STRONG}') AS strong, count_if(rule = '{identity.POSSIBLE}') AS possible FROM pairs JOIN idk p ON p.lead_id = a JOIN idk q ON q.lead_id = b GROUP BY ALL)"))
def j07_f37_phone_pairs(spark, d):
    """All pairs of leads of one phone by rule, the discarded ones too: each lead with its classes and pairs, and pairs of similar names."""
    return identity.Evidence(leads(spark, d)).phone_links()


@query(o.with_leads(f"""SELECT lead_id, CASE WHEN placed THEN min(lead_id) OVER (PARTITION BY company_id, name, city) END AS place_class, CASE WHEN placed AND phone IS NOT NULL THEN min(lead_id) OVER (PARTITION BY company_id, name, city, phone) END AS phone_class, CASE WHEN links > 0 THEN '{identity.WEAK}' END AS rule, coalesce(links, 0) AS links
 FROM (SELECT *, coalesce(name <> '' AND city IS NOT NULL AND company_id IS NOT NULL, false) AS placed FROM idk) LEFT JOIN (SELECT lead_id, count(*) AS links FROM (SELECT a AS lead_id FROM weak_pairs UNION ALL SELECT b FROM weak_pairs) GROUP BY ALL) USING (lead_id)""", PAIRS, WEAK_PAIRS))
def j08_name_city_pairs(spark, d):
    """All pairs of leads of one name and city without a common phone: each lead with its classes and links."""
    return identity.Evidence(leads(spark, d)).place_links()


@query(o.with_leads(f"SELECT a AS lead_id, arg_min(rule, concat({ORDER}, b)) AS rule, min(concat({ORDER}, b))[2:] AS related_lead_id FROM sides GROUP BY a", PAIRS, WEAK_PAIRS, EDGES))
def x04_best_rules(spark, d):
    return identity.best_rules(leads(spark, d)).select("lead_id", "rule", "related_lead_id")


CLUSTERS = f"""
 walk AS (SELECT a AS node, least(a, min(b)) AS c FROM sides GROUP BY a),
 w2 AS (SELECT s.a AS node, least(any_value(w.c), min(v.c)) AS c FROM sides s JOIN walk w ON w.node = s.a JOIN walk v ON v.node = s.b GROUP BY s.a),
 w3 AS (SELECT s.a AS node, least(any_value(w.c), min(v.c)) AS c FROM sides s JOIN w2 w ON w.node = s.a JOIN w2 v ON v.node = s.b GROUP BY s.a)"""
for _i in range(4, 15):
    CLUSTERS += f",\n w{_i} AS (SELECT s.a AS node, least(any_value(w.c), min(v.c)) AS c FROM sides s JOIN w{_i - 1} w ON w.node = s.a JOIN w{_i - 1} v ON v.node = s.b GROUP BY s.a)"
CLUSTERS = CLUSTERS.replace("AS (SELECT", "AS MATERIALIZED (SELECT") + f""",
 cl AS (SELECT c AS canonical_lead_id, count(DISTINCT node) AS size FROM w14 GROUP BY c),
 cr AS (SELECT w.c AS canonical_lead_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS matched_rules, min({ORDER}) AS lo, max({ORDER}) AS hi FROM edges e JOIN w14 w ON w.node = e.a GROUP BY w.c)"""


@query(o.with_leads("SELECT canonical_lead_id, size, ['strong', 'possible', 'weak'][lo + 1] AS strength, CASE WHEN hi = 0 THEN 'auto' ELSE 'possible_pending' END AS status, matched_rules FROM cl JOIN cr USING (canonical_lead_id)", PAIRS, WEAK_PAIRS, EDGES, CLUSTERS))
def k05_clusters(spark, d):
    """Fourteen unrolled rounds reach every component of these tables in SQL; the operator goes on until nothing changes."""
    return identity.resolve_identities(leads(spark, d))[0].drop("company_id")


@query(o.with_leads(f"SELECT w.c AS canonical_lead_id, w.node AS lead_id, CASE WHEN w.c = w.node THEN 'canonical' ELSE 'member' END AS role, r.rule, r.related AS related_lead_id FROM w14 w JOIN (SELECT a, arg_min(rule, concat({ORDER}, b)) AS rule, min(concat({ORDER}, b))[2:] AS related FROM sides GROUP BY a) r ON r.a = w.node", PAIRS, WEAK_PAIRS, EDGES, CLUSTERS))
def k05_members(spark, d):
    return identity.resolve_identities(leads(spark, d))[1].select("canonical_lead_id", "lead_id", "role", "rule", "related_lead_id")


@query(o.with_leads(f"""SELECT 'leads_evaluated' AS metric, count(*) AS value FROM leads UNION ALL SELECT coalesce('edges ' || rule, 'pairs discarded'), count(*) FROM pairs GROUP BY 1
 UNION ALL SELECT 'clusters of ' || size, count(*) FROM cl GROUP BY 1 UNION ALL SELECT 'status ' || CASE WHEN hi = 0 THEN 'auto' ELSE 'possible_pending' END, count(*) FROM cr GROUP BY 1""", PAIRS, WEAK_PAIRS, EDGES, CLUSTERS))
def g01_identity_report(spark, d):
    e = identity.Evidence(leads(spark, d))
    return identity.identity_report(e, identity.resolve_identities(e.leads, e)[0])


#: Stored clusters made of the resolution: those of near canonical leads of a company in one, a few leads in the next one, a fifth not there yet, other rules for some.
STORED_MEMBERS = f"""
 res AS (SELECT w.c AS canonical_lead_id, w.node AS lead_id, r.rule, x.company_id, CAST(substr(w.c, 4) AS BIGINT) AS cn, CAST(substr(w.node, 4) AS BIGINT) AS ln FROM w14 w JOIN (SELECT a, arg_min(rule, concat({ORDER}, b)) AS rule FROM sides GROUP BY a) r ON r.a = w.node JOIN idk x ON x.lead_id = w.node),
 new_clusters AS (SELECT canonical_lead_id, company_id, lo, hi, matched_rules FROM cl JOIN cr USING (canonical_lead_id) JOIN idk ON idk.lead_id = canonical_lead_id),
 st AS (SELECT (cn // 300) * 1000 + CAST(right(company_id, 2) AS BIGINT) * 10 + CASE WHEN ln % 97 = 0 THEN 1000 ELSE 0 END AS cluster_id, company_id, lead_id, CASE WHEN ln % 3 = 0 THEN 'canonical' ELSE 'member' END AS role, CASE WHEN ln % 7 = 0 THEN '{identity.WEAK}' ELSE rule END AS rule FROM res WHERE ln % 5 <> 0
   UNION ALL SELECT 7, 'EMP-01', 'LD-none', 'member', '{identity.STRONG}'),
 sh AS (SELECT canonical_lead_id, cluster_id, count(*) AS n FROM res JOIN st USING (company_id, lead_id) GROUP BY ALL),
 links AS (SELECT 'new:' || canonical_lead_id AS a, 'old:' || cluster_id AS b FROM sh),
 both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a AS node, a AS r FROM both_ways UNION SELECT reach.node, w.b FROM reach JOIN both_ways w ON w.a = reach.r),
 chain AS (SELECT node, min(r) AS c FROM reach GROUP BY node),
 weight AS (SELECT cluster_id, c, sum(n) AS n FROM sh JOIN chain ON node = 'old:' || cluster_id GROUP BY ALL),
 target AS (SELECT c, CAST(arg_min(cluster_id, (-n, cluster_id)) AS VARCHAR) AS target, count(*) - 1 AS absorbed FROM weight GROUP BY c),
 ends AS (SELECT n.*, coalesce(target, 'new:' || canonical_lead_id) AS cluster_id, target IS NOT NULL AS met, coalesce(absorbed, 0) AS absorbed FROM new_clusters n LEFT JOIN chain ON node = 'new:' || canonical_lead_id LEFT JOIN target USING (c))"""


def merged(spark, d):
    n = kept_leads(spark, d)
    clusters, members = identity.resolve_identities(n)
    members = materialize(members, "members")
    at = members.join(clusters.select("canonical_lead_id", "company_id"), "canonical_lead_id").withColumns({"cn": F.substring("canonical_lead_id", 4, 20).cast("long"), "ln": F.substring("lead_id", 4, 20).cast("long")}).where("ln % 5 <> 0")
    rows = at.select((F.floor(F.col("cn") / 300) * 1000 + F.right("company_id", F.lit(2)).cast("long") * 10 + F.when(F.col("ln") % 97 == 0, 1000).otherwise(0)).alias("cluster_id"), "company_id", "lead_id", F.when(F.col("ln") % 3 == 0, "canonical").otherwise("member").alias("role"),
                     F.when(F.col("ln") % 7 == 0, identity.WEAK).otherwise(F.col("rule")).alias("rule"))
    rows = rows.unionByName(spark.range(1).select(F.lit(7).cast("long").alias("cluster_id"), F.lit("EMP-01").alias("company_id"), F.lit("LD-none").alias("lead_id"), F.lit("member").alias("role"), F.lit(identity.STRONG).alias("rule")))
    rows = materialize(rows.withColumn("strength", F.when(F.col("rule") == identity.STRONG, "strong").when(F.col("rule") == identity.POSSIBLE, "possible").otherwise("weak")), "stored")
    stored = rows.groupBy("cluster_id").agg(F.min("company_id").alias("company_id"), F.min("lead_id").alias("canonical_lead_id"), F.lit("confirmed").alias("status"), F.lit("weak").alias("strength"), F.lit("").alias("matched_rules"))
    return identity.merge_clusters(stored, rows.drop("company_id"), clusters, members)


@query(o.with_leads(f"""SELECT cluster_id, min(canonical_lead_id) AS canonical_lead_id, CASE WHEN max(hi) = 0 THEN 'auto' ELSE 'possible_pending' END AS status, ['strong', 'possible', 'weak'][min(lo) + 1] AS strength, array_to_string(list_sort(list_distinct(flatten(list(string_split(matched_rules, ','))))), ',') AS matched_rules,
 CASE WHEN any_value(met) THEN 'reused' ELSE 'created' END AS change, any_value(absorbed) AS absorbed FROM ends GROUP BY cluster_id UNION ALL SELECT '7', 'LD-none', 'confirmed', 'weak', '', 'kept', 0""", PAIRS, WEAK_PAIRS, EDGES, CLUSTERS, STORED_MEMBERS))
def u07_merge_clusters(spark, d):
    """Clusters after a resolution is merged into stored ones, with chains of absorption."""
    return merged(spark, d)[0].drop("company_id")


@query(o.with_leads(f"""SELECT coalesce(o.cluster_id, n.cluster_id) AS cluster_id, coalesce(o.lead_id, n.lead_id) AS lead_id, CASE WHEN n.lead_id IS NULL THEN o.was.role ELSE n.role END AS role, coalesce(n.rule, o.was.rule) AS rule,
 CASE WHEN n.lead_id IS NULL THEN 'kept' WHEN o.lead_id IS NULL THEN 'created' WHEN n.role = o.was.role AND n.rule = o.was.rule THEN 'unchanged' ELSE 'updated' END AS change, coalesce(o.was.moved, false) AS moved
 FROM (SELECT coalesce(target, CAST(cluster_id AS VARCHAR)) AS cluster_id, lead_id, min({{'moved': coalesce(target <> CAST(cluster_id AS VARCHAR), false), 'i': cluster_id, 'role': role, 'rule': rule}}) AS was FROM st LEFT JOIN chain ON node = 'old:' || cluster_id LEFT JOIN target USING (c) GROUP BY 1, 2) o
 FULL JOIN (SELECT e.cluster_id, r.lead_id, r.rule, CASE WHEN r.lead_id = m.first THEN 'canonical' ELSE 'member' END AS role FROM res r JOIN ends e USING (canonical_lead_id) JOIN (SELECT cluster_id, min(canonical_lead_id) AS first FROM ends GROUP BY 1) m USING (cluster_id)) n ON n.cluster_id = o.cluster_id AND n.lead_id = o.lead_id""", PAIRS, WEAK_PAIRS, EDGES, CLUSTERS, STORED_MEMBERS))
def u07_merge_members(spark, d):
    return merged(spark, d)[1].drop("strength")


# signals

def talks(spark, d):
    return signals.conversations(bridge.read(spark, d, "chat_turns"), bridge.read(spark, d, "chats")).withColumn("conversation_id", F.concat(F.lit("CONV-"), F.lpad(F.col("conv_id").cast("string"), 6, "0")))


#: Extraction payloads, derived from the chats: right, wrong and broken ones by conversation.
LAST = "(SELECT conv_id, arg_max(text, turn) AS quote, arg_max(CASE WHEN sender = 'asesor' THEN text END, CASE WHEN sender = 'asesor' THEN turn END) AS advised FROM chat_turns GROUP BY conv_id)"


def payloads(spark, d):
    x = talks(spark, d).withColumns({"quote": F.element_at(F.transform("messages", lambda m: m["text"]), -1), "advised": F.element_at(g.other_texts(F.col("messages")), -1)})
    i = F.col("conv_id") % 6
    evidence = F.when(i == 0, F.col("quote")).when(i == 1, F.concat(F.lit("cliente: "), "quote")).when(i == 2, F.col("advised")).when(i == 3, "ok").when(i == 4, "texto que no esta en el chat")
    amount = F.when(F.col("conv_id") % 4 == 0, 2_500_000.0).when(F.col("conv_id") % 4 == 1, 480_000.0).when(F.col("conv_id") % 4 == 2, 18_000_000.0).otherwise(1.0)
    intent = F.when(F.col("conv_id") % 19 == 0, "enorme").when(F.col("conv_id") % 3 == 0, "Alto").when(F.col("conv_id") % 3 == 1, "media").otherwise("consulta")
    body = F.to_json(F.struct(amount.alias("cuota_inicial"), evidence.alias("cuota_inicial_evidence"), intent.alias("intencion_compra"), evidence.alias("intencion_compra_evidence"), F.when(F.col("conv_id") % 2 == 0, "si").otherwise("false").alias("solicitud_cita"), evidence.alias("solicitud_cita_evidence"), F.lit("efectivo").alias("forma_pago"), evidence.alias("forma_pago_evidence")))
    return x.withColumns({"raw_text": F.when(F.col("conv_id") % 23 == 0, F.concat(F.lit("{broken "), body)).otherwise(body), "error": F.lit(None).cast("string"), "extraction_id": F.col("conv_id"), "latency_ms": 100 + F.col("conv_id") % 900})


def validated(spark, d):
    """Validated extractions as a table: parsing and validation are large expressions, kept apart."""
    return materialize(signals.validate_extractions(parsed(spark, d)), "validated")


def parsed(spark, d):
    return materialize(signals.parse_outcomes(payloads(spark, d)), "parsed")


EVIDENCE = "CASE cast(conv_id % 6 AS int) WHEN 0 THEN quote WHEN 1 THEN quote WHEN 2 THEN advised WHEN 3 THEN 'ok' WHEN 4 THEN 'texto que no esta en el chat' END"
SAID = f"""
 said AS (SELECT conv_id, arg_max(text, turn) AS quote, arg_max(text, turn) FILTER (WHERE sender <> 'cliente' AND trim(text, ' \t\n\r') <> '') AS advised, list({o.match_key('text')}) FILTER (WHERE sender = 'cliente') AS client, list({o.match_key('text')}) FILTER (WHERE sender <> 'cliente') AS others FROM chat_turns GROUP BY conv_id),
 ev AS (SELECT *, nullif(trim({EVIDENCE}, ' \t\n\r'), '') AS evidence, conv_id % 23 <> 0 AND conv_id % 19 <> 0 AS good, CASE cast(conv_id % 4 AS int) WHEN 0 THEN 2500000.0 WHEN 1 THEN 480000.0 WHEN 2 THEN 18000000.0 ELSE 1.0 END AS amount FROM said),
 why AS (SELECT *, CASE WHEN NOT good THEN 'none' WHEN evidence IS NULL THEN 'missing_evidence' WHEN {o.match_key('evidence')} IN ({', '.join(map(o.quoted, g.COURTESY))}) THEN 'non_informative_evidence'
   WHEN {o.match_key('evidence')} = '' OR NOT list_bool_or(list_transform(client, lambda m: contains(m, {o.match_key('evidence')}))) THEN CASE WHEN {o.match_key('evidence')} <> '' AND list_bool_or(list_transform(others, lambda m: contains(m, {o.match_key('evidence')}))) THEN 'advisor_evidence' ELSE 'evidence_not_in_conversation' END END AS reason FROM ev),
 paid AS (SELECT *, CASE WHEN reason IS NULL AND len(list_filter({AMOUNTS_SQL.replace('said', "lower(strip_accents(evidence))")}, lambda a: abs(a - amount) <= greatest(1.0, amount * 1e-6))) = 0 THEN 'amount_not_in_evidence' ELSE reason END AS amount_reason FROM why)"""


@query(o.with_tables("SELECT conv_id, CASE WHEN amount_reason IS NULL THEN amount END AS cuota_inicial, CASE WHEN good AND amount_reason IS NOT NULL THEN amount_reason END AS amount_reason, CASE WHEN good AND reason IS NOT NULL THEN reason END AS word_reason FROM paid", o.CHATS, SAID))
def k02_validate_extractions(spark, d):
    v = validated(spark, d)
    reason = lambda n: F.nullif(F.regexp_extract("invalidated", rf"(?:^|,){n}:([a-z_]+)", 1), F.lit(""))
    return v.select("conv_id", "cuota_inicial", reason("cuota_inicial").alias("amount_reason"), reason("intencion_compra").alias("word_reason"))


@query(o.with_tables("SELECT conv_id, conv_id % 23 <> 0 AS success, conv_id % 23 <> 0 AND conv_id % 19 <> 0 AS schema_valid, CASE WHEN conv_id % 23 <> 0 AND conv_id % 19 <> 0 THEN CASE cast(conv_id % 3 AS int) WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'informativa' END END AS intent, CASE WHEN conv_id % 23 <> 0 AND conv_id % 19 <> 0 THEN 4 ELSE 0 END AS fields FROM chats", o.CHATS))
def f27_f28_parse_payload(spark, d):
    p = parsed(spark, d)
    return p.select("conv_id", "payload.success", F.coalesce("payload.schema_valid", F.lit(False)).alias("schema_valid"), F.col("payload.intencion_compra").alias("intent"), g.fields_extracted(F.col("payload")).alias("fields"))


@query(o.with_tables("""SELECT count(*) AS requests, cast(count_if(conv_id % 23 <> 0) AS double) / count(*) AS success_rate, cast(count_if(conv_id % 23 <> 0 AND conv_id % 19 <> 0) AS double) / count(*) AS schema_rate, avg(100 + conv_id % 900) FILTER (WHERE conv_id % 23 <> 0) AS mean_ms,
 median(100 + conv_id % 900) FILTER (WHERE conv_id % 23 <> 0) AS median_ms FROM chats""", o.CHATS))
def g10_benchmark_metrics(spark, d):
    return evaluate.benchmark_metrics(parsed(spark, d)).select("requests", "success_rate", "schema_rate", "mean_ms", "median_ms")


@query(o.with_tables("SELECT CASE WHEN conv_id % 23 = 0 THEN 'invalid JSON' WHEN conv_id % 19 = 0 THEN 'schema validation failed: 1 error(s)' END AS reason, count(*) AS n FROM chats GROUP BY 1", o.CHATS))
def g09_batch_reasons(spark, d):
    return signals.batch_reasons(parsed(spark, d))


@query(o.with_tables("""SELECT count(*) AS candidates, count_if(NOT lost) AS processed, count_if(NOT lost AND (again OR NOT bad)) AS success, count_if(NOT lost AND again) AS reused, count_if(NOT lost AND NOT again AND bad) AS errors, count_if(lost) AS failed
 FROM (SELECT conv_id % 29 = 0 AS lost, conv_id % 5 = 0 AS again, conv_id % 23 = 0 OR conv_id % 19 = 0 AS bad FROM chats)""", o.CHATS))
def g09_batch_report(spark, d):
    c = F.col("conv_id")
    return signals.batch_report(parsed(spark, d).withColumns({"status": F.when(c % 29 == 0, "failed").otherwise(F.col("status")), "reused": c % 5 == 0}))


@query(o.with_tables("""SELECT count(*) AS attempts, cast(count_if(conv_id % 23 <> 0) AS double) / count(*) AS ok_rate, min(100 + conv_id % 900) AS min_ms, max(100 + conv_id % 900) AS max_ms, quantile_disc(100 + conv_id % 900, 0.95) AS p95_ms FROM chats""", o.CHATS))
def g14_availability(spark, d):
    return evaluate.availability(payloads(spark, d).select("conv_id", (F.col("conv_id") % 23 != 0).alias("ok"), "latency_ms")).select("attempts", "ok_rate", "min_ms", "max_ms", "p95_ms")


CONSOLIDATED = """
 fx AS (SELECT c.lead_id, p.conv_id, CASE cast(p.conv_id % 3 AS int) WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS rank, p.amount_reason, p.reason, p.amount, p.good FROM paid p JOIN chats c USING (conv_id)),
 con AS (SELECT lead_id, CASE max(rank) FILTER (WHERE good AND reason IS NULL) WHEN 4 THEN 'alta' WHEN 3 THEN 'media' WHEN 1 THEN 'informativa' END AS intencion_compra, arg_max(amount, conv_id) FILTER (WHERE good AND amount_reason IS NULL) AS cuota_inicial,
   CASE WHEN max(CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END) FILTER (WHERE good AND reason IS NULL) = 1 THEN true WHEN count(*) FILTER (WHERE good AND reason IS NULL) > 0 THEN false END AS solicitud_cita FROM fx WHERE good GROUP BY lead_id)"""


@query(o.with_tables("SELECT lead_id, intencion_compra, cuota_inicial, solicitud_cita FROM con", o.CHATS, SAID, CONSOLIDATED))
def g03_consolidate(spark, d):
    return signals.consolidate(validated(spark, d).where("status = 'success'")).select("lead_id", "intencion_compra", "cuota_inicial", "solicitud_cita")


@query(o.with_tables("SELECT DISTINCT lead_id FROM chats WHERE conv_id % 23 <> 0 AND conv_id % 19 <> 0", o.CHATS))
def u10_affected_leads(spark, d):
    return signals.affected_leads(parsed(spark, d))


@query(o.with_tables("""SELECT concat('CONV-', lpad(concat('', conv_id), 6, '0')) AS conversation_id, CASE WHEN conv_id % 5 = 0 THEN 'b' ELSE 'a' END AS input_hash, CASE WHEN conv_id % 5 = 0 OR conv_id % 2 = 0 THEN 'success' ELSE CASE WHEN conv_id % 3 = 0 THEN 'success' ELSE 'error' END END AS status FROM chats
 UNION ALL SELECT concat('CONV-', lpad(concat('', conv_id), 6, '0')), 'a', CASE WHEN conv_id % 2 = 0 THEN 'success' ELSE 'error' END FROM chats WHERE conv_id % 5 = 0""", o.CHATS))
def u03_upsert_extractions(spark, d):
    c = talks(spark, d).select("conversation_id", "conv_id")
    stored = c.select("conversation_id", F.lit("a").alias("input_hash"), F.col("conv_id").alias("extraction_id"), F.expr("if(conv_id % 2 = 0, 'success', 'error')").alias("status"), F.lit("old").alias("fields"), F.expr("conv_id % 2 = 0").alias("is_current"))
    new = c.select("conversation_id", F.expr("if(conv_id % 5 = 0, 'b', 'a')").alias("input_hash"), (F.col("conv_id") + 1_000_000).alias("extraction_id"), F.expr("if(conv_id % 5 = 0 or conv_id % 3 = 0, 'success', 'error')").alias("status"), F.lit("new").alias("fields"))
    return signals.upsert_extractions(stored, new).select("conversation_id", "input_hash", "status")


#: Further turns in which customers name products: alone, inside of other letters, a second one, and what they say to it.
NAMED = """
 named AS (SELECT t.conv_id, k.i + 101 AS turn, 'cliente' AS sender, CASE k.i WHEN 0 THEN concat('Que tal la ', c.line, '?') WHEN 1 THEN concat('o la xx', c.line, 'yy no') ELSE 'listo, de acuerdo' END AS text
  FROM chats t JOIN (VALUES (0, 0), (0, 1), (0, 2)) k(odd, i) ON t.conv_id % 2 = k.odd JOIN catalog c ON c.sku = concat('SKU-', cast(t.conv_id * 7 + 1 + 3 * k.i AS int)) WHERE (k.i = 0 OR t.conv_id % 4 = 0) AND (k.i < 2 OR t.conv_id % 8 = 0)),
 said AS (SELECT conv_id, turn, sender, text FROM chat_turns UNION ALL SELECT conv_id, turn, sender, text FROM named)"""
LABELLED = f"""
 mine AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {o.key('text')} AS text FROM said WHERE trim(sender) = 'cliente' AND trim(text, ' \t\n\r') <> ''),
 joined AS (SELECT conv_id, string_agg(text, ' || ' ORDER BY i) AS t FROM mine GROUP BY conv_id),
 lines AS (SELECT {o.key('line')} AS line, max(trim(brand) || ' ' || trim(line)) AS model FROM catalog GROUP BY 1),
 hits AS (SELECT conv_id, model, min(i) AS i FROM mine JOIN lines ON lines.line <> '' AND contains(mine.text, lines.line) GROUP BY ALL),
 lasts AS (SELECT conv_id, max({{'i': i, 'm': model}}) AS l, count(*) AS n FROM hits GROUP BY conv_id),
 after AS (SELECT conv_id, string_agg(text, ' || ' ORDER BY mine.i) AS a FROM mine JOIN lasts USING (conv_id) WHERE mine.i >= l.i GROUP BY conv_id),
 places AS (SELECT conv_id, t, n, l.m AS m, a, {', '.join(f"{o.last_place('t', cues)} AS {name}" for name, cues in (('high', signals.HIGH), ('medium', signals.MEDIUM), ('low', signals.LOW), ('fin', signals.FINANCED), ('cash', signals.CASH), *((f'o_{k}', v) for k, v in signals.OBJECTIONS.items())))},
   list_max({AMOUNTS_SQL.replace('said', 't')}) AS amount FROM joined LEFT JOIN lasts USING (conv_id) LEFT JOIN after USING (conv_id)),
 labelled AS (SELECT conv_id, CASE WHEN high >= greatest(coalesce(medium, -1), coalesce(low, -1)) THEN 'alta' WHEN medium >= coalesce(low, -1) THEN 'media' WHEN low IS NOT NULL THEN 'baja' WHEN {o.has('t', signals.INFORMATIVE)} THEN 'informativa' END AS intencion_compra,
   coalesce(high, medium, low) IS NOT NULL AS told, CASE WHEN fin > coalesce(cash, -1) THEN 'financiacion' WHEN cash IS NOT NULL THEN 'contado' END AS forma_pago,
   CASE WHEN {o.has('t', signals.NO_DOWN)} THEN 0.0 WHEN {o.has('t', signals.DOWN)} THEN amount END AS cuota_inicial, {o.has('t', signals.DOWN)} AS down, CASE WHEN NOT {o.has('t', signals.NOT_BUDGET)} AND {o.has('t', signals.BUDGET)} THEN amount END AS presupuesto,
   list_min(list_filter([{', '.join(f"{{'p': o_{k}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(signals.OBJECTIONS))}], lambda x: x.p IS NOT NULL)).k AS objecion, CASE WHEN {o.has('t', signals.VISIT)} THEN true END AS solicitud_cita, CASE WHEN {o.has('t', signals.QUOTE)} THEN true END AS solicitud_cotizacion,
   CASE WHEN n = 1 OR {o.has('a', [*signals.ACCEPTANCE, *signals.HIGH, *signals.MEDIUM])} THEN m END AS model_interes, coalesce(n, 0) AS n FROM places),
 weak AS (SELECT *, CASE WHEN (n > 1 AND model_interes IS NULL) OR coalesce(objecion, '') = 'disponibilidad' THEN 'low' WHEN n > 1 OR NOT told OR (cuota_inicial IS NULL AND down) OR presupuesto IS NOT NULL THEN 'medium' ELSE 'high' END AS confidence FROM labelled)"""


@query(o.with_tables(f"SELECT conv_id, lead_id, {', '.join(g.FIELDS)}, confidence FROM weak JOIN chats USING (conv_id)", o.CHATS, o.CATALOG, NAMED, LABELLED))
def k06_weak_labels(spark, d):
    """All eight signals and the confidence, with products named in a part of the conversations."""
    t = {name: bridge.read(spark, d, name) for name in ("chat_turns", "chats", "catalog")}
    said = spark.sql("WITH " + NAMED.replace("FROM chats", "FROM {chats}").replace("JOIN catalog", "JOIN {catalog}").replace("FROM chat_turns", "FROM {chat_turns}") + " SELECT * FROM said", **t)
    return signals.weak_labels(signals.conversations(said, t["chats"]), t["catalog"]).select("conv_id", "lead_id", *g.FIELDS, "confidence")


def _extract(cid: str, text: str) -> dict:
    """An extractor that fails on a part of the conversations."""
    if cid.endswith("7"):
        raise ValueError(f"no answer for {cid}")
    return {"raw_text": '{"solicitud_cita": %s}' % ("true" if "voy" in text else "null"), "latency_ms": len(text)}


@query(o.with_tables("""SELECT conversation_id, NOT bad AS success, CASE WHEN NOT bad THEN length(transcript) END AS latency_ms, CASE WHEN NOT bad THEN '{"solicitud_cita": ' || CASE WHEN contains(transcript, 'voy') THEN 'true' ELSE 'null' END || '}' END AS raw_text, CASE WHEN bad THEN 'ValueError: no answer for ' || conversation_id END AS error, 'custom' AS model
 FROM (SELECT concat('CONV-', lpad(concat('', conv_id), 6, '0')) AS conversation_id, conv_id % 10 = 7 AS bad, string_agg(trim(sender) || ': ' || trim(text, ' \t\n\r'), '\n' ORDER BY turn) AS transcript FROM chat_turns WHERE trim(text, ' \t\n\r') <> '' GROUP BY conv_id)""", o.CHATS))
def v01_apply_extractor(spark, d):
    return signals.apply_extractor(talks(spark, d), _extract)


OTHER = scoring.params(**CATALOG_RANGE, score_version="v9", base_gestionable=5, ticket_weight=0.5, ticket_max_points=60, queue_commercial_weight=0.2, queue_urgency_weight=0.8, sin_gestion_mas_48h_min=65, antiguedad_points={"mas_48h": 5, "24_48h": 30}, estado_base=PARAMS["estado_base"] | {"Contactado": 75}, band_media_desde=20)


@query(o.with_leads("SELECT lead_id, 'v9' AS score_version, commercial, urgency, band, priority_rank, advisor_id FROM decided JOIN scored USING (lead_id)", o.ADVISORS, _score_sql(OTHER), ASSIGNED))
def v02_params_as_data(spark, d):
    """Parameters travel as data: scores and decisions by weights that differ from those of the other queries."""
    n = kept_leads(spark, d)
    s = scoring.score_leads(scoring.lead_signals(n, bridge.read(spark, d, "catalog")), OTHER)
    out = assign.assign_leads(assign.eligible_candidates(n, s), bridge.read(spark, d, "advisors"))
    return out.join(s.select("lead_id", "score_version", "commercial", "urgency", "band"), "lead_id").select("lead_id", "score_version", "commercial", "urgency", "band", "priority_rank", "advisor_id")


#: Chat signals of a lead from weak labels of its conversations: the highest intent, then the latest; the latest of the others.
CHAT_SIGNALS = LABELLED.replace("FROM said", "FROM chat_turns") + """,
 con AS (SELECT lead_id, arg_max(intencion_compra, (CASE intencion_compra WHEN 'alta' THEN 4 WHEN 'media' THEN 3 WHEN 'baja' THEN 2 ELSE 1 END, conv_id)) FILTER (intencion_compra IS NOT NULL) AS intencion_compra, bool_or(solicitud_cita) AS solicitud_cita, bool_or(solicitud_cotizacion) AS solicitud_cotizacion,
  arg_max(presupuesto, conv_id) FILTER (presupuesto IS NOT NULL) AS presupuesto, arg_max(cuota_inicial, conv_id) FILTER (cuota_inicial IS NOT NULL) AS cuota_inicial, arg_max(forma_pago, conv_id) FILTER (forma_pago IS NOT NULL) AS forma_pago, arg_max(objecion, conv_id) FILTER (objecion IS NOT NULL) AS objecion
  FROM weak JOIN chats USING (conv_id) WHERE lead_id IS NOT NULL GROUP BY lead_id)"""
_P, _Q = PARAMS, PARAMS["quality_points"]
#: All reasons of a lead with their points, in order: those of `codes` and what quality and urgency add.
EXPLAINED = f"""
 explained AS (SELECT *, list_concat(list_transform(string_split(codes, ','), lambda c: {{'c': c, 'p': CASE c WHEN 'BASE_GESTIONABLE' THEN {float(_P['base_gestionable'])}::DOUBLE {' '.join(f"WHEN 'INTENCION_{k.upper()}' THEN {float(v)}" for k, v in _P['intencion_points'].items())} WHEN 'CLIENTE_PIDIO_CITA' THEN {float(_P['cita_points'])} WHEN 'CLIENTE_PIDIO_COTIZACION' THEN {float(_P['cotizacion_points'])}
   WHEN 'PRESUPUESTO_COMPATIBLE' THEN {float(_P['presupuesto_compatible_points'])} WHEN 'PRESUPUESTO_INSUFICIENTE' THEN {float(_P['presupuesto_insuficiente_points'])} WHEN 'CUOTA_SUFICIENTE' THEN {float(_P['cuota_suficiente_points'])} WHEN 'FORMA_PAGO_DECLARADA' THEN {float(_P['forma_pago_points'])}
   {' '.join(f"WHEN 'OBJECION_{k.upper()}' THEN {float(v)}" for k, v in _P['objecion_points'].items())} ELSE {o.half_up(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (list_price - {_P['catalog_min_price']}::DOUBLE) / {_P['catalog_max_price'] - _P['catalog_min_price']}::DOUBLE)) * {float(_P['ticket_max_points'])}::DOUBLE * {_P['ticket_weight']}::DOUBLE")} END}}),
  list_filter([{', '.join(f"{{'c': '{c}', 'p': CASE WHEN {w} THEN {float(_Q[k])}::DOUBLE END}}" for c, w, k in (('TELEFONO_VALIDO', 'phone_normalized IS NOT NULL', 'phone'), ('MODELO_RESUELTO', 'sku IS NOT NULL', 'model'), ('EMAIL_PRESENTE', 'email_normalized IS NOT NULL', 'email'), ('CIUDAD_PRESENTE', 'city_raw IS NOT NULL', 'city'), ('FECHA_CONFIABLE', 'registration_at IS NOT NULL', 'registration_date')))},
   {{'c': 'ESTADO_OPERATIVO', 'p': CASE status {' '.join(f"WHEN {o.quoted(k)} THEN {float(v)}::DOUBLE" for k, v in _P['estado_base'].items())} END}}, {{'c': 'ESTADO_DESCONOCIDO', 'p': CASE WHEN status IS NULL OR status NOT IN ({', '.join(map(o.quoted, _P['estado_base']))}) THEN {float(_P['estado_desconocido_base'])}::DOUBLE END}},
   {{'c': 'SIN_CONTACTO_MAS_48H', 'p': CASE WHEN NOT cita AND registration_at IS NOT NULL AND first_contact_at IS NULL AND days >= 2 THEN {float(_P['antiguedad_points']['mas_48h'])}::DOUBLE END}}, {{'c': 'SIN_CONTACTO_24_48H', 'p': CASE WHEN NOT cita AND registration_at IS NOT NULL AND first_contact_at IS NULL AND days = 1 THEN {float(_P['antiguedad_points']['24_48h'])}::DOUBLE END}}], lambda x: x.p IS NOT NULL)) AS code_points FROM scored)"""
CHAT_SCORED = (o.CHATS, CHAT_SIGNALS, _score_sql(chats=True))


def chat_scores(spark, d, n):
    con = signals.consolidate(signals.labels_as_extractions(signals.weak_labels(talks(spark, d))))
    linked = ingest.link_conversations(bridge.read(spark, d, "chats"), n).where("status = 'linked'")
    return scoring.score_leads(scoring.lead_signals(n, bridge.read(spark, d, "catalog"), con, linked), PARAMS)


@query(o.with_leads("SELECT lead_id, commercial, quality, urgency, queue, band, urgency_band, codes FROM scored", *CHAT_SCORED))
def k03_score_chat_signals(spark, d):
    """Scores with what customers said: intent, budget, payment, objections, appointments; and the commercial reasons."""
    s = chat_scores(spark, d, kept_leads(spark, d))
    codes = F.array_join(F.transform(F.filter("reasons", lambda r: r["dimension"] == "commercial"), lambda r: r["code"]), ",")
    return s.select("lead_id", "commercial", "quality", "urgency", "queue", "band", "urgency_band", codes.alias("codes"))


@query(o.with_leads("""SELECT band, place, lead_id, commercial, urgency, queue, quality, array_to_string(list_transform(list_sort(list_filter(whys, lambda x: x.t IS NOT NULL))[1:3], lambda x: x.t), '; ') AS top FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY lead_id) AS place,
 list_transform(range(1, len(code_points) + 1), lambda i: {'w': -abs(code_points[i].p), 'i': i, 't': code_points[i].c || '(' || CASE WHEN code_points[i].p >= 0 THEN '+' ELSE '' END || CAST(code_points[i].p AS VARCHAR) || ')'}) AS whys FROM explained) WHERE place <= 2""", *CHAT_SCORED, EXPLAINED))
def g08_score_samples(spark, d):
    """Two leads of each band with their three weightiest reasons."""
    return scoring.score_samples(materialize(chat_scores(spark, d, kept_leads(spark, d)), "scores"))


SECONDARY = " secondary AS (SELECT node AS lead_id FROM w14 WHERE node <> c)"


@query(o.with_leads("SELECT * EXCLUDE (way) FROM decided", *CHAT_SCORED, o.ADVISORS, PAIRS, WEAK_PAIRS, EDGES, CLUSTERS, SECONDARY, _assign_sql("secondary")))
def k10_lead_pipeline(spark, d):
    """The whole job from raw leads and chats to assignments."""
    i = _inputs(spark, d)
    tables, _ = jobs.lead_pipeline(spark, i["raw_leads"], i["org"], i["catalog"], i["advisors"], talks(spark, d).select("conversation_id", "lead_id", "messages"), params=PARAMS)
    return tables["assignments"].drop("reason")


#: The day before: a third of the first run's assignments are current, some of them in another branch's hands.
BEFORE = """
 yesterday AS (SELECT lead_id, CASE WHEN ln % 15 = 0 THEN 'AS-00001' ELSE advisor_id END AS advisor_id, status, ln % 6 = 0 AS is_current FROM (SELECT *, cast(substr(lead_id, 4) AS bigint) AS ln FROM decided) WHERE ln % 3 = 0)"""
LOAD = f"""
 load AS (SELECT advisor_id, count(*) AS load FROM yesterday JOIN leads l USING (lead_id) WHERE is_current AND yesterday.status = 'assigned' AND (l.status IS NULL OR l.status NOT IN ({', '.join(map(o.quoted, f.TERMINAL))})) GROUP BY advisor_id),
 kept AS (SELECT lead_id, advisor_id FROM yesterday WHERE is_current AND status = 'assigned')"""


@query(o.with_leads("SELECT * FROM decided2", *CHAT_SCORED, o.ADVISORS, ASSIGNED, BEFORE, LOAD, PAIRS, WEAK_PAIRS, EDGES, CLUSTERS, SECONDARY, _assign_sql("secondary", True)))
def k04_second_day(spark, d):
    """A second day's run: open load takes capacity, current leads keep their advisor, cluster members wait."""
    n, advisors = kept_leads(spark, d), bridge.read(spark, d, "advisors")
    s = materialize(chat_scores(spark, d, n).select("lead_id", "queue"), "scores")
    first = materialize(assign.assign_leads(assign.eligible_candidates(n, s), advisors), "first")
    yesterday = spark.sql("WITH" + BEFORE.replace("FROM decided", "FROM {first}") + " SELECT * FROM yesterday", first=first)
    kept = yesterday.where("is_current and status = 'assigned'").select("lead_id", "advisor_id")
    out = assign.assign_leads(assign.eligible_candidates(n, s, identity.resolve_identities(n, rules=False)[1]), advisors, kept, assign.open_load(yesterday, n))
    way = F.when(F.col("reason").startswith("continuidad"), "kept").when(F.col("reason") == "sin_capacidad", "full").otherwise("rank")
    return out.withColumn("way", way).drop("reason")


@query(o.with_leads("SELECT lead_id, 1 AS run_id, lead_id NOT IN (SELECT lead_id FROM scored WHERE right(lead_id, 1) = '7') AS is_current FROM scored UNION ALL SELECT lead_id, 2, true FROM scored WHERE right(lead_id, 1) = '7'", SCORED))
def u02_version_scores(spark, d):
    s = materialize(scores(spark, d), "scores")
    stored = s.withColumns({"run_id": F.lit(1), "is_current": F.lit(True)}).withColumn("queue", F.when(F.col("lead_id").endswith("7"), -1.0).otherwise(F.col("queue"))).select("lead_id", "run_id", "score_version", "commercial", "urgency", "queue", "band", "params_snapshot", "is_current")
    return scoring.version_scores(stored, s, 2).select("lead_id", "run_id", "is_current")


# audit

def raw(spark, d):
    return bridge.read(spark, d, "raw_leads")


RAW_COLUMNS = list(ingest.RAW)
LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM raw_leads" for c in RAW_COLUMNS) + ")"


@query(o.with_tables("""SELECT col AS "column", count(*) AS n, count_if(trim(coalesce(value, '')) = '') AS nulls, count(DISTINCT CASE WHEN trim(coalesce(value, '')) <> '' THEN value END) AS "distinct" FROM long GROUP BY col""", o.RAW, LONG))
def p01_profile_columns(spark, d):
    return audit.profile_columns(raw(spark, d), RAW_COLUMNS).select("column", "n", "nulls", "distinct")


KINDS = r"""
 counts AS (SELECT col, value, trim(coalesce(value, '')) AS v, count(*) AS n FROM long GROUP BY col, value),
 kinds AS (SELECT *, v = '' AS blank, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}') THEN 'date'
   WHEN regexp_matches(v, '^[+(]?[0-9][0-9() +-]*$') AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 12 THEN 'phone' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^-?[0-9]*[.][0-9]+$') THEN 'decimal'
   WHEN regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' ELSE 'text' END AS kind FROM counts),
 sums AS (SELECT col, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (blank), 0)::BIGINT AS nulls, count_if(NOT blank) AS several, coalesce(sum(n) FILTER (NOT blank), 0) AS filled FROM kinds GROUP BY col),
 shares AS (SELECT col, kind, sum(n) AS n FROM kinds WHERE NOT blank GROUP BY col, kind),
 typed AS (SELECT s.col, CASE WHEN filled = 0 THEN 'empty' WHEN coalesce(max(h.n) FILTER (kind = 'date'), 0) >= 0.95 * filled THEN 'date' WHEN max(h.n) FILTER (kind = 'phone') = filled THEN 'phone' WHEN max(h.n) FILTER (kind = 'integer') = filled THEN 'integer'
   WHEN max(h.n) FILTER (kind = 'email') = filled THEN 'email' WHEN sum(h.n) FILTER (kind IN ('integer', 'decimal')) = filled THEN 'decimal' ELSE 'text' END AS type FROM sums s LEFT JOIN shares h ON s.col = h.col GROUP BY s.col, filled),
 tops AS (SELECT col, string_agg(concat(value, ':', n), '|' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS r FROM kinds WHERE NOT blank) WHERE r <= 5 GROUP BY col)"""


@query(o.with_tables("""SELECT s.col AS "column", n, nulls, several AS "distinct", type, top FROM sums s JOIN typed t ON s.col = t.col LEFT JOIN tops p ON s.col = p.col""", o.RAW, LONG, KINDS))
def p01_l04_profile_top_values(spark, d):
    return audit.profile_columns(raw(spark, d), RAW_COLUMNS)


@query(o.with_tables("SELECT count(*) AS conversations, sum(n) AS messages, 'conv_id,conversation_id,lead_id,messages' AS columns, 'sender,text,turn' AS message_columns FROM (SELECT conv_id, count(*) AS n FROM chat_turns GROUP BY conv_id)", o.CHATS))
def p02_profile_conversations(spark, d):
    return audit.profile_conversations(talks(spark, d).withColumn("nothing", F.lit(None).cast("string")))


@query(o.with_tables("""SELECT col AS "column", count_if(trim(coalesce(value, '')) = '') AS blank, count_if(trim(coalesce(value, '')) = '') / count(*) AS share FROM long GROUP BY col HAVING blank > 0""", o.RAW, LONG))
def p03_missing_values(spark, d):
    return audit.missing_values(raw(spark, d), RAW_COLUMNS)


@query(o.with_tables(f"SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extras FROM (SELECT count(*) AS n FROM raw_leads GROUP BY {', '.join(RAW_COLUMNS)} HAVING count(*) > 1)", o.RAW))
def q01_duplicate_rows(spark, d):
    return audit.duplicate_rows(raw(spark, d), RAW_COLUMNS)


@query(o.with_tables("SELECT lead_id, count(*) AS n FROM raw_leads GROUP BY lead_id HAVING count(*) > 1", o.RAW))
def q01_duplicate_keys(spark, d):
    return audit.duplicate_keys(raw(spark, d), "lead_id")


@query(o.with_tables(f"SELECT {o.status('estado_gestion')} AS value, count(DISTINCT estado_gestion) AS variants, count(*) AS n FROM raw_leads GROUP BY 1", o.RAW))
def q02_value_variants(spark, d):
    return audit.value_variants(raw(spark, d), "estado_gestion", f.normalize_status(F.col("estado_gestion")))


@query(o.with_tables(f"SELECT {o.status('estado_gestion')} AS status, count_if(trim(fecha_primer_contacto) <> '') AS with_contact, count_if(trim(fecha_primer_contacto) = '') AS without_contact FROM raw_leads GROUP BY 1", o.RAW))
def q03_status_contact(spark, d):
    return audit.status_contact_matrix(raw(spark, d))


@query(o.with_tables(f"""SELECT count_if(nombre_cliente <> trim(nombre_cliente) OR regexp_matches(nombre_cliente, '\\s{{2,}}')) AS extra_spaces, count_if(nombre_cliente = upper(nombre_cliente)) AS upper_case,
 (SELECT count(*) FROM (SELECT 1 FROM raw_leads GROUP BY {o.key('nombre_cliente')}, {o.phone('telefono')} HAVING count(*) > 1)) AS repeated_name_phone FROM raw_leads""", o.RAW))
def q04_names(spark, d):
    return audit.name_analysis(raw(spark, d))


@query(o.with_tables(f"""SELECT count_if(length({o.digits('telefono')}) NOT BETWEEN 10 AND 12) AS invalid, (SELECT count(*) FROM (SELECT 1 FROM raw_leads GROUP BY {o.phone('telefono')} HAVING count(DISTINCT lead_id) > 1)) AS shared_phones,
 (SELECT max(n) FROM (SELECT count(DISTINCT lead_id) AS n FROM raw_leads GROUP BY {o.phone('telefono')} HAVING count(DISTINCT lead_id) > 1)) AS most_leads FROM raw_leads""", o.RAW))
def q05_phones(spark, d):
    return audit.phone_analysis(raw(spark, d))


@query(o.with_tables("""SELECT count(nullif(trim(email), '')) AS present, count_if(trim(email) = '') AS missing, count_if(trim(email) <> '' AND NOT regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS invalid,
 (SELECT count(*) FROM (SELECT 1 FROM raw_leads WHERE trim(email) <> '' GROUP BY lower(trim(email)) HAVING count(*) > 1)) AS repeated FROM raw_leads""", o.RAW))
def q06_emails(spark, d):
    return audit.email_analysis(raw(spark, d))


@query(o.with_tables("SELECT c AS \"column\", format, count(*) AS n, count_if(ambiguous) AS ambiguous FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {o.date_format(c)} AS format, {o.date_ambiguous(c)} AS ambiguous FROM raw_leads" for c in ("fecha_registro", "fecha_primer_contacto")) + ") GROUP BY 1, 2", o.RAW))
def q07_date_formats(spark, d):
    return audit.date_formats(raw(spark, d), ["fecha_registro", "fecha_primer_contacto"])


@query(o.with_tables(f"""SELECT count_if(a IS NOT NULL AND b IS NOT NULL AND NOT u AND b < a) AS contact_before_registration, count_if(a IS NULL OR b IS NULL) AS unparsed, count_if(a IS NOT NULL AND b IS NOT NULL AND u) AS skipped_ambiguous FROM
 (SELECT {o.date_parsed('fecha_registro')} AS a, {o.date_parsed('fecha_primer_contacto')} AS b, {o.date_ambiguous('fecha_registro')} OR {o.date_ambiguous('fecha_primer_contacto')} AS u FROM raw_leads)""", o.RAW))
def q08_chronology(spark, d):
    return audit.chronology(raw(spark, d))


@query(o.with_tables(f"""SELECT row_number, lead_id, fecha_registro, fecha_primer_contacto FROM raw_leads WHERE {o.date_parsed('fecha_primer_contacto')} < {o.date_parsed('fecha_registro')} AND NOT {o.date_ambiguous('fecha_registro')} AND NOT {o.date_ambiguous('fecha_primer_contacto')} ORDER BY row_number LIMIT 5""", o.RAW))
def q08_chronology_examples(spark, d):
    """A top-k report: the first five."""
    return audit.chronology_examples(raw(spark, d))


@query(o.with_leads("SELECT match_type, count(*) AS n, count(DISTINCT model_text_raw) AS texts FROM leads GROUP BY 1", fuzzy=False))
def q09_match_histogram(spark, d):
    return audit.match_histogram(leads(spark, d, fuzzy=False))


ISSUE_SQL = {"I01": "nombre_cliente <> trim(nombre_cliente) OR regexp_matches(nombre_cliente, '\\s{2,}')", "I02": f"length({o.phone('telefono')}) IS DISTINCT FROM 10", "I03": "trim(email) <> '' AND NOT regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')", "I04": "trim(email) = ''", "I05": "trim(ciudad) = ''",
             "I06": f"{o.key('ciudad')} <> '' AND {o.city('ciudad')} IS NULL", "I07": "trim(canal) = ''", "I08": o.date_ambiguous("fecha_registro"), "I09": f"{o.date_format('fecha_registro')} = 'desconocido'", "I10": "trim(fecha_primer_contacto) = ''", "I11": f"{o.status('estado_gestion')} <> estado_gestion", "I12": "trim(campania) = ''", "I13": "trim(modelo_interes_texto) = ''"}


@query(o.with_tables("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS issue_id, '{a}' AS field, '{k}' AS kind, '{r}' AS remedy, count_if({ISSUE_SQL[i]}) AS affected FROM raw_leads" for i, a, k, r in audit.ISSUES) + ") WHERE affected > 0", o.RAW))
def q10_s03_issue_catalog(spark, d):
    return audit.issue_catalog(raw(spark, d))


#: The catalogue with branches and units; two of the branch numbers in use do not exist.
STOCK = " stock AS (SELECT *, [printf('PV-%03d', k % 25 + 1), printf('PV-%03d', k % 27 + 1)] AS pos, k % 13 AS units FROM (SELECT *, CAST(substr(sku, 5) AS BIGINT) AS k FROM catalog))"


def stocked(spark, d):
    pos = lambda n: f"concat('PV-', lpad(cast(cast(substr(sku, 5) as bigint) % {n} + 1 as string), 3, '0'))"
    return bridge.read(spark, d, "catalog").withColumn("availability", F.struct(F.expr(f"array({pos(25)}, {pos(27)})").alias("points_of_sale"), F.expr("cast(cast(substr(sku, 5) as bigint) % 13 as int)").alias("units_total")))


@query(o.with_tables("""SELECT d.dimension, d.value, count(*) AS n, count(DISTINCT line) AS lines, min(list_price) AS price_min, max(list_price) AS price_max, floor(avg(list_price) * 100 + 0.5) / 100 AS price_mean, CAST(sum(units) AS BIGINT) AS units_total, min(units) AS units_min, max(units) AS units_max, min(len(pos)) AS branches_min, max(len(pos)) AS branches_max
 FROM (SELECT *, unnest([{'dimension': 'all', 'value': ''}, {'dimension': 'brand', 'value': brand}, {'dimension': 'segment', 'value': segment}, {'dimension': 'engine_cc', 'value': CAST(engine_cc AS VARCHAR)}]) AS d FROM stock) GROUP BY 1, 2""", o.CATALOG, STOCK))
def q11_catalog_summary(spark, d):
    return audit.catalog_summary(stocked(spark, d))


@query(o.with_tables("SELECT g.point_of_sale_id, g.company_id, count(a.advisor_id) AS advisors, coalesce(count_if(a.active), 0) AS active, coalesce(sum(CASE WHEN a.active THEN daily_capacity ELSE 0 END), 0)::BIGINT AS capacity FROM org g LEFT JOIN advisors a USING (point_of_sale_id) GROUP BY 1, 2", o.ORG, o.ADVISORS))
def q12_advisor_summary(spark, d):
    return audit.advisor_summary(bridge.read(spark, d, "advisors"), bridge.read(spark, d, "org"))


_MEASURES = ", ".join(f"min({k}) AS {k}_min, max({k}) AS {k}_max, floor(avg({k}) * 10 + 0.5) / 10 AS {k}_mean, median({k}) AS {k}_median" for k in ("messages", "characters", "words"))


@query(o.with_tables(f"""SELECT count(*) AS conversations, count(l.lead_id) AS matched, count_if(l.lead_id IS NULL) AS unmatched, count_if(first <> 'cliente') AS not_by_customer, count_if(senders = 1) AS single_sender, sum(messages) AS messages, {_MEASURES} FROM
 (SELECT conv_id, count(*) AS messages, count(DISTINCT sender) AS senders, arg_min(sender, turn) AS first, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))) AS BIGINT) AS words FROM chat_turns GROUP BY conv_id) t JOIN chats USING (conv_id) LEFT JOIN (SELECT DISTINCT lead_id FROM raw_leads) l ON l.lead_id = chats.lead_id""", o.RAW, o.CHATS))
def q13_conversation_stats(spark, d):
    return audit.conversation_stats(talks(spark, d), raw(spark, d)).drop("empty")


@query(o.with_tables("SELECT sender, count(*) AS n FROM chat_turns GROUP BY sender", o.CHATS))
def q13_senders(spark, d):
    return audit.sender_counts(talks(spark, d))


COVERAGE = "SELECT (SELECT count(DISTINCT lead_id) FROM raw_leads WHERE lead_id NOT IN (SELECT lead_id FROM chats)) AS leads_without_chat, (SELECT count(*) FROM (SELECT lead_id FROM chats GROUP BY 1 HAVING count(*) > 1)) AS leads_with_several, (SELECT count(*) FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM raw_leads)) AS unmatched"


@query(o.with_tables(COVERAGE, o.RAW, o.CHATS))
def q13_chat_coverage(spark, d):
    return audit.chat_coverage(talks(spark, d), raw(spark, d))


def history(spark, d):
    return bridge.read(spark, d, "history")


@query(o.with_tables("SELECT company_id, channel, outcome, count(*) AS n FROM history GROUP BY GROUPING SETS ((outcome), (company_id), (channel), (company_id, outcome), (channel, outcome))", o.HISTORY))
def h01_history_distribution(spark, d):
    return audit.history_distribution(history(spark, d))


@query(o.with_tables("SELECT field, outcome, count(*) AS n, min(v) AS min, max(v) AS max, floor(avg(v) * 100 + 0.5) / 100 AS mean, median(v) AS median FROM (SELECT outcome, 'contacts' AS field, contacts::DOUBLE AS v FROM history UNION ALL SELECT outcome, 'hours', try_cast(hours AS DOUBLE) FROM history) WHERE v IS NOT NULL GROUP BY 1, 2", o.HISTORY))
def h02_numeric_stats(spark, d):
    return audit.history_numeric_stats(history(spark, d), ["contacts", "hours"])


@query(o.with_tables("SELECT 'hours' AS field, count_if(hours = '' AND outcome = 'Sin gestión') AS blank_inside, count_if(hours = '' AND outcome <> 'Sin gestión') AS blank_outside, count_if(try_cast(hours AS DOUBLE) = 0 AND outcome = 'Sin gestión') AS zero_inside, count_if(try_cast(hours AS DOUBLE) = 0 AND outcome <> 'Sin gestión') AS zero_outside FROM history", o.HISTORY))
def h03_leakage(spark, d):
    return audit.leakage_check(history(spark, d), "hours", "Sin gestión")


@query(o.with_tables("SELECT channel, count_if(outcome IN ('Cerrado', 'Perdido')) AS n, count_if(outcome = 'Cerrado')::DOUBLE / nullif(count_if(outcome IN ('Cerrado', 'Perdido')), 0) AS rate FROM history GROUP BY channel", o.HISTORY))
def h04_conversion(spark, d):
    return audit.conversion_rate(history(spark, d), "channel")


#: History in which some rows carry a lead's id, others name a line alone or a model that the catalogue has not.
PAST = """ past AS (SELECT * REPLACE (CASE WHEN ho % 40 = 3 THEN concat('LD-', lpad(concat('', ho), 7, '0')) ELSE lead_id END AS lead_id, CASE WHEN ho % 5 = 1 THEN regexp_replace(model, '^[^ ]+ ', '') WHEN ho % 7 = 2 THEN concat('Otra ', p_partkey % 3) ELSE model END AS model, CASE WHEN ho % 11 = 4 THEN price + 1 ELSE price END AS price) FROM (SELECT *, CAST(split_part(lead_id, '-', 2) AS BIGINT) AS ho FROM history))"""
BY_KEY = f""" by_full AS (SELECT {o.model("brand || ' ' || line")} AS key, max(list_price) AS price FROM catalog GROUP BY 1), by_line AS (SELECT {o.model('line')} AS key, max(list_price) AS price FROM catalog GROUP BY 1),
 priced AS (SELECT h.*, coalesce(a.price, b.price) AS catalog_price FROM (SELECT *, {o.model('model')} AS key FROM past) h LEFT JOIN by_full a ON a.key = h.key LEFT JOIN by_line b ON b.key = h.key)"""


def past(spark, d):
    h = history(spark, d).withColumn("ho", F.split_part("lead_id", F.lit("-"), F.lit(2)).cast("long"))
    return h.withColumns({"lead_id": F.expr("case when ho % 40 = 3 then concat('LD-', lpad(concat('', ho), 7, '0')) else lead_id end"), "model": F.expr("case when ho % 5 = 1 then regexp_replace(model, '^[^ ]+ ', '') when ho % 7 = 2 then concat('Otra ', p_partkey % 3) else model end"),
                          "price": F.expr("case when ho % 11 = 4 then price + 1 else price end")}).drop("ho")


@query(o.with_tables("SELECT (SELECT count(DISTINCT lead_id) FROM raw_leads) AS left_keys, (SELECT count(DISTINCT lead_id) FROM past) AS right_keys, (SELECT count(*) FROM (SELECT lead_id FROM raw_leads INTERSECT SELECT lead_id FROM past)) AS \"both\"", o.RAW, o.HISTORY, PAST))
def j13_s02_key_overlap(spark, d):
    return audit.key_overlap(raw(spark, d), past(spark, d))


@query(o.with_tables("SELECT point_of_sale_id FROM org EXCEPT SELECT point_of_sale_id FROM advisors WHERE active AND right(point_of_sale_id, 1) NOT IN ('3', '7')", o.ORG, o.ADVISORS))
def j14_branches_without_advisor(spark, d):
    """All advisors of some branches are made inactive."""
    roster = bridge.read(spark, d, "advisors").withColumn("active", F.col("active") & ~F.right("point_of_sale_id", F.lit(1)).isin("3", "7"))
    return audit.branches_without_advisor(bridge.read(spark, d, "org"), roster)


@query(o.with_tables("""SELECT 'unknown_branch' AS kind, sku, p AS point_of_sale_id FROM (SELECT sku, unnest(pos) AS p FROM stock) WHERE p NOT IN (SELECT point_of_sale_id FROM org)
 UNION ALL SELECT DISTINCT 'without_advisor', NULL, p FROM (SELECT sku, unnest(pos) AS p FROM stock) WHERE p NOT IN (SELECT point_of_sale_id FROM advisors WHERE active AND right(point_of_sale_id, 1) NOT IN ('3', '7'))""", o.ORG, o.ADVISORS, o.CATALOG, STOCK))
def j14_availability(spark, d):
    roster = bridge.read(spark, d, "advisors").withColumn("active", F.col("active") & ~F.right("point_of_sale_id", F.lit(1)).isin("3", "7"))
    return audit.availability_check(stocked(spark, d), bridge.read(spark, d, "org"), roster)


@query(o.with_tables("SELECT count(catalog_price) AS known, count_if(catalog_price IS NULL) AS unknown, count_if(catalog_price <> price) AS price_differs FROM priced", o.CATALOG, o.HISTORY, PAST, BY_KEY))
def j15_history_vs_catalog(spark, d):
    return audit.history_vs_catalog(past(spark, d), bridge.read(spark, d, "catalog"))


@query(o.with_leads("SELECT 'history' AS dataset, model AS text, count(*) AS n FROM priced WHERE catalog_price IS NULL GROUP BY 2 UNION ALL SELECT 'leads', model_text_raw, count(*) FROM leads WHERE match_type = 'sin_match' GROUP BY 2", o.HISTORY, PAST, BY_KEY, fuzzy=False))
def j15_unknown_models(spark, d):
    return audit.unknown_models(past(spark, d), bridge.read(spark, d, "catalog"), leads(spark, d, fuzzy=False))


ROSTER = " roster AS (SELECT * REPLACE (CASE WHEN CAST(right(advisor_id, 5) AS BIGINT) % 40 = 7 THEN 'EMP-00' ELSE company_id END AS company_id) FROM advisors)"
_FORMAT = "CASE WHEN trim(telefono) = '' THEN 'vacio' " + " ".join(f"WHEN regexp_matches(trim(telefono), {o.quoted(p)}) THEN '{n}'" for n, p in f.PHONE_FORMATS) + " ELSE 'otro' END"
_EARLY = f"{o.date_parsed('fecha_primer_contacto')} < {o.date_parsed('fecha_registro')} AND NOT {o.date_ambiguous('fecha_registro')} AND NOT {o.date_ambiguous('fecha_primer_contacto')}"
_CITY_KEY = o.cases(o.key("ciudad"), f.CITY_ALIASES, o.key("ciudad"))
AFFECTED = {
    "Q01": f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM raw_leads GROUP BY {', '.join(ingest.RAW)}))", "Q02": "(SELECT count_if(trim(canal) NOT IN ('', 'WhatsApp', 'Meta Ads', 'Formulario Web')) FROM raw_leads)", "Q03": f"(SELECT count_if(trim(estado_gestion) IS DISTINCT FROM {o.status('estado_gestion')}) FROM raw_leads)",
    "Q04": f"(SELECT count_if({o.date_format('fecha_registro')} = '{f.SLASH}') FROM raw_leads)", "Q05": f"(SELECT count_if({o.date_format('fecha_registro')} IN ('ISO_T', 'ISO_SPACE', '{f.DASH}')) FROM raw_leads)", "Q06": f"(SELECT count_if({_EARLY}) FROM raw_leads)", "Q07": f"(SELECT count_if({_FORMAT} NOT IN ('plano_10', 'vacio')) FROM raw_leads)",
    "Q08": f"(SELECT count_if(length({o.digits('telefono')}) NOT BETWEEN 10 AND 12) FROM raw_leads)", "Q09": f"(SELECT count(*) FROM (SELECT {o.phone('telefono')} AS p FROM raw_leads WHERE {o.phone('telefono')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lead_id) > 1))", "Q10": "(SELECT count_if(trim(email) = '') FROM raw_leads)",
    "Q11": "(SELECT count(*) FROM (SELECT lower(trim(email)) AS e FROM raw_leads WHERE trim(email) <> '' GROUP BY 1 HAVING count(*) > 1))", "Q12": f"(SELECT count(DISTINCT trim(ciudad)) - count(DISTINCT {_CITY_KEY}) FROM raw_leads WHERE trim(ciudad) <> '')", "Q13": "(SELECT count_if(trim(ciudad) = '') FROM raw_leads)",
    "Q14": "(SELECT count_if(match_type IN ('solo_marca', 'prefijo_ambiguo')) FROM leads)", "Q15": "(SELECT count_if(match_type IN ('directo_unico', 'prefijo_unico')) FROM leads)", "Q16": "(SELECT count_if(trim(modelo_interes_texto) = '') FROM raw_leads)", "Q17": "(SELECT count_if(trim(campania) = '') FROM raw_leads)",
    "Q18": f"(SELECT count_if(trim(fecha_primer_contacto) = '' AND {o.status('estado_gestion')} IS DISTINCT FROM 'Sin gestión') FROM raw_leads)", "Q19": f"(SELECT count(DISTINCT CASE WHEN {o.date_format('fecha_registro')} = 'desconocido' THEN trim(fecha_registro) END) + count(DISTINCT CASE WHEN {o.date_format('fecha_primer_contacto')} = 'desconocido' THEN trim(fecha_primer_contacto) END) FROM raw_leads)",
    "Q20": "(SELECT count_if(trim(canal) = '') FROM raw_leads)", "Q21": "(SELECT count_if(nombre_cliente <> trim(nombre_cliente) OR contains(nombre_cliente, '  ')) FROM raw_leads)", "Q22": f"(SELECT count(*) FROM (SELECT 1 FROM raw_leads GROUP BY {o.key('nombre_cliente')}, {o.phone('telefono')} HAVING count(*) > 1))",
    "R01": "(SELECT count(*) FROM (SELECT punto_venta_id AS p, empresa_id AS c FROM raw_leads UNION ALL SELECT point_of_sale_id, company_id FROM roster) LEFT JOIN org ON point_of_sale_id = p WHERE company_id IS NULL OR company_id <> c)", "R02": "(SELECT count(*) FROM (SELECT unnest(pos) AS p FROM stock) WHERE p NOT IN (SELECT point_of_sale_id FROM org))",
    "R03": "(SELECT count(*) FROM (SELECT lead_id FROM raw_leads INTERSECT SELECT lead_id FROM past))", "C01": f"(SELECT unmatched FROM ({COVERAGE}))", "C02": f"(SELECT leads_with_several FROM ({COVERAGE}))", "C03": f"(SELECT leads_without_chat FROM ({COVERAGE}))",
    "H01": "(SELECT count_if(hours = '') FROM past)", "H02": "(SELECT count_if(contacts = 0) FROM past)", "H03": "(SELECT count_if(outcome = 'Cerrado') FROM past)", "K01": "(SELECT count_if(catalog_price IS NULL) FROM priced)", "K02": "(SELECT count_if(catalog_price <> price) FROM priced)",
    "A01": "(SELECT count_if(NOT active) FROM roster)", "A02": "(SELECT count(*) FROM roster LEFT JOIN org USING (point_of_sale_id) WHERE org.company_id IS NULL OR org.company_id <> roster.company_id)"}


@query(o.with_leads("SELECT issue_id, dataset, field, kind, remedy, CAST(affected AS BIGINT) AS affected FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS issue_id, '{t}' AS dataset, '{c}' AS field, '{k}' AS kind, '{r}' AS remedy, {AFFECTED[i]} AS affected" for i, t, c, k, r in audit.ALL_ISSUES) + ")", o.ADVISORS, o.CHATS, o.HISTORY, STOCK, PAST, BY_KEY, ROSTER, fuzzy=False))
def q10_all_issues(spark, d):
    """The whole audit's 35 issues, those across tables among them, on tables with planted faults."""
    roster = bridge.read(spark, d, "advisors").withColumn("company_id", F.when(F.substring("advisor_id", 4, 9).cast("long") % 40 == 7, "EMP-00").otherwise(F.col("company_id")))
    return audit.issues(raw(spark, d), list(ingest.RAW), leads(spark, d, fuzzy=False), bridge.read(spark, d, "org"), stocked(spark, d), roster, past(spark, d), talks(spark, d))


# views

def assignments(spark, d, n=None, s=None):
    """Decisions as stored rows of one day."""
    return materialize(decisions(spark, d, n, s).withColumns({"run_date": F.to_date(F.lit("2026-09-01")), "is_current": F.lit(True)}), "assignments")


@query(o.with_leads("SELECT l.lead_id, coalesce(a.name, CASE WHEN d.advisor_id IS NULL THEN 'Sin asignar (overflow)' END, d.advisor_id) AS advisor, coalesce(CASE WHEN c.brand IS NOT NULL THEN concat_ws(' ', c.brand, c.line) END, l.model_text_raw, 'Desconocido') AS model, coalesce(l.city_normalized, l.city_raw, 'Desconocido') AS city, s.band, d.status AS assignment_status FROM decided d JOIN leads l USING (lead_id) JOIN scored s USING (lead_id) LEFT JOIN catalog c ON c.sku = l.sku LEFT JOIN advisors a ON a.advisor_id = d.advisor_id", *DECIDED))
def j12_f36_supervision_rows(spark, d):
    n = kept_leads(spark, d)
    s = kept_scores(spark, d, n)
    return views.supervision_rows(assignments(spark, d, n, s), n, s, bridge.read(spark, d, "catalog"), bridge.read(spark, d, "advisors")).select("lead_id", "advisor", "model", "city", "band", "assignment_status")


@query(o.with_leads("SELECT s.band, d.status AS assignment_status, count(*) AS n, count(DISTINCT d.lead_id) AS leads FROM decided d JOIN scored s USING (lead_id) GROUP BY 1, 2", *DECIDED))
def g06_supervision_counters(spark, d):
    n = kept_leads(spark, d)
    s = kept_scores(spark, d, n)
    a = decisions(spark, d, n, s).select("lead_id", F.col("status").alias("assignment_status"))
    return views.supervision_counters(a.join(s.select("lead_id", "band"), "lead_id"))


@query(o.with_leads("SELECT company_id, count_if(status IS NULL OR status NOT IN ('Cerrado', 'Perdido', 'Descartado')) AS open, count_if(status = 'Cerrado') AS closed, count_if(status = 'Perdido') AS lost, count_if(status = 'Descartado') AS discarded FROM leads GROUP BY 1"))
def g07_lifecycle_counters(spark, d):
    return views.lifecycle_counters(leads(spark, d), "company_id")


@query(o.with_leads("SELECT lead_id FROM leads WHERE company_id = 'EMP-02'"))
def w05_scope_supervisor(spark, d):
    return views.scope_rows(leads(spark, d), "supervisor", "EMP-02").select("lead_id")


@query(o.with_leads("SELECT lead_id, status FROM leads WHERE status = 'Contactado' AND contains(lower(customer_name), 'muñoz')"))
def w02_w03_f41_filters(spark, d):
    return views.filter_rows(leads(spark, d), {"customer_name": "Muñoz"}, status="Contactado").select("lead_id", "status")


@query(o.with_tables("SELECT lead_id, intencion_compra FROM con WHERE solicitud_cita IS NULL", o.CHATS, SAID, CONSOLIDATED))
def w04_undetermined(spark, d):
    return views.signal_filter(signals.consolidate(validated(spark, d).where("status = 'success'")), "solicitud_cita", "undetermined").select("lead_id", "intencion_compra")


@query(o.with_tables("SELECT conv_id FROM chats WHERE conv_id % 23 = 0 OR conv_id % 19 = 0", o.CHATS))
def j10_l06_pending(spark, d):
    e = parsed(spark, d).select("conversation_id", (F.col("status") == "success").alias("is_current"))
    return views.pending_conversations(talks(spark, d), e).select("conv_id")


@query(o.with_leads("SELECT c.conv_id, s.band FROM chats c LEFT JOIN scored s USING (lead_id) WHERE c.conv_id % 23 <> 0 AND c.conv_id % 19 <> 0", o.CHATS, SCORED))
def j11_analyzed(spark, d):
    e = parsed(spark, d).select("conversation_id", "status", (F.col("status") == "success").alias("is_current"))
    n = kept_leads(spark, d)
    s = kept_scores(spark, d, n)
    return views.analyzed_conversations(talks(spark, d), e, s, assignments(spark, d, n, s)).select("conv_id", "band")


@query(o.with_leads("SELECT concat('CONV-', lpad(concat('', conv_id), 6, '0')) AS conversation_id, c.lead_id, l.company_id, CASE WHEN conv_id % 23 = 0 OR conv_id % 19 = 0 THEN 'pending' ELSE 'success' END AS status FROM chats c LEFT JOIN leads l USING (lead_id)", o.CHATS))
def j18_batch_status(spark, d):
    e = parsed(spark, d).select("conversation_id", "status", (F.col("status") == "success").alias("is_current"))
    c = talks(spark, d)
    return views.batch_status(c, c, leads(spark, d), e)


CLAIM = f"""said AS (SELECT l.lead_id, l.sku, concat(c.brand, ' ', c.line) AS text FROM leads l JOIN catalog c ON c.sku = concat('SKU-', cast(replace(l.sku, 'SKU-', '') AS int) + 7) WHERE l.sku IS NOT NULL),
 cl AS (SELECT lead_id, sku, keys.skus[1] AS claimed_sku FROM (SELECT *, {o.model('text')} AS key FROM said) JOIN keys USING (key) WHERE len(keys.skus) = 1)"""


@query(o.with_leads("SELECT cl.lead_id, cl.sku, cl.claimed_sku, CASE WHEN a.brand = b.brand THEN 'same_brand' ELSE 'other_brand' END AS kind FROM cl JOIN catalog a ON a.sku = cl.sku JOIN catalog b ON b.sku = cl.claimed_sku WHERE cl.sku <> cl.claimed_sku", CLAIM))
def j16_model_inconsistency(spark, d):
    """Customers name another product than their lead, as text; the catalogue's cascade finds which."""
    n, c = kept_leads(spark, d), bridge.read(spark, d, "catalog")
    other = F.expr("concat('SKU-', cast(replace(sku, 'SKU-', '') as int) + 7)")
    texts = n.where("sku is not null").select("lead_id", other.alias("sku")).join(c, "sku").select("lead_id", F.concat_ws(" ", "brand", "line").alias("text"))
    return views.model_inconsistency(n, views.claimed_models(texts, c), c)


@query(o.with_leads("SELECT s.lead_id, s.band, d.advisor_id, d.priority_rank, c.conversations FROM scored s LEFT JOIN decided d USING (lead_id) LEFT JOIN (SELECT lead_id, string_agg(concat('CONV-', lpad(concat('', conv_id), 6, '0')), ',' ORDER BY conv_id) AS conversations FROM chats GROUP BY 1) c USING (lead_id)", o.ADVISORS, o.CHATS, SCORED, ASSIGNED))
def j19_x02_lead_detail(spark, d):
    n = kept_leads(spark, d)
    s = kept_scores(spark, d, n)
    return views.lead_detail(n, s, assignments(spark, d, n, s), talks(spark, d)).select("lead_id", "band", "advisor_id", "priority_rank", "conversations")


#: Up to four events a lead, unknown ones, reopenings and further closings among them.
EVENTS = """
 pairs_of(m, i) AS (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2), (4, 3)),
 numbered AS (SELECT lead_id, cast(substr(lead_id, 4) AS bigint) AS k FROM leads),
 moves AS (SELECT lead_id, i AS event_id, split_part('En proceso,Cerrado,Inventado,Contactado,Descartado,No contesta,Perdido', ',', cast((k * 5 + i * (k % 3 + 1)) % 7 + 1 AS int)) AS new_status,
  split_part('Otro,Cliente desistió,sin motivo', ',', cast((k + i) % 3 + 1 AS int)) AS reason, cast(concat('2026-09-0', cast(1 + cast(floor(i / 2) AS int) AS string)) AS timestamp) AS moved_at FROM numbered JOIN pairs_of ON m = k % 5)"""
CLOSED, KNOWN = ", ".join(map(o.quoted, f.TERMINAL)), ", ".join(map(o.quoted, (*f.OPEN, *f.TERMINAL)))


@query(o.with_leads(f"""SELECT lead_id, status, strftime(closed_at, '%Y-%m-%d') AS closed, close_reason, applied, unknown, reopenings FROM walk WHERE i = (SELECT count(*) FROM moves WHERE moves.lead_id = walk.lead_id)""", EVENTS.replace("AS string", "AS varchar"), f"""
 stepped AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY moved_at, event_id) AS n, new_status IN ({KNOWN}) AS known, new_status IN ({CLOSED}) AS ends, CASE WHEN reason IN ({', '.join(map(o.quoted, f.CLOSE_REASONS))}) THEN reason END AS good FROM moves),
 walk AS (SELECT lead_id, 0 AS i, status, NULL::TIMESTAMP AS closed_at, NULL::VARCHAR AS close_reason, 0 AS applied, 0 AS unknown, 0 AS reopenings FROM leads
  UNION ALL SELECT w.lead_id, w.i + 1, CASE WHEN ok THEN new_status ELSE w.status END, CASE WHEN ok AND ends THEN coalesce(w.closed_at, moved_at) WHEN ok THEN NULL ELSE w.closed_at END, CASE WHEN ok AND ends THEN coalesce(good, w.close_reason, 'Otro') WHEN ok THEN NULL ELSE w.close_reason END,
   applied + ok::INT, unknown + (NOT known)::INT, reopenings + (known AND NOT ok)::INT FROM (SELECT w.*, s.new_status, s.moved_at, s.known, s.ends, s.good, known AND (ends OR coalesce(w.status, '') NOT IN ({CLOSED})) AS ok FROM walk w JOIN stepped s ON s.lead_id = w.lead_id AND s.n = w.i + 1) w)"""))
def u08_f34_status_transitions(spark, d):
    n = leads(spark, d).select("lead_id", "status").withColumns({"closed_at": F.lit(None).cast("timestamp"), "close_reason": F.lit(None).cast("string")})
    n = materialize(n, "statuses")
    events = spark.sql("WITH " + EVENTS.replace("FROM leads", "FROM {n}") + " SELECT *, moved_at AS at FROM moves", n=n)
    return views.status_transitions(n, events).withColumn("closed_at", F.date_format("closed_at", "yyyy-MM-dd")).withColumnRenamed("closed_at", "closed")


@query(o.with_leads("SELECT lead_id, false AS is_current FROM decided UNION ALL SELECT lead_id, true FROM decided", *DECIDED))
def u05_snapshot_assignments(spark, d):
    a = assignments(spark, d)
    return assign.snapshot_assignments(a, a.drop("run_date", "is_current"), "2026-09-01").select("lead_id", "is_current")


@query(o.with_leads("SELECT lead_id, priority_rank, 'gone' AS side FROM decided WHERE right(lead_id, 1) = '7' UNION ALL SELECT lead_id, priority_rank + 1000000, 'new' FROM decided WHERE right(lead_id, 1) = '7'", *DECIDED))
def u06_retry_changed(spark, d):
    """A second run that ranks a tenth of the leads anew: these, before and after, and none of the others."""
    a = assignments(spark, d)
    return assign.changed(a, a.withColumn("priority_rank", F.col("priority_rank") + F.when(F.col("lead_id").endswith("7"), 1_000_000).otherwise(0))).select("lead_id", "priority_rank", "side")


@query(o.with_tables("SELECT pattern, count_if(has) AS n, count_if(has) / count(*) AS share FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, {' OR '.join(f'contains(t, {o.quoted(c)})' for c in cues)} AS has FROM txt" for n, cues in evaluate.PATTERNS.items()) + ") GROUP BY 1", o.CHATS, f"txt AS (SELECT conv_id, string_agg({o.key('text')}, ' || ' ORDER BY turn) AS t FROM chat_turns WHERE sender = 'cliente' GROUP BY conv_id)"))
def g15_pattern_exposure(spark, d):
    return evaluate.pattern_exposure(talks(spark, d))


def labelled(spark, d):
    """Gold labels and predictions of every conversation, made from its number: right, missing, invented and wrong values."""
    c = F.col("conv_id")
    chats = bridge.read(spark, d, "chats").select("conv_id")
    word = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    gold = {"intencion_compra": word(INTENTS, c), "forma_pago": word(FORMS, c), "objecion": word(OBJECTED, c), "model_interes": F.when(c % 4 != 0, "Honda XR 150"), "cuota_inicial": F.when(c % 3 != 0, 1_000_000.0 + c), "presupuesto": F.when(c % 3 == 0, 9_000_000.0), "solicitud_cita": F.when(c % 5 < 3, c % 5 == 1), "solicitud_cotizacion": c % 2 == 0}
    said = {"intencion_compra": word(INTENTS, c + F.when(c % 7 == 0, 1).otherwise(0)), "forma_pago": F.when(c % 11 == 0, "financiacion").otherwise(word(FORMS, c)), "objecion": word(OBJECTED, c + c % 2), "model_interes": F.when(c % 4 != 1, F.when(c % 6 == 0, "Otra").otherwise("HONDA  xr 150")),
            "cuota_inicial": F.when(c % 3 != 0, (1_000_000.0 + c) * F.when(c % 2 == 0, 1.05).otherwise(1.5)), "presupuesto": F.when(c % 13 == 0, 1_000_000.0 + c).when(c % 3 == 0, 9_000_000.0), "solicitud_cita": F.when(c % 3 != 0, c % 2 == 0), "solicitud_cotizacion": c % 2 == 0}
    return chats.select("conv_id", *(v.alias(n) for n, v in gold.items())), chats.select("conv_id", *(v.alias(n) for n, v in said.items()))


INTENTS, FORMS, OBJECTED = ("alta", "media", "baja"), ("contado", "financiacion", None), ("precio", None, "otra marca", "tasa")
_pick = lambda values, i: f"[{', '.join('NULL' if v is None else o.quoted(v) for v in values)}][cast(({i}) % {len(values)} + 1 AS int)]"
CONFUSION = f"""
 ab AS (SELECT conv_id AS c, {_pick(INTENTS, "conv_id")} AS a1, {_pick(INTENTS, "conv_id + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END")} AS b1, {_pick(FORMS, "conv_id")} AS a2, CASE WHEN conv_id % 11 = 0 THEN 'financiacion' ELSE {_pick(FORMS, "conv_id")} END AS b2, {_pick(OBJECTED, "conv_id")} AS a3, {_pick(OBJECTED, "conv_id + conv_id % 2")} AS b3,
   CASE WHEN conv_id % 4 <> 0 THEN 'x' END AS a4, CASE WHEN conv_id % 4 <> 1 THEN CASE WHEN conv_id % 6 = 0 THEN 'y' ELSE 'x' END END AS b4, CASE WHEN conv_id % 3 <> 0 THEN 1000000.0::DOUBLE + conv_id END AS a5, CASE WHEN conv_id % 3 <> 0 THEN (1000000.0::DOUBLE + conv_id) * CASE WHEN conv_id % 2 = 0 THEN 1.05::DOUBLE ELSE 1.5::DOUBLE END END AS b5,
   CASE WHEN conv_id % 3 = 0 THEN 9000000.0::DOUBLE END AS a6, CASE WHEN conv_id % 13 = 0 THEN 1000000.0::DOUBLE + conv_id WHEN conv_id % 3 = 0 THEN 9000000.0::DOUBLE END AS b6, coalesce(conv_id % 5 = 1, false) AS a7, CASE WHEN conv_id % 3 <> 0 THEN conv_id % 2 = 0 ELSE false END AS b7, conv_id % 2 = 0 AS a8, conv_id % 2 = 0 AS b8 FROM chats),
 confusion AS ({" UNION ALL ".join(f"SELECT c AS conv_id, '{n}' AS field, CASE WHEN a{i} IS NULL AND b{i} IS NULL THEN 'tn' WHEN a{i} IS NULL THEN 'fp' WHEN b{i} IS NULL THEN 'fn' WHEN {same.format(i=i)} THEN 'tp' ELSE 'wrong' END AS class FROM ab" for i, n, same in ((1, 'intencion_compra', 'a{i} = b{i}'), (2, 'forma_pago', 'a{i} = b{i}'), (3, 'objecion', 'a{i} = b{i}'), (4, 'model_interes', 'a{i} = b{i}'), (5, 'cuota_inicial', 'abs(a{i} - b{i}) <= greatest(1, abs(a{i}) * 0.1)'), (6, 'presupuesto', 'abs(a{i} - b{i}) <= greatest(1, abs(a{i}) * 0.1)')))}
   UNION ALL {" UNION ALL ".join(f"SELECT c, '{n}', CASE WHEN a{i} AND b{i} THEN 'tp' WHEN NOT a{i} AND NOT b{i} THEN 'tn' WHEN b{i} THEN 'fp' ELSE 'fn' END FROM ab" for i, n in ((7, 'solicitud_cita'), (8, 'solicitud_cotizacion')))})"""


@query(o.with_tables("SELECT conv_id, field, class FROM confusion", o.CHATS, CONFUSION))
def g11_field_confusion(spark, d):
    return evaluate.field_confusion(*labelled(spark, d))


@query(o.with_tables("""SELECT field, tp + fp + fn + tn AS total, tp, fp, fn, tn, wrong, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM (
 SELECT coalesce(field, 'overall') AS field, count_if(class = 'tp') AS tp, count_if(class IN ('fp', 'wrong')) AS fp, count_if(class IN ('fn', 'wrong')) AS fn, count_if(class = 'tn') AS tn, count_if(class = 'wrong') AS wrong FROM confusion GROUP BY GROUPING SETS ((field), ())) WHERE field = 'overall'""", o.CHATS, CONFUSION))
def g12_overall_metrics(spark, d):
    return evaluate.field_metrics(evaluate.field_confusion(*labelled(spark, d))).where("field = 'overall'").drop("null_rate")


@query(o.with_tables("""SELECT field, n AS total, tp, fp, fn, tn, wrong, (tp + tn)::DOUBLE / n AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM (
 SELECT field, count(*) AS n, count_if(class = 'tp') AS tp, count_if(class IN ('fp', 'wrong')) AS fp, count_if(class IN ('fn', 'wrong')) AS fn, count_if(class = 'tn') AS tn, count_if(class = 'wrong') AS wrong FROM confusion GROUP BY field)""", o.CHATS, CONFUSION))
def g12_field_metrics(spark, d):
    return evaluate.field_metrics(evaluate.field_confusion(*labelled(spark, d))).where("field <> 'overall'").drop("null_rate")


@query(o.with_tables("""SELECT conv_id, field, class AS kind FROM confusion WHERE class NOT IN ('tp', 'tn') UNION ALL SELECT c, 'presupuesto', 'down_payment_as_budget' FROM ab WHERE a5 IS NOT NULL AND a6 IS NULL AND b6 = a5
 UNION ALL SELECT c, 'forma_pago', 'down_payment_implies_financing' FROM ab WHERE a5 IS NOT NULL AND a2 IS NULL AND b2 = 'financiacion'""", o.CHATS, CONFUSION))
def g13_error_analysis(spark, d):
    return evaluate.error_analysis(*labelled(spark, d))


def tagged(spark, d):
    """Conversations with the customer's words and the number of messages."""
    return materialize(talks(spark, d).select("conv_id", F.array_join(F.transform(g.customer_texts(F.col("messages")), t.normalize_key), " || ").alias("t"), F.size("messages").alias("n")), "talks")


TAGGED = f"tagged AS (SELECT conv_id, coalesce(string_agg({o.key('text')}, ' || ' ORDER BY turn) FILTER (WHERE sender = 'cliente' AND trim(text, ' \t\n\r') <> ''), '') AS t, count(*) AS n FROM chat_turns GROUP BY conv_id)"
CASES = (("presupuesto", "presupuesto|tengo hasta"), ("cuota", "cuota"), ("financiacion", "financ|credito"), ("solicitud_cita", "cita|agendar|visitar|voy"), ("cotizacion", "cotiz"), ("objecion", "caro|descuento|otra marca"), ("ambigua", "averiguando|mirando"))
FORCED = (58, 4)


def _has(cues) -> str:
    return " OR ".join(f"contains(t, {o.quoted(c)})" for c in cues)


def _taken(steps, start="SELECT NULL::BIGINT AS conv_id, NULL AS label WHERE false", order="conv_id") -> tuple[str, str]:
    """CTEs that take rows of `tagged` step by step, and the last one's name."""
    out = [f"s0 AS MATERIALIZED ({start})"]
    for i, (label, predicate, quota) in enumerate(steps, 1):
        out.append(f"s{i} AS MATERIALIZED (SELECT conv_id, label FROM s{i - 1} UNION ALL (SELECT conv_id, '{label}' FROM tagged WHERE ({predicate}) AND conv_id NOT IN (SELECT conv_id FROM s{i - 1}) ORDER BY {order} LIMIT {quota}))")
    return ",\n ".join(out), f"s{len(steps)}"


QUOTA_SQL, _LAST = _taken([("forced", f"conv_id IN {FORCED}", len(FORCED)), *((n, {"multi_model": "false", "short": "n <= 4", "long": "n >= 8"}.get(n) or _has(cues), q) for n, cues, q in evaluate.QUOTAS)])


@query(o.with_tables(f"SELECT * FROM (SELECT conv_id, label FROM {_LAST} UNION ALL (SELECT conv_id, 'fill' FROM numbered, wanted WHERE missing > 0 AND i % greatest(1, total // greatest(1, missing)) = 0 AND conv_id NOT IN (SELECT conv_id FROM {_LAST}) ORDER BY conv_id LIMIT (SELECT greatest(0, missing) FROM wanted))) ORDER BY conv_id LIMIT 110",
                     o.CHATS, TAGGED, QUOTA_SQL, "numbered AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM tagged)", f"wanted AS (SELECT 110 - (SELECT count(*) FROM {_LAST}) AS missing, (SELECT count(*) FROM tagged) AS total)"))
def k07_stratified_sample(spark, d):
    """Forced conversations, eleven quotas by tag in order, first by id, then every n-th: a sampling operator."""
    x = tagged(spark, d)
    return evaluate.stratified_sample(x, evaluate.quota_steps(F.col("t"), F.col("n")), "conv_id", 110, FORCED).select("conv_id", "label")


CASE_SQL, _CASES = _taken([(n, _has(c.split("|")), 1) for n, c in CASES])


@query(o.with_tables(f"SELECT conv_id, label FROM {_CASES} UNION ALL (SELECT conv_id, 'adicional' FROM tagged WHERE conv_id NOT IN (SELECT conv_id FROM {_CASES}) ORDER BY n, conv_id LIMIT (SELECT 10 - count(*) FROM {_CASES}))", o.CHATS, TAGGED, CASE_SQL))
def k08_select_cases(spark, d):
    """One conversation for each case, then the shortest: a sampling operator."""
    return evaluate.select_cases(tagged(spark, d), [(n, F.col("t").rlike(c)) for n, c in CASES], "conv_id", [F.col("conv_id")], F.col("n")).select("conv_id", "label")


def _covered() -> str:
    out = ["c0 AS MATERIALIZED (SELECT conv_id, 'must' AS label FROM tagged WHERE conv_id = 58)"]
    for i, (n, c) in enumerate(CASES, 1):
        p = _has(c.split("|"))
        out.append(f"c{i} AS MATERIALIZED (SELECT conv_id, label FROM c{i - 1} UNION ALL (SELECT conv_id, '{n}' FROM tagged WHERE ({p}) AND conv_id NOT IN (SELECT conv_id FROM c{i - 1}) AND NOT EXISTS (SELECT 1 FROM tagged JOIN c{i - 1} USING (conv_id) WHERE {p}) ORDER BY conv_id LIMIT 1))")
    return ",\n ".join(out)


@query(o.with_tables(f"SELECT conv_id, label FROM c{len(CASES)} UNION ALL (SELECT conv_id, 'fill' FROM tagged WHERE conv_id NOT IN (SELECT conv_id FROM c{len(CASES)}) ORDER BY conv_id LIMIT (SELECT 10 - count(*) FROM c{len(CASES)}))", o.CHATS, TAGGED, _covered()))
def k09_cover_cases(spark, d):
    """Conversations that cover all cases, then the first others: a sampling operator."""
    return evaluate.cover_cases(tagged(spark, d), [(n, F.col("t").rlike(c)) for n, c in CASES], "conv_id", 58).select("conv_id", "label")


DATED = "dated AS (SELECT conv_id, concat('CONV-', lpad(concat('', conv_id), 6, '0')) AS conversation_id, lead_id, CASE WHEN conv_id % 7 <> 0 THEN DATE '2026-01-01' + cast(conv_id % 90 AS int) END AS started_at, DATE '2026-05-01' + cast(conv_id % 30 AS int) AS created_at FROM chats)"


def dated(spark, d):
    c = F.col("conv_id").cast("int")
    day = lambda first, n: F.date_add(F.lit(first).cast("date"), c % n)
    return talks(spark, d).select("conv_id", "conversation_id", "lead_id", F.when(c % 7 != 0, day("2026-01-01", 90)).alias("started_at"), day("2026-05-01", 30).alias("created_at"))


@query(o.with_leads("SELECT w.c AS canonical_lead_id, lead_id, conversation_id, started_at FROM dated JOIN w14 w ON w.node = lead_id", PAIRS, WEAK_PAIRS, EDGES, CLUSTERS, o.CHATS, DATED))
def j17_cluster_conversations(spark, d):
    return identity.cluster_conversations(identity.resolve_identities(leads(spark, d), rules=False)[1], dated(spark, d)).select("canonical_lead_id", "lead_id", "conversation_id", "started_at")


@query(o.with_tables("SELECT conversation_id, created_at, 3 AS page, cast(ceil((SELECT count(*) FROM dated) / 20.0) AS int) AS pages FROM dated ORDER BY created_at DESC, conversation_id LIMIT 20 OFFSET 40", o.CHATS, DATED))
def l02_l03_page(spark, d):
    """The third page of the analysed conversations, latest first: a paging operator."""
    rows, number, _, pages = views.page(dated(spark, d), views.analyzed_order("analyzed_desc"), 3, 20)
    return rows.select("conversation_id", "created_at", F.lit(number).alias("page"), F.lit(pages).alias("pages"))


@query(o.with_tables("SELECT conversation_id, created_at FROM dated WHERE created_at < DATE '2026-05-20' OR (created_at = DATE '2026-05-20' AND conversation_id > 'CONV-000100') ORDER BY created_at DESC, conversation_id LIMIT 20", o.CHATS, DATED))
def l02_page_after(spark, d):
    """The page after a row, by key: a paging operator."""
    import datetime

    return views.page_after(dated(spark, d), [("created_at", True), ("conversation_id", False)], (datetime.date(2026, 5, 20), "CONV-000100"), 20).select("conversation_id", "created_at")


@query(o.with_leads("""SELECT lead_id, sha256('{"company_id":' || coalesce(to_json(company_id), 'null') || ',"first_contact":' || CASE WHEN first_contact_at IS NULL THEN 'null' ELSE '1' END || ',"status":' || coalesce(to_json(status), 'null') || '}') AS digest FROM leads"""))
def a07_content_hash(spark, d):
    n = leads(spark, d).withColumn("first_contact", F.when(F.col("first_contact_at").isNotNull(), 1))
    return n.select("lead_id", ingest.content_hash("status", "company_id", "first_contact").alias("digest"))


# jobs

def _inputs(spark, d):
    return {n: bridge.read(spark, d, n) for n in ("raw_leads", "org", "catalog", "advisors")}


@query("SELECT unnest(['leads', 'conversations', 'members', 'signals', 'scores', 'assignments']) AS stage, 'ok' AS status")
def u09_run_log(spark, d):
    i = _inputs(spark, d)
    _, log = jobs.lead_pipeline(spark, i["raw_leads"], i["org"], i["catalog"], i["advisors"], talks(spark, d).select("conversation_id", "lead_id", "messages"), params=PARAMS)
    return log.select("stage", "status")


@query(o.with_tables("SELECT conversation_id, lead_id FROM (SELECT concat('CONV-', lpad(concat('', conv_id), 6, '0')) AS conversation_id, lead_id FROM chats) WHERE lead_id NOT IN (SELECT lead_id FROM raw_leads)", o.RAW, o.CHATS))
def k11_audit_orphans(spark, d):
    i = _inputs(spark, d)
    return jobs.quality_audit(i["raw_leads"], i["org"], i["catalog"], i["advisors"], history(spark, d), talks(spark, d))["orphans"]


# labels, reasons and order

@query(o.with_leads("SELECT lead_id, CASE WHEN list_price IS NOT NULL THEN 2 ELSE 1 END + 1 + CASE WHEN registration_at IS NULL THEN 1 ELSE 0 END + CASE WHEN registration_at IS NOT NULL AND first_contact_at IS NULL AND days >= 1 THEN 1 ELSE 0 END + CASE WHEN registration_at IS NOT NULL AND status = 'Sin gestión' AND days >= 2 AND u < 90 THEN 1 ELSE 0 END AS reasons, "
                    "CASE WHEN status IN ('Sin gestión', 'No contesta', 'Cotización enviada', 'Contactado', 'En proceso', 'Descartado') THEN 'Estado operativo' ELSE 'Estado de gestión desconocido' END AS state FROM scored", SCORED))
def f35_w06_l05_reasons(spark, d):
    s = views.trim_lists(scores(spark, d))
    r = views.priority_reasons(F.col("reasons"))
    state = F.filter("reasons", lambda x: x["code"].startswith("ESTADO_"))
    return s.select("lead_id", F.size(r).alias("reasons"), labels.reason_label(F.get(state, F.lit(0))["code"]).alias("state"))


@query("SELECT conv_id, turn, CASE role WHEN 'cliente' THEN 'Cliente' WHEN 'asesor' THEN 'Asesor' ELSE role END AS sender FROM conversations")
def f35_sender_label(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", labels.sender_label(F.col("role")).alias("sender"))


@query(o.with_tables("SELECT conv_id, sha256('{\"prompt_version\":\"v2\",\"schema_version\":\"v1\",\"transcript\":' || to_json(string_agg(trim(sender) || ': ' || trim(text, ' \t\n\r'), '\n' ORDER BY turn)) || '}') AS input_hash FROM chat_turns WHERE trim(text, ' \t\n\r') <> '' GROUP BY conv_id", o.CHATS))
def f30_input_hash(spark, d):
    return talks(spark, d).select("conv_id", g.input_hash(g.build_transcript(F.col("messages")), "v2", "v1").alias("input_hash"))


@query(o.with_tables("SELECT conv_id, count_if(sender = 'cliente' AND trim(text, ' \t\n\r') <> '') AS customer, count_if(sender <> 'cliente' AND trim(text, ' \t\n\r') <> '') AS others FROM chat_turns GROUP BY conv_id", o.CHATS))
def f31_split_transcript(spark, d):
    return talks(spark, d).select("conv_id", F.size(g.customer_texts(F.col("messages"))).alias("customer"), F.size(g.other_texts(F.col("messages"))).alias("others"))


@query(o.with_tables("SELECT conv_id, good AND (amount_reason IS NOT NULL) AS changed FROM paid WHERE good", o.CHATS, SAID))
def u04_revalidate(spark, d):
    p = parsed(spark, d).where("status = 'success'")
    stored = p.select("conv_id", "conversation_id", *(F.col(f"payload.{c}").alias(c) for n in g.FIELDS for c in (n, f"{n}_evidence")))
    return signals.revalidate(stored, talks(spark, d)).select("conv_id", "changed")
