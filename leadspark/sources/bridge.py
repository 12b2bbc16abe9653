"""The lead domain as a projection of the test tables: one text for Spark SQL and for the SQL that checks it.

Leads are orders with deliberate dirt; companies, branches, advisors, catalogue and history come from region, nation,
supplier, part and lineitem; chats from conversations. Everything is derived row by row with equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {"ts": "cast(o_orderdate AS timestamp) + make_dt_interval(0, cast(o_orderkey % 24 AS int), cast(o_orderkey % 60 AS int), 0)", "fc": "ts + make_dt_interval(cast(o_orderkey % 5 AS int) - 1, 0, 0, 0)",
              "fmt": "date_format({0}, '{1}')", "iso_t": "yyyy-MM-dd''T''HH:mm:ss", "iso_s": "yyyy-MM-dd HH:mm:ss", "iso_d": "yyyy-MM-dd", "dmy": "dd/MM/yyyy HH:mm", "mdy": "MM/dd/yyyy HH:mm", "dash": "dd-MM-yyyy HH:mm",
              "copies": "explode(CASE WHEN k % 500 = 0 THEN array(k, k + 1000000000) ELSE array(k) END)"},
    "duckdb": {"ts": "o_orderdate + to_hours(cast(o_orderkey % 24 AS int)) + to_minutes(cast(o_orderkey % 60 AS int))", "fc": "ts + to_days(cast(o_orderkey % 5 AS int) - 1)",
               "fmt": "strftime({0}, '{1}')", "iso_t": "%Y-%m-%dT%H:%M:%S", "iso_s": "%Y-%m-%d %H:%M:%S", "iso_d": "%Y-%m-%d", "dmy": "%d/%m/%Y %H:%M", "mdy": "%m/%d/%Y %H:%M", "dash": "%d-%m-%Y %H:%M",
               "copies": "unnest(CASE WHEN k % 500 = 0 THEN [k, k + 1000000000] ELSE [k] END)"},
}
FIRST = "José,María,Andrés,Sofía,Raúl,Lucía,Tomás,Inés,Óscar,Zoë"
LAST = "Muñoz,Pérez,Gómez,Núñez,López,Díaz,Ríos,Peña,Ávila,Suárez"
CITY = "Bogotá,Medellín,Bello,Montería,Soacha,Soledad,Cartagena,Barranquilla,Santa Marta,Itagüí,Rionegro,Cali"
ALIAS = "BOGOTA D.C.,MEDELLIN,bello,MONTERIA,soacha,SOLEDAD,cartagena de indias,b/quilla,sta marta,ITAGUI,rio negro,CALI"
CHANNEL = "WhatsApp,WHATSAPP,whatsapp,Meta Ads,META ADS,meta ads,Formulario Web,FORMULARIO WEB,"
STATUS = "Contactado,contactado,Sin gestión,SIN GESTION,sin gestion,No contesta,no contesta,Cotización enviada,En proceso,Descartado,Otro estado"
CUES = ("Tengo 2,5 millones de inicial", "la quiero financiada", "me la cotiza por favor", "voy esta tarde", "no tengo inicial", "esta muy caro", "ok",
        "me interesa mucho la quiero comprar", "solo estoy averiguando", "mi presupuesto es de 18 millones", "cuota de $480.000", "pago de contado")

RAW = """
raw_base AS (
 SELECT o_orderkey AS k, c_custkey * 4 + o_orderkey % 4 AS pid, c_nationkey AS nk, n_regionkey AS rk, {ts} AS ts, o_orderkey, part.p_brand AS brand, concat(part.p_name, ' ', part.p_size) AS line
 FROM (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS pk FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON part.p_partkey = pk),
raw_more AS (SELECT *, concat('3', lpad(concat('', pid), 9, '0')) AS ph, {fc} AS fc,
 CASE WHEN k % 13 = 0 THEN 'Zed Quux' ELSE concat(split_part('{first}', ',', cast(pid % 10 + 1 AS int)), ' ', split_part('{last}', ',', cast(floor(pid / 10) % 10 + 1 AS int))) END AS person FROM raw_base),
raw_once AS (SELECT k,
 concat('LD-', lpad(concat('', k), 7, '0')) AS lead_id,
 CASE WHEN k % 1009 = 0 THEN '2026-08-33' WHEN k % 6 = 0 THEN {ts_t} WHEN k % 6 = 1 THEN {ts_s} WHEN k % 6 = 2 THEN {ts_d} WHEN k % 6 = 3 THEN {ts_dmy} WHEN k % 6 = 4 THEN {ts_mdy} ELSE {ts_dash} END AS fecha_registro,
 split_part('{channel}', ',', cast(k % 9 + 1 AS int)) AS canal,
 CASE WHEN k % 997 = 0 THEN 'EMP-99' ELSE concat('EMP-', lpad(concat('', rk + 1), 2, '0')) END AS empresa_id,
 concat('PV-', lpad(concat('', nk + 1), 3, '0')) AS punto_venta_id,
 CASE cast(floor(k / 4) % 4 AS int) WHEN 0 THEN person WHEN 1 THEN upper(person) WHEN 2 THEN lower(person) ELSE concat('  ', replace(person, ' ', '   '), ' ') END AS nombre_cliente,
 CASE WHEN k % 601 = 0 THEN '300123' WHEN k % 6 = 0 THEN ph WHEN k % 6 = 1 THEN concat('+57 ', substr(ph, 1, 3), ' ', substr(ph, 4)) WHEN k % 6 = 2 THEN concat('57', ph)
  WHEN k % 6 = 3 THEN concat('(', substr(ph, 1, 3), ') ', substr(ph, 4, 3), '-', substr(ph, 7)) WHEN k % 6 = 4 THEN concat(substr(ph, 1, 3), '-', substr(ph, 4, 3), '-', substr(ph, 7)) ELSE concat('+57', ph) END AS telefono,
 CASE WHEN k % 701 = 0 THEN 'not-an-email' WHEN k % 3 = 0 THEN '' WHEN k % 5 = 0 THEN concat('  USER', pid, '@MAIL.CO ') ELSE concat('user', pid, '@mail.co') END AS email,
 CASE WHEN k % 19 = 0 THEN '' WHEN k % 211 = 0 THEN 'Ciudad X' WHEN k % 3 = 0 THEN split_part('{alias}', ',', cast(nk % 12 + 1 AS int)) ELSE split_part('{city}', ',', cast(nk % 12 + 1 AS int)) END AS ciudad,
 CASE cast(k % 8 AS int) WHEN 0 THEN concat(brand, ' ', line) WHEN 1 THEN upper(concat(brand, ' ', line)) WHEN 2 THEN line WHEN 3 THEN brand WHEN 4 THEN concat(brand, ' ', line, ' 2026') WHEN 5 THEN '' WHEN 6 THEN concat(replace(brand, 'Brand', 'Brnd'), ' ', line) ELSE 'zzz nada' END AS modelo_interes_texto,
 split_part('{status}', ',', cast(k % 11 + 1 AS int)) AS estado_gestion,
 CASE WHEN k % 3 = 0 THEN '' WHEN k % 2 = 0 THEN {fc_s} ELSE {fc_dmy} END AS fecha_primer_contacto,
 CASE WHEN k % 4 = 0 THEN '' ELSE concat('C', k % 5) END AS campania FROM raw_more),
raw_leads AS (SELECT {copies} AS row_number, raw_once.* FROM raw_once)"""

ORG = """
org AS (SELECT concat('PV-', lpad(concat('', n_nationkey + 1), 3, '0')) AS point_of_sale_id, concat('EMP-', lpad(concat('', n_regionkey + 1), 2, '0')) AS company_id, n_nationkey FROM nation)"""

ADVISORS = """
advisors AS (SELECT concat('AS-', lpad(concat('', s_suppkey), 5, '0')) AS advisor_id, s_name AS name, org.point_of_sale_id, org.company_id, cast(20 + s_suppkey % 61 AS int) AS daily_capacity, s_suppkey % 20 <> 0 AS active
 FROM supplier JOIN org ON s_nationkey = n_nationkey)"""

CATALOG = """
catalog AS (SELECT concat('SKU-', p_partkey) AS sku, p_brand AS brand, concat(p_name, ' ', p_size) AS line, p_retailprice AS list_price, p_type AS segment, p_size AS engine_cc FROM part)"""

CHATS = """
chat_turns AS (
 SELECT conv_id, turn, CASE role WHEN 'user' THEN 'cliente' WHEN 'assistant' THEN 'asesor' ELSE role END AS sender, text FROM conversations
 UNION ALL SELECT DISTINCT conv_id, 100, 'cliente', split_part('{cues}', '|', cast(conv_id % 12 + 1 AS int)) FROM conversations),
chats AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 17 = 0 THEN concat('LD-9', lpad(concat('', conv_id), 6, '0')) ELSE concat('LD-', lpad(concat('', 13 * (conv_id - CASE WHEN conv_id % 10 = 1 THEN 1 ELSE 0 END)), 7, '0')) END AS lead_id FROM conversations)"""

HISTORY = """
history AS (SELECT concat('HX-', l_orderkey, '-', l_linenumber) AS lead_id, concat('EMP-', lpad(concat('', n_regionkey + 1), 2, '0')) AS company_id,
 split_part('WhatsApp,Meta Ads,Formulario Web', ',', cast(l_orderkey % 3 + 1 AS int)) AS channel, concat(p_brand, ' ', p_name, ' ', p_size) AS model, p_retailprice AS price, p_partkey,
 CASE l_returnflag WHEN 'A' THEN 'Cerrado' WHEN 'R' THEN 'Perdido' ELSE 'Sin gestión' END AS outcome,
 CASE WHEN l_returnflag IN ('A', 'R') THEN cast(1 + l_linenumber % 5 AS int) ELSE 0 END AS contacts,
 CASE WHEN l_returnflag IN ('A', 'R') THEN concat('', l_orderkey % 72) ELSE '' END AS hours
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def text(part: str, dialect: str) -> str:
    """One of the texts above in a dialect."""
    d = DIALECT[dialect]
    f = lambda column, kind: d["fmt"].format(column, d[kind])
    return part.format(ts=d["ts"], fc=d["fc"], copies=d["copies"], first=FIRST, last=LAST, channel=CHANNEL, alias=ALIAS, city=CITY, status=STATUS, cues="|".join(CUES), ts_t=f("ts", "iso_t"), ts_s=f("ts", "iso_s"), ts_d=f("ts", "iso_d"),
                       ts_dmy=f("ts", "dmy"), ts_mdy=f("ts", "mdy"), ts_dash=f("ts", "dash"), fc_s=f("fc", "iso_s"), fc_dmy=f("fc", "dmy"))


TABLES = {"raw_leads": (RAW,), "org": (ORG,), "advisors": (ORG, ADVISORS), "catalog": (CATALOG,), "chat_turns": (CHATS,), "chats": (CHATS,), "history": (HISTORY,)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lead-domain table from the Parquet tables in sf_dir. Filters and projections on it reach their scans."""
    base = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations")
    body = ", ".join(text(p, "spark").strip() for p in TABLES[name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in base if f" {t}" in body}
    names = {t: f"bridge_{t}" for t in used}
    for t, df in used.items():
        df.createOrReplaceTempView(names[t])
    views = ", ".join(f"{t} AS (SELECT * FROM {names[t]})" for t in used)
    return spark.sql(f"WITH {views}, {body} SELECT * FROM {name}")
