"""SQL texts that check the registered queries, built from small pieces; for DuckDB."""

from __future__ import annotations

from leadspark.functions import fields as f
from leadspark.sources import bridge


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def cases(expression: str, table: dict[str, str], default: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


def key(x: str) -> str:
    return f"coalesce(regexp_replace(strip_accents(lower(trim({x}, ' \t\n\r'))), '\\s+', ' ', 'g'), '')"


def display(x: str) -> str:
    return f"nullif(regexp_replace(trim({x}, ' \t\n\r'), '\\s+', ' ', 'g'), '')"


def match_key(x: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^\\pL\\pM\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def model(x: str) -> str:
    text = f"trim(regexp_replace(regexp_replace(regexp_replace({key(x)}, '\\b(19|20)[0-9]{{2}}\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    words = f"array_to_string(list_transform(string_split({text}, ' '), lambda t: {cases('t', f.BRAND_TYPOS, 't')}), ' ')"
    return f"regexp_replace(replace({words}, 'a k t', 'akt'), '\\br 3\\b', 'r3', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def phone(x: str) -> str:
    d = digits(x)
    return f"CASE WHEN length({d}) IN (11, 12) AND starts_with({d}, '57') THEN substr({d}, 3) ELSE nullif({d}, '') END"


def channel(x: str) -> str:
    return cases(key(x), f.CHANNELS, f"CASE WHEN {key(x)} = '' THEN NULL WHEN contains({key(x)}, 'whats') THEN 'WhatsApp' WHEN contains({key(x)}, 'meta') THEN 'Meta Ads' WHEN contains({key(x)}, 'form') THEN 'Formulario Web' ELSE trim({x}) END")


def status(x: str) -> str:
    return f"CASE WHEN {key(x)} <> '' THEN {cases(key(x), f.STATUSES, f'trim({x})')} END"


def city(x: str) -> str:
    return cases(cases(key(x), f.CITY_ALIASES, key(x)), f.CITIES, "NULL")


def date_format(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    part = lambda m, i: f"try_cast(regexp_extract({t}, '^([0-9]{{1,2}}){m}([0-9]{{1,2}}){m}', {i}) AS int)"
    shape = lambda m: f"regexp_matches({t}, '^[0-9]{{1,2}}{m}[0-9]{{1,2}}{m}[0-9]{{4}}(\\s+[0-9]{{1,2}}:[0-9]{{2}})?$')"
    return (f"CASE WHEN {t} = '' THEN 'vacio' WHEN try_strptime({t}, '%Y-%m-%dT%H:%M:%S') IS NOT NULL THEN 'ISO_T' WHEN try_strptime({t}, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 'ISO_SPACE' WHEN try_strptime({t}, '%Y-%m-%d') IS NOT NULL THEN 'ISO_DATE' "
            f"WHEN {shape('/')} THEN CASE WHEN {part('/', 1)} > 12 THEN 'DD/MM/YYYY' WHEN {part('/', 2)} > 12 THEN 'MM/DD/YYYY' ELSE '{f.SLASH}' END WHEN {shape('-')} THEN '{f.DASH}' ELSE 'desconocido' END")


def date_ambiguous(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    part = lambda i: f"try_cast(regexp_extract({t}, '^([0-9]{{1,2}})-([0-9]{{1,2}})-', {i}) AS int)"
    return f"CASE {date_format(x)} WHEN '{f.SLASH}' THEN true WHEN '{f.DASH}' THEN {part(1)} <= 12 AND {part(2)} <= 12 ELSE false END"


def date_parsed(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    some = lambda p: f"coalesce(try_strptime({t}, '{p} %H:%M'), try_strptime({t}, '{p}'))"
    return (f"CASE {date_format(x)} WHEN 'ISO_T' THEN try_strptime({t}, '%Y-%m-%dT%H:%M:%S') WHEN 'ISO_SPACE' THEN try_strptime({t}, '%Y-%m-%d %H:%M:%S') WHEN 'ISO_DATE' THEN try_strptime({t}, '%Y-%m-%d') "
            f"WHEN 'DD/MM/YYYY' THEN {some('%d/%m/%Y')} WHEN 'MM/DD/YYYY' THEN {some('%m/%d/%Y')} WHEN '{f.SLASH}' THEN {some('%d/%m/%Y')} WHEN '{f.DASH}' THEN {some('%d-%m-%Y')} END")


def trusted(x: str) -> str:
    return f"CASE WHEN {date_format(x)} <> '{f.SLASH}' THEN {date_parsed(x)} END"


RAW, ORG, ADVISORS, CATALOG, CHATS, HISTORY = (bridge.text(x, "duckdb").strip() for x in (bridge.RAW, bridge.ORG, bridge.ADVISORS, bridge.CATALOG, bridge.CHATS, bridge.HISTORY))

MATCH = f"""
 k0 AS (SELECT sku, unnest([{model("brand || ' ' || line")}, {model("line")}]) AS key FROM catalog),
 keys AS (SELECT key, list_sort(list(DISTINCT sku)) AS skus FROM k0 WHERE key <> '' GROUP BY key),
 brands AS (SELECT {model("brand")} AS key, list_sort(list(DISTINCT sku)) AS skus FROM catalog GROUP BY 1)"""


def matched(texts: str, fuzzy: bool = True) -> str:
    """m AS (key, match_type, skus, score) for a relation `texts` with distinct keys.

    The similarity step: a key without one character has a ratio that no key can exceed, 2 n / (2 n + 1) for n
    characters; for other texts the ratio of each key is counted: the longest common run, the first of equal ones, and
    the same again left and right of it.
    """
    common = "list_max(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j: {'n': len(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda n: substr(t, i, n) = substr(k, j, n))), 'i': -i, 'j': -j}))))"
    return f"""
 exact AS (SELECT t.key, k.skus AS e, b.skus AS b FROM {texts} t LEFT JOIN keys k USING (key) LEFT JOIN brands b USING (key)),
 pre AS (SELECT x.key, list_sort(list_distinct(flatten(list(k.skus)))) AS p FROM exact x JOIN keys k ON starts_with(k.key, x.key) OR starts_with(x.key, k.key) WHERE x.e IS NULL AND x.b IS NULL GROUP BY x.key),
 near AS (SELECT x.key, list_sort(list_distinct(flatten(list(c.skus)))) AS f FROM exact x LEFT JOIN pre USING (key) JOIN (SELECT skus, unnest(list_transform(range(1, length(key) + 1), lambda i: substr(key, 1, i - 1) || substr(key, i + 1))) AS cut FROM keys) c ON c.cut = x.key
   WHERE x.e IS NULL AND x.b IS NULL AND p IS NULL AND {str(fuzzy).lower()} GROUP BY x.key),
 runs AS (SELECT *, {common} AS m FROM (SELECT x.key AS t, k.key AS k, 1 AS a0, length(x.key) + 1 AS a1, 1 AS b0, length(k.key) + 1 AS b1 FROM exact x LEFT JOIN pre USING (key) LEFT JOIN near USING (key), keys k WHERE e IS NULL AND b IS NULL AND p IS NULL AND f IS NULL AND {str(fuzzy).lower()})
   UNION ALL SELECT *, {common} FROM (SELECT t, k, x.a0, x.a1, x.b0, x.b1 FROM (SELECT t, k, unnest([{{'a0': a0, 'a1': -m.i, 'b0': b0, 'b1': -m.j}}, {{'a0': m.n - m.i, 'a1': a1, 'b0': m.n - m.j, 'b1': b1}}]) AS x FROM runs WHERE m.n > 0)) WHERE a0 < a1 AND b0 < b1),
 best AS (SELECT t AS key, max(r) AS r FROM (SELECT t, k, 2.0::DOUBLE * coalesce(sum(m.n), 0) / (length(t) + length(k)) AS r FROM runs GROUP BY t, k) GROUP BY t),
 m AS (SELECT key, CASE WHEN len(e) = 1 THEN 'directo_unico' WHEN len(e) > 1 THEN 'directo_ambiguo' WHEN b IS NOT NULL THEN 'solo_marca' WHEN len(p) = 1 THEN 'prefijo_unico' WHEN len(p) > 1 THEN 'prefijo_ambiguo' WHEN len(f) = 1 THEN 'fuzzy' ELSE 'sin_match' END AS match_type,
   coalesce(e, b, p, f) AS skus, CASE WHEN f IS NOT NULL THEN floor(20000.0::DOUBLE * length(key) / (2 * length(key) + 1) + 0.5) / 10000 ELSE floor(10000 * r + 0.5) / 10000 END AS score FROM exact LEFT JOIN pre USING (key) LEFT JOIN near USING (key) LEFT JOIN best USING (key))"""


FIRST = """
 first_rows AS (SELECT *, count(*) OVER (PARTITION BY lead_id) AS n_rows FROM raw_leads QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY row_number) = 1)"""

def leads(fuzzy: bool = True) -> str:
    return f"""
 n0 AS (SELECT r.lead_id, r.row_number, r.empresa_id AS company_id, r.punto_venta_id AS point_of_sale_id, {channel('canal')} AS channel, {status('estado_gestion')} AS status, {display('nombre_cliente')} AS customer_name,
   CASE WHEN length({phone('telefono')}) = 10 THEN {phone('telefono')} END AS phone_normalized,
   CASE WHEN regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN lower(trim(email)) END AS email_normalized, nullif(trim(ciudad), '') AS city_raw, {city('ciudad')} AS city_normalized, nullif(trim(modelo_interes_texto), '') AS model_text_raw,
   {model('modelo_interes_texto')} AS key, {date_format('fecha_registro')} AS reg_format, {date_ambiguous('fecha_registro')} AS reg_ambiguous, {date_format('fecha_primer_contacto')} AS cont_format, {date_ambiguous('fecha_primer_contacto')} AS cont_ambiguous,
   {trusted('fecha_registro')} AS registration_at, {trusted('fecha_primer_contacto')} AS first_contact_at, nullif(trim(campania), '') AS campaign, fecha_primer_contacto, n_rows
   FROM first_rows r JOIN org o ON o.point_of_sale_id = r.punto_venta_id AND o.company_id = r.empresa_id),
 texts AS (SELECT DISTINCT key FROM n0 WHERE key <> ''),{matched('texts', fuzzy)},
 n1 AS (SELECT n0.*, CASE WHEN match_type IN ('directo_unico', 'prefijo_unico', 'fuzzy') THEN skus[1] END AS sku, score AS match_score, coalesce(match_type, CASE WHEN model_text_raw IS NULL THEN 'vacio' ELSE 'sin_match' END) AS match_type,
   CASE WHEN match_type IN ('directo_ambiguo', 'solo_marca', 'prefijo_ambiguo') THEN array_to_string(skus, '|') ELSE '' END AS candidates FROM n0 LEFT JOIN m USING (key)),
 leads AS (SELECT *, CASE WHEN match_type = 'vacio' THEN 'empty' WHEN match_type = 'sin_match' THEN 'unmatched' WHEN match_type IN ('directo_unico', 'prefijo_unico', 'fuzzy') THEN 'matched' ELSE 'ambiguous' END AS match_state,
   array_to_string(list_filter([CASE WHEN reg_format = '{f.SLASH}' THEN 'ambiguous_registration_date' END, CASE WHEN cont_format = '{f.SLASH}' THEN 'ambiguous_first_contact_date' END, CASE WHEN reg_format = 'desconocido' THEN 'unknown_registration_date' END,
     CASE WHEN cont_format = 'desconocido' THEN 'unknown_first_contact_date' END, CASE WHEN NOT reg_ambiguous AND NOT cont_ambiguous AND first_contact_at < registration_at THEN 'first_contact_before_registration' END,
     CASE WHEN status <> 'Sin gestión' AND trim(coalesce(fecha_primer_contacto, '')) = '' THEN 'managed_without_first_contact' END, CASE WHEN phone_normalized IS NULL THEN 'invalid_phone' END, CASE WHEN city_raw IS NULL THEN 'missing_city' END,
     CASE WHEN city_raw IS NOT NULL AND city_normalized IS NULL THEN 'unmatched_city' END, CASE WHEN match_type IN ('directo_ambiguo', 'solo_marca', 'prefijo_ambiguo') THEN 'ambiguous_model' END, CASE WHEN match_type = 'sin_match' THEN 'unmatched_model' END,
     CASE WHEN channel IS NULL THEN 'missing_channel' END, CASE WHEN n_rows > 1 THEN 'duplicate_lead_id' END], lambda x: x IS NOT NULL), ',') AS anomalies FROM n1)"""


def with_leads(body: str, *more: str, fuzzy: bool = True) -> str:
    """body over leads (normalised), raw_leads, org, catalog and what `more` defines."""
    return "WITH RECURSIVE " + ", ".join([RAW, ORG, CATALOG, FIRST.strip(), MATCH.strip(), leads(fuzzy).strip(), *(m.strip() for m in more)]) + "\n" + body


def with_tables(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + "\n" + body


def half_up(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def clamp(x: str) -> str:
    return f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {half_up(x)}))"


def last_place(x: str, cues: list[str]) -> str:
    """Where the rightmost of cues begins in x; null without any."""
    some = ", ".join(f"CASE WHEN contains({x}, {quoted(c)}) THEN length({x}) - instr(reverse({x}), {quoted(c[::-1])}) - {len(c)} + 1 END" for c in cues)
    return f"list_max([{some}])"


def has(x: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(c)})" for c in cues) + ")"
