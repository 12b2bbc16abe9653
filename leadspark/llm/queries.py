"""Queries that apply the operators to whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadspark.llm import decontaminate, html_text, jaccard, language_model, mixing, pii, quality, secrets, spelling, structure, substrings, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "repeats")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS tie, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
       FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, cap / w <= level AS capped FROM l),
 t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
       / (sum(w) OVER () - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ()) * w) END AS target FROM c),
 u AS (SELECT *, CAST(floor(CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END) AS INTEGER) AS whole FROM t),
 r AS (SELECT doc_id, size, source_size, target, whole,
       coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id NULLS FIRST, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(repeats * size AS BIGINT) AS taken, repeats FROM (
 SELECT *, whole + CASE WHEN source_size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS repeats FROM r)
"""

def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id AS id, false AS item, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
 w AS (SELECT id, item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
 s AS (SELECT id, item, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
 e AS (SELECT id, item, len(s) AS n, unnest(s) AS h FROM s)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(i.n) AS BIGINT) AS n_item, count(*) AS n_shared
FROM e d JOIN e i ON d.h = i.h AND i.item AND NOT d.item GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.report(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM d),
 n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
 e AS (SELECT doc_id, unnest(s) AS h FROM s),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 pairs AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY ALL
"""


#: crc32 of a list of bytes; `bits` is the table of all bytes' remainders.
CRC32_SQL = r"""
WITH RECURSIVE step AS (SELECT i AS b, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
 bits AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
"""

OP11_SQL = CRC32_SQL + r"""
 runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
 own AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
 bytes AS (SELECT doc_id, w, n, list_concat(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda x: [ascii(x)]),
   list_transform(string_split(w, ''), lambda x: CASE WHEN ascii(x) < 128 THEN [ascii(x)] ELSE [195, ascii(x) - 64] END)) AS b FROM own),
 hashed AS (SELECT doc_id, w, n, xor(list_reduce(list_concat([4294967295], list_transform(flatten(b), lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, bits),
 cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
 v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 holes AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || '.' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, range(1, 100) t(i) WHERE i <= length(word)),
 one AS (SELECT a.word, b.word AS near, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word UNION
   SELECT a.word, b.word, b.n FROM holes a JOIN v b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM holes a JOIN v b ON a.less = b.word),
 best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM one GROUP BY word),
 formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
 chain AS (SELECT word, word AS place, 0 AS k FROM formed UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN formed ON formed.word = chain.place WHERE form IS NOT NULL)
SELECT word, form, (SELECT arg_max(place, k) FROM chain WHERE chain.word = formed.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed
"""

#: Rows in order lead four states on; costs with audits and repaired lines of each are kept, the least of each state wins.
OP13_SQL = CRC32_SQL + r"""
 seen AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
 fated AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate FROM seen, bits),
 damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
   FROM fated, range(2) c(i) WHERE fate <> 0 AND (i = 0 OR fate = 3)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS cut FROM damaged),
 judged AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
   left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
 counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
   count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
 gaps(p, q, cost, audit, lines) AS (SELECT * FROM (VALUES ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('0', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
   ('a', 'u', 3, 'I', ['user:']), ('0', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:']))),
 moves(p, q, initial, edit) AS (VALUES ('0', 's', 's', 'K'), ('0', 'u', 'u', 'K'), ('s', 'u', 'u', 'K'), ('u', 'a', 'a', 'K'), ('a', 'u', 'u', 'K'), ('0', 'u', '', 'R'), ('s', 'u', '', 'R'), ('u', 'a', '', 'R'), ('a', 'u', '', 'R'),
   ('0', '0', '', 'D'), ('s', 's', '', 'D'), ('u', 'u', '', 'D'), ('a', 'a', '', 'D')),
 ways AS (SELECT conv_id, 0 AS i, '0' AS p, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counted
   UNION ALL SELECT w.conv_id, w.i + 1, m.q, min({'cost': w.best.cost + g.cost + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'audit': w.best.audit || g.audit || edit,
     'lines': w.best.lines || g.lines || CASE edit WHEN 'D' THEN [] WHEN 'R' THEN [CASE m.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] ELSE [role || ':' || text] END})
   FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN gaps g ON g.p = w.p JOIN moves m ON m.p = g.q AND (edit <> 'K' OR left(role, 1) = initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
   GROUP BY w.conv_id, w.i, m.q),
 ended AS (SELECT w.conv_id, min({'cost': w.best.cost + g.cost, 'audit': w.best.audit || g.audit, 'lines': w.best.lines || g.lines}) AS best FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n JOIN gaps g ON g.p = w.p AND g.q IN ('0', 'a') GROUP BY w.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
 coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_language_model": op2_language_model, "op3_decontaminate": op3_decontaminate, "op4_pii": op4_pii, "op5_token_counts": op5_token_counts, "op6_quality": op6_quality, "op7_substrings": op7_substrings, "op8_html": op8_html, "op9_jaccard": op9_jaccard, "op10_secrets": op10_secrets,
                                                                 "op11_spelling": op11_spelling, "op12_toxicity": op12_toxicity, "op13_structure": op13_structure}
ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op3_decontaminate": OP3_SQL, "op9_jaccard": OP9_SQL, "op11_spelling": OP11_SQL, "op13_structure": OP13_SQL}
