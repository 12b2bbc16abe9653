"""PII: patterns, and information-theoretic sanitisation of the terms that reveal the protected entities (native).

Protected entities are the values that the patterns find. Corpus co-occurrence tells how strongly a term reveals an
entity: disclosure = PMI(term; entity) / IC(entity), with IC = log(D / n_e) the entity's information content,
PMI = log(n_te * D / (n_t * n_e)), and n counted in whole documents of the whole corpus. 1 means that the term occurs
with the entity only. A term that discloses at least `remove` of the information is removed, from `generalise` on it is
generalised to its kind of word, at every place in each document that holds the entity. Chance meetings are told apart
by a bound on their probability (Hoeffding, times the entity's number of terms), which judges rare entities as well: one
document is evidence as soon as the corpus is large enough. Copies of one text are one piece of evidence.

All of it is built-in functions. Matches and the text between them give positions by a running sum per document; only
matches, counts, which combine before the shuffle, and the texts with entities are shuffled. Patterns are written so that
they run in one pass over any text (no start inside a run that a previous start has failed on, no recursion per repetition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))+(?<=[A-Za-z0-9-])",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-])){13,}(?<=[0-9])",
    r"\+[0-9][\x20().0-9-]{8,}[0-9]",
)
#: A letters-only word between ASCII white space, and in it the term: the word without its edge punctuation.
TERM = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]*+\p{L}[\p{L}'’-]*\p{L}[^\p{L}\p{N}\x20\x09-\x0D]*(?![^\x20\x09-\x0D])"
CORE = r"\p{L}[\p{L}'’-]*\p{L}"
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    at = F.reverse(F.transform(F.split(digits, ""), lambda c: c.try_cast("int")))
    doubled = F.transform(at, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
    byte = F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == 0, True).when(kind == 1, byte).when(kind == 2, F.when(n.between(14, 19), luhn).otherwise(False)).otherwise(n.between(10, 15))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, t, kind, start, end, value): valid matches of each text (t: its hash)."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    gates = (text.contains("@"), digit, digit, text.contains("+"))

    def found(k: int) -> Column:
        pieces, values = F.split(text, PATTERNS[k], -1), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))
        return F.when(gates[k], F.struct(F.lit(k).alias("kind"), pieces.alias("p"), values.alias("m")))

    by_kind = docs.select("doc_id", F.xxhash64("text").alias("t"), F.array_compact(F.array(*(found(k) for k in range(len(PATTERNS))))).alias("f"))
    by_kind = by_kind.where(F.size("f") > 0).select("doc_id", "t", F.explode("f").alias("f")).where(F.size("f.m") > 0)
    pieces = by_kind.select("doc_id", "t", F.col("f.kind").alias("kind"), F.col("f.p").alias("p"), F.posexplode("f.m").alias("i", "value"))
    pieces = pieces.select("doc_id", "t", "kind", "i", "value", F.length(F.get("p", F.col("i"))).alias("_n")).dropDuplicates(["doc_id", "t", "kind", "i"])
    so_far = Window.partitionBy("doc_id", "t", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one document
    end = F.sum(F.col("_n") + F.length("value")).over(so_far)
    out = pieces.select("doc_id", "t", "kind", (end - F.length("value")).alias("start"), end.alias("end"), "value")
    return out.where(_valid(F.col("kind"), F.col("value")))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.lower(F.regexp_extract(w, CORE, 0))))


def _exponent(drawn: Column, share: Column, hits: Column) -> Column:
    """Hoeffding: hits or more of drawn documents have a property that share of all have with a probability of exp(-exponent) at most."""
    a, p = hits / drawn, F.least(share, F.lit(1.0))
    rest = F.when(a < 1, (1 - a) * F.ln((1 - a) / F.greatest(1 - p, F.lit(1e-300)))).otherwise(0.0)
    return F.when(a > p, drawn * (a * F.ln(a / p) + rest)).otherwise(0.0)


def texts_with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(t, copies, text): distinct texts with an entity and the number of docs that have them."""
    keyed = docs.withColumn("t", F.xxhash64("text"))
    return keyed.join(found.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("copies"), F.first("text").alias("text"))


def disclosures(docs: DataFrame, texts: DataFrame, held: DataFrame, alpha: float = 0.05, generalise: float = 0.75) -> DataFrame:
    """(entity, term, disclosure) of the pairs that disclose `generalise` or more and that chance explains with less than alpha.

    texts (t, copies, text) are the texts with entities, held (t, entity) their entities. alpha holds for all terms of
    one entity together. Copies of a text count once as evidence, but as documents in the disclosure.
    """
    n_t = materialize(docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")  # combined before the shuffle
    total = docs.count()
    words = texts.select("t", "copies", _terms(F.col("text")).alias("terms"))
    sizes = words.select("t", "copies", F.size("terms").alias("m"))
    n_e = held.join(sizes, "t").groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts_e"), F.sum("m").alias("m"))
    # n_te is at most n_e, so a disclosing term is in at most n_e ** g * D ** (1 - g) documents
    n_e = materialize(n_e.withColumn("most", F.pow(F.col("n_e"), F.lit(generalise)) * F.pow(F.lit(float(total)), F.lit(1 - generalise)) * (1 + 1e-9)), "entities")
    known = materialize(held.join(n_e, "entity"), "held")
    most = known.groupBy("t").agg(F.max("most").alias("_most"))
    top = n_e.agg(F.max("most")).first()[0] or 0.0  # terms of more documents disclose nothing
    rare = words.select("t", "copies", F.explode("terms").alias("term")).join(most, "t").join(n_t.where(F.col("n_t") <= top), "term").where(F.col("n_t") <= F.col("_most"))
    pairs = rare.join(known, "t").where(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts_te"), *(F.first(c).alias(c) for c in ("n_t", "n_e", "texts_e", "m")))
    share = 1 - F.ln(F.greatest(F.lit(1.0), F.col("n_t") / F.col("n_te"))) / F.greatest(F.lit(1e-9), F.ln(total / F.col("n_e")))
    size = total - (F.col("n_e") - F.col("texts_e"))
    others = F.col("n_t") - (F.col("n_te") - F.col("texts_te"))
    chance = F.greatest(_exponent(F.col("texts_e"), others / size, F.col("texts_te")), _exponent(others, F.col("texts_e") / size, F.col("texts_te")))
    return pairs.withColumn("disclosure", share).where((F.col("disclosure") >= generalise) & (chance >= F.ln(F.col("m") / alpha))).select("entity", "term", "disclosure")


def find(docs: DataFrame, alpha: float = 0.05, remove: float = 0.95, generalise: float = 0.75) -> DataFrame:
    """(doc_id, t, spans): spans (start, kind, end, remove) of every text with any, sorted; t: the hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(matches(docs), "matches")
    texts = materialize(texts_with(docs, found), "texts")
    held = materialize(found.select("t", F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct(), "pairs")
    shown = disclosures(docs, texts, held, alpha, generalise)
    # only terms that a text holds: as many rows as texts have telling terms, and not texts of an entity times its terms
    shown = materialize(shown, "shown")
    occur = texts.select("t", F.explode(_terms(F.col("text"))).alias("term")).join(shown.select("term").distinct(), "term")
    telling = occur.join(held, "t").join(shown, ["entity", "term"]).groupBy("t", F.col("term").alias("_term")).agg((F.max("disclosure") >= remove).alias("remove"))
    telling = materialize(telling, "telling")
    pieces = texts.join(telling.select("t").distinct(), "t", "left_semi").select("t", F.split("text", TERM, -1).alias("p"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m"))
    pieces = pieces.select("t", "p", F.posexplode("m").alias("i", "word")).select("t", "i", "word", F.length(F.get("p", F.col("i"))).alias("_n"))
    so_far = Window.partitionBy("t").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one text
    core = F.regexp_extract("word", CORE, 0)
    places = pieces.withColumn("start", F.sum(F.col("_n") + F.length("word")).over(so_far) - F.length("word") + F.instr("word", core) - 1)
    places = places.select("t", "start", (F.col("start") + F.length(core)).alias("end"), F.lower(core).alias("_term")).join(telling, ["t", "_term"])
    span = lambda kind, gone: F.struct(F.col("start").cast("long").alias("start"), F.lit(kind).alias("kind") if isinstance(kind, int) else F.col(kind), F.col("end").cast("long").alias("end"), gone.alias("remove"))
    terms = places.groupBy("t").agg(F.collect_list(span(4, F.col("remove"))).alias("_terms"))  # of one text
    spans = found.groupBy("doc_id", "t").agg(F.collect_list(span("kind", F.lit(True))).alias("spans")).join(terms, "t", "left")
    return spans.select("doc_id", "t", F.array_sort(F.when(F.col("_terms").isNull(), F.col("spans")).otherwise(F.concat("spans", "_terms"))).alias("spans"))


def _attached(docs: DataFrame, spans: DataFrame, text_hash: Column) -> DataFrame:
    """docs with _leadspark_spans, found again by id and the text's hash; an empty array where there are none."""
    s = spans.select(F.col("doc_id").alias("_leadspark_d"), F.col("t").alias("_leadspark_t"), F.col("spans").alias("_leadspark_spans"))
    out = docs.join(s, F.col("doc_id").cast("long").eqNullSafe(F.col("_leadspark_d")) & (text_hash == F.col("_leadspark_t")), "left").drop("_leadspark_d", "_leadspark_t")
    return out.withColumn("_leadspark_spans", F.coalesce("_leadspark_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,remove:boolean>>")))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term), a row for each of docs (doc_id, text).

    A null or empty text has no spans; null ids and rows that repeat stay rows (equal rows have equal spans); an empty
    table gives none. Spans are kind:start:end in code points, end exclusive, by start and then kind.
    """
    ids = docs.select("doc_id", F.xxhash64("text").alias("t"))
    out = _attached(ids, find(docs, **options), F.col("t"))
    count = lambda k: F.size(F.filter("_leadspark_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("_leadspark_spans", lambda s: s["kind"] < 4)
    return out.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_leadspark_spans")).alias("spans"), count(4).alias("n_term"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with entities replaced by their kind's mark, terms removed, and less telling terms replaced by [NAME] (capital first) or [WORD]."""
    held = _attached(docs, find(docs, **options), F.xxhash64("text"))
    marks = F.array(*(F.lit(m) for m in MARKS))

    def step(a, s):
        word = F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        mark = F.when(s["kind"] < 4, F.element_at(marks, F.least(s["kind"] + 1, F.lit(4)))).when(s["remove"], "").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        begin = F.greatest(a["at"], s["start"])
        new = F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, (begin - a["at"]).cast("int")), F.when(s["end"] > a["at"], mark).otherwise(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), new.alias("out"))

    done = F.aggregate("_leadspark_spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.lit(2**31 - 1))))
    out = held.withColumn("text", F.when(F.size("_leadspark_spans") > 0, done).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
