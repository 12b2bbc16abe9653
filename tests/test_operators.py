"""Assignment, scoring, identity and versions against plain restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadspark.functions.similarity import jaro_winkler_value
from leadspark.operators import assign, evaluate, identity, ingest, models, scoring, signals, views
from leadspark.operators.quantiles import quantiles
from leadspark.scratch import components, ranked


@pytest.mark.parametrize("seed", range(5))
def test_assignment_equals_the_greedy_rule(spark, seed):
    r = random.Random(seed)
    leads = [(f"L{i:03d}", "E", f"P{i % 3}", float(r.randint(0, 20))) for i in range(60)]
    advisors = [(f"A{i}", f"N{i}", f"P{i % 3}", "E", r.randint(0, 9), r.random() < 0.8) for i in range(8)]
    kept = [(x[0], r.choice(advisors)[0]) for x in r.sample(leads, 12)]
    load = {a[0]: r.randint(0, 3) for a in advisors}
    want = {}
    for pos in {x[2] for x in leads}:
        pool = {a[0]: max(0, a[4] - load[a[0]]) for a in advisors if a[2] == pos and a[5] and a[4] > 0}
        for rank, x in enumerate(sorted((x for x in leads if x[2] == pos), key=lambda x: (-x[3], x[0])), 1):
            a = dict(kept).get(x[0])
            if a not in pool:
                free = [k for k in pool if pool[k] > 0]
                a = min(free, key=lambda k: (-pool[k], k)) if free else None
                if a:
                    pool[a] -= 1
            want[x[0]] = (rank, a)
    got = assign.assign_leads(spark.createDataFrame(leads, "lead_id string, company_id string, point_of_sale_id string, queue double"), spark.createDataFrame(advisors, "advisor_id string, name string, point_of_sale_id string, company_id string, daily_capacity int, active boolean"),
                              spark.createDataFrame(kept, "lead_id string, advisor_id string"), spark.createDataFrame(list(load.items()), "advisor_id string, load long"))
    assert {x.lead_id: (x.priority_rank, x.advisor_id) for x in got.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_ranks_over_ranges_equal_a_sort_of_each_group(spark, n):
    """Two thirds of the rows in one group with one value of the first order column, null groups and null values among the rest."""
    r = random.Random(n)
    rows = [("a", "x", 1.0, i) if r.random() < 0.66 else (r.choice(["a", "b", None]), r.choice(["x", None]), r.choice([None, 1.0, 2.0]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, h string, v double, i long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        got = {x.i: x.rank for x in ranked(df, ["g", "h"], [F.col("v").desc_nulls_last(), F.col("i").asc()], "rank").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = {}, {}
    for g, h, v, i in sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0), x[3])):
        want[i] = seen[g, h] = seen.get((g, h), 0) + 1
    assert got == want


def test_scores(spark):
    signals_ = spark.createDataFrame([("a", None, True, "alta", True, None, None, None, None, None, True, True, True, True, True, "Sin gestión", 3, False), ("b", 20e6, False, None, None, None, 25e6, 5e6, "contado", "precio", True, False, False, False, False, "raro", None, False)],
                                     "lead_id string, list_price double, model_resolved boolean, intencion_compra string, solicitud_cita boolean, solicitud_cotizacion boolean, presupuesto double, cuota_inicial double, forma_pago string, objecion string, has_conversation boolean, phone_valid boolean, email_present boolean, city_present boolean, registration_trustworthy boolean, estado_gestion string, days_since_registration int, has_first_contact boolean")
    got = {x.lead_id: x for x in scoring.score_leads(signals_).collect()}
    assert (got["a"].commercial, got["a"].urgency, got["a"].band, got["a"].urgency_band) == (70.0, 100.0, "Alta", "Hoy")
    assert got["b"].commercial == 37.54 and got["b"].urgency == 30.0 and got["b"].queue == 35.28
    assert [r.code for r in got["b"].reasons][:3] == ["BASE_GESTIONABLE", "PRESUPUESTO_COMPATIBLE", "CUOTA_SUFICIENTE"] and "FECHA_NO_CONFIABLE" in [r.code for r in got["b"].reasons]
    off = scoring.score_leads(signals_, scoring.params(ticket_weight=0)).where("lead_id = 'b'").first()
    assert off.commercial == 30.0


def test_identity(spark):
    leads = spark.createDataFrame([("1", "E", "Ana Díaz", "300", "a@x.co", None), ("2", "E", "otra", "300", "a@x.co", None), ("3", "E", "ana  diaz", "300", None, None), ("4", "F", "Ana Díaz", "300", "a@x.co", None), ("5", "E", "Luz", None, None, "Cali"), ("6", "E", "luz", None, None, "Cali"), ("7", "E", "Solo", "999", None, None)],
                                  "lead_id string, company_id string, customer_name string, phone_normalized string, email_normalized string, city_normalized string")
    clusters, members = identity.resolve_identities(leads)
    assert {(c.canonical_lead_id, c.size, c.strength, c.status, c.matched_rules) for c in clusters.collect()} == {("1", 3, "strong", "possible_pending", "PHONE_EMAIL_EXACT,PHONE_NAME_SIMILAR"), ("5", 2, "weak", "possible_pending", "NAME_CITY_MATCH")}
    assert {(m.lead_id, m.role, m.related_lead_id) for m in members.collect()} == {("1", "canonical", "2"), ("2", "member", "1"), ("3", "member", "1"), ("5", "canonical", "6"), ("6", "member", "5")}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got.values()) == {0, 1000} and sum(v == 0 for v in got.values()) == 301


def test_consolidation(spark):
    rows = [("L", 1, "alta", True, None, None, None, "contado", None, None), ("L", 2, "media", False, 5.0, "lo dijo", None, "credito", "x", None), ("L", 3, None, None, 7.0, None, None, None, None, None)]
    x = spark.createDataFrame(rows, "lead_id string, extraction_id long, intencion_compra string, solicitud_cita boolean, cuota_inicial double, cuota_inicial_evidence string, presupuesto double, forma_pago string, forma_pago_evidence string, presupuesto_evidence string")
    x = x.withColumns({"solicitud_cotizacion": F.lit(None).cast("boolean"), "objecion": F.lit(None).cast("string"), "objecion_evidence": F.lit(None).cast("string")})
    r = signals.consolidate(x).first()
    assert (r.intencion_compra, r.solicitud_cita, r.cuota_inicial, r.cuota_inicial_source, r.forma_pago) == ("alta", True, 5.0, 2, "credito")


def test_page_and_samples(spark):
    df = spark.range(120)
    assert [views.page(df, ["id"], n)[1:] for n in (0, 2, 99)] == [(1, 120, 3), (2, 120, 3), (3, 120, 3)]
    assert views.page(df, ["id"], 99)[0].count() == 20
    got = evaluate.take_in_order(df, [("even", F.col("id") % 2 == 0, 3), ("small", F.col("id") < 5, 3)], "id", [F.col("id")])
    assert sorted((r.id, r.label) for r in got.collect()) == [(0, "even"), (1, "small"), (2, "even"), (3, "small"), (4, "even")]


def test_second_run_changes_nothing(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "lead_id string, content_hash string")
    first = ingest.upsert_diff(new.limit(0).withColumns({"first_seen_run": F.lit(1), "last_seen_run": F.lit(1)}), new, 1)
    second = ingest.upsert_diff(first.drop("change"), new, 2)
    assert {(r.change, r.first_seen_run, r.last_seen_run) for r in second.collect()} == {("unchanged", 1, 2)}


def test_model_cascade(spark):
    from leadspark.operators import models

    catalog = spark.createDataFrame([("S1", "Honda", "CB 125F"), ("S2", "Honda", "XR 150"), ("S3", "Bajaj", "Pulsar NS 200"), ("S4", "Bajaj", "Pulsar N 250")], "sku string, brand string, line string")
    texts = ["honda cb 125f 2024", "XR.150", "HONDA", "pulsar", "hnda xr 150", "bajaj pulzar ns 200", "zzz", "", None, "¡!", "cb 125f negra"]
    got = models.match_models(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, model_text_raw string"), catalog)
    assert {r.id: (r.match_type, r.sku) for r in got.collect()} == {0: ("directo_unico", "S1"), 1: ("directo_unico", "S2"), 2: ("solo_marca", None), 3: ("prefijo_ambiguo", None), 4: ("directo_unico", "S2"), 5: ("fuzzy", "S3"),
                                                                   6: ("sin_match", None), 7: ("vacio", None), 8: ("vacio", None), 9: ("sin_match", None), 10: ("prefijo_unico", "S1")}


def test_similar_keys_equal_comparing_every_pair(spark):
    import difflib
    import random

    from leadspark.operators import models

    r = random.Random(5)
    keys = sorted({"".join(r.choice("ab 12") for _ in range(r.randint(1, 24))).strip() or "x" for _ in range(400)})
    texts = set()
    for k in keys:
        x = list(k)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(x) + 1)
            x[i : i + r.randint(0, 1)] = r.choice(["", "a", "1", "b2"])
        texts.add("".join(x))
    own = {k: [f"S{i}", f"S{i + 1}"] if i % 7 == 0 else [f"S{i}"] for i, k in enumerate(keys)}
    want = {}
    for t in texts:
        best = max(difflib.SequenceMatcher(None, t, k).ratio() for k in keys)
        skus = {s for k in keys if difflib.SequenceMatcher(None, t, k).ratio() == best for s in own[k]}
        if t and best >= 0.9:
            want[t] = (round(best, 4), next(iter(skus)) if len(skus) == 1 else None)
    got = models.similar_keys(spark.createDataFrame([(t,) for t in texts if t], "key string"), spark.createDataFrame(list(own.items()), "key string, skus array<string>"), below=False)
    assert {x.key: (x.score, x.fuzzy_sku) for x in got.collect()} == want and len(want) > 200


def test_components_with_hubs_and_long_chains(spark):
    import random

    from leadspark.scratch import components, ranked

    r = random.Random(1)
    ids = list(range(6000))
    r.shuffle(ids)
    edges = [(ids[0], ids[i]) for i in range(1, 2500)] + [(ids[i], ids[i + 1]) for i in range(3000, 3040)] + [(ids[i], ids[i]) for i in range(10)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), few=100).collect()}
    assert got == {**dict.fromkeys(ids[:2500], min(ids[:2500])), **dict.fromkeys(ids[3000:3041], min(ids[3000:3041]))}


def test_meet_deals_hot_keys_and_keeps_every_row(spark):
    from pyspark.sql import functions as F

    from leadspark.scratch import meet

    many = spark.range(9000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = many.groupBy("k").agg(F.count("*").alias("_n")).withColumn("w", F.col("k") * 2)
    got = meet(many, one, ["k"], "_n", ["v"])
    assert got.columns == ["k", "v", "w"] and got.where("w = 2 * k").agg(F.count("*"), F.sum("v")).first()[:] == (9000, sum(range(9000)))


def test_nearest_keys_equal_brute_force(spark):
    import difflib

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "a"
    keys = sorted({word(r.randrange(1, 24)) for _ in range(150)})
    texts = sorted({word(r.randrange(1, 24)) for _ in range(60)} | {k[:-1] + "x" for k in keys[:20] if len(k) > 1} | {"zzz", "q", keys[3] + keys[5]})
    k = spark.createDataFrame([(x, [f"S{i}", f"S{i // 2}"]) for i, x in enumerate(keys)], "key string, skus array<string>")
    got = {x.key: x for x in models.similar_keys(spark.createDataFrame([(x,) for x in texts], "key string"), k).collect()}
    assert len(got) == len(texts)
    for text in texts:
        ratios = [difflib.SequenceMatcher(None, text, x).ratio() for x in keys]
        best = max(ratios)
        skus = {s for i, x in enumerate(ratios) if x == best for s in (f"S{i}", f"S{i // 2}")}
        want = next(iter(skus)) if best >= 0.9 and len(skus) == 1 else None
        assert abs(got[text].score - best) < 1e-4 and got[text].fuzzy_sku == want, (text, best)


@pytest.mark.parametrize("tile", [500, 7])
def test_similar_names_of_a_phone_equal_brute_force(spark, tile):
    """One phone has most of the names; parts of seven names meet in groups of their own."""
    r = random.Random(5)
    first, last = ["maria", "mariana", "jose", "josé", "ana", "martha", "marta", ""], ["perez", "peres", "gomez", "gomes", "nunez", "lopez de la cruz"]
    names = {f"{r.choice(first)} {r.choice(last)}{r.choice(['', 's', ' x', 'a'])}".strip() for _ in range(400)}
    names |= {"".join(r.choice("abc") for _ in range(r.randrange(0, 12))) for _ in range(60)}
    rows = [("E", "1", x, 2, f"L{i}") for i, x in enumerate(sorted(names))] + [("E", p, x, 1, f"M{p}{x}") for p in "234" for x in r.sample(sorted(names), 3)] + [("F", "1", "maria perez", 1, "Z1")]
    got = {(c.company_id, c.phone_normalized, c.x, c.y): (c.n_a, c.m_a, c.n_b, c.m_b, c.similarity) for c in identity.similar_names(spark.createDataFrame(rows, "company_id string, phone_normalized string, name string, n long, m string"), tile=tile).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2].encode() < b[2].encode() and (s := jaro_winkler_value(a[2], b[2])) >= 0.9:
                want[(*a[:2], a[2], b[2])] = (a[3], a[4], b[3], b[4], s)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("piece", [2000, 10])
def test_mentions_anywhere_in_texts_equal_brute_force(spark, piece):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("ab c") for _ in range(n))
    lines = {text(r.randrange(2, 9)) for _ in range(40)} | {"zz", ""}
    texts = [(i, j, text(r.randrange(0, 60))) for i in range(20) for j in range(3)] + [(50, 0, ""), (51, 0, None), (52, 0, "xzzx zz"), (53, 0, text(3000))]
    got = signals.mentions(spark.createDataFrame(texts, "id long, at int, text string"), spark.createDataFrame([(x,) for x in lines], "line string"), piece=piece)
    want = {(i, j, line) for i, j, t in texts for line in lines if line and t and line in t}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert signals.mentions(spark.createDataFrame(texts, "id long, at int, text string"), spark.createDataFrame([], "line string")).count() == 0


@pytest.mark.parametrize("ranges", [1024, 3])
def test_quantiles_equal_a_sort_of_each_group(spark, ranges):
    r = random.Random(9)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 0.0, 1.5, -3.0, r.gauss(0, 1e6), r.random() * 1e-9, float(r.randrange(10))])) for _ in range(3000)] + [("one", 4.0), ("none", None), ("big", 1e308), ("big", -1e308), ("big", 7.0)]
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"median": (0.5, "linear"), "tenth": (0.1, "linear"), "p95": (0.95, "nearest")}, ranges).collect()}
    assert set(got) == {"a", "b", None, "one", "big"}
    for g, x in got.items():
        v = sorted(b for a, b in rows if a == g and b is not None)
        def linear(share):
            place = share * (len(v) - 1)
            low, high = v[math.floor(place)], v[math.ceil(place)]
            return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high
        assert (x.median, x.tenth, x.p95) == (linear(0.5), linear(0.1), v[math.ceil(0.95 * len(v)) - 1]), g
    assert quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": (0.5, "linear")}).count() == 1
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": (0.5, "linear")}).count() == 0


def test_transitions_equal_a_loop_over_each_leads_events(spark):
    r = random.Random(2)
    known, ends = {"Sin gestión", "Contactado", "En proceso", "Cerrado", "Perdido", "Descartado"}, {"Cerrado", "Perdido", "Descartado"}
    leads = [(f"L{i}", r.choice([*sorted(known), None, "Raro"]), r.choice([None, "2020-01-01"]), r.choice([None, "Otro", "Cliente desistió"])) for i in range(200)]
    events = [(f"L{r.randrange(210) if r.random() < 0.6 else 3}", r.choice([*sorted(known), "Inventado", None]), r.choice([None, " Otro ", "No interesado", "zzz"]), r.choice([None, f"2026-01-{r.randrange(1, 9):02d}"]), i) for i in range(900)]
    want = {}
    for lead, status, closed, reason in leads:
        counts = [0, 0, 0]
        for _, new, why, at, _ in sorted((e for e in events if e[0] == lead), key=lambda e: (e[3] or "", e[4])):
            if new not in known:
                counts[1] += 1
            elif status in ends and new not in ends:
                counts[2] += 1
            else:
                counts[0] += 1
                good = lambda x: x.strip() if x and x.strip() in ("Otro", "No interesado", "Cliente desistió") else None
                # a closing without a time leaves none, and the next one sets it: the first event's time counts as it is
                closed, reason = (closed or at, good(why) or good(reason) or "Otro") if new in ends else (None, None)
                status = new
        want[lead] = (status, reason, *counts)
    day = lambda c: F.col(c).cast("timestamp").alias(c)
    got = views.status_transitions(spark.createDataFrame(leads, "lead_id string, status string, closed_at string, close_reason string").select("lead_id", "status", day("closed_at"), "close_reason"),
                                   spark.createDataFrame(events, "lead_id string, new_status string, reason string, at string, event_id long").select("lead_id", "new_status", "reason", day("at"), "event_id"))
    assert {x.lead_id: (x.status, x.close_reason, x.applied, x.unknown, x.reopenings) for x in got.collect()} == want


def _people(r, n):
    """Few phones, e-mails, names and cities, any of them null, and one phone and one place with a large part of the leads."""
    some = lambda *x: r.choice(x)
    return [(f"L{i:04d}", some("E", "E", "F", None), some("Ana Diaz", "ana  díaz", "Ana Dias", "Luz", "Luz M", "", "Marta Gomez", "Martha Gomez"), some("1", "1", "1", "2", "3", None), some("a@x.co", "b@x.co", "c@x.co", None, None), some("Cali", "Cali", "Pasto", None)) for i in range(n)]


PEOPLE = "lead_id string, company_id string, customer_name string, phone_normalized string, email_normalized string, city_normalized string"


@pytest.mark.parametrize("seed", range(2))
def test_phone_links_hold_every_pair_with_its_rule(spark, seed):
    """Membership and pairs of names give back the list of all pairs, the discarded ones too; the numbers are those of the list."""
    leads = spark.createDataFrame(_people(random.Random(seed), 90), PEOPLE)
    k = [x for x in identity.keyed(leads).collect()]
    want = {(a.lead_id, b.lead_id): identity.STRONG if a.email_normalized and a.email_normalized == b.email_normalized else identity.POSSIBLE if jaro_winkler_value(*sorted((a.name, b.name))) >= 0.9 else None
            for a in k for b in k if a.lead_id < b.lead_id and a.company_id and a.company_id == b.company_id and a.phone_normalized and a.phone_normalized == b.phone_normalized}
    rows = identity.Evidence(leads).phone_links().collect()
    each, near = [x for x in rows if x.kind == "lead"], {frozenset((x.name_class, x.other_class)): x for x in rows if x.kind == "pair"}
    rule = lambda a, b: identity.STRONG if a.mail_class and a.mail_class == b.mail_class else identity.POSSIBLE if a.name_class == b.name_class or frozenset((a.name_class, b.name_class)) in near else None
    got = {(a.lead_id, b.lead_id): rule(a, b) for a in each for b in each if a.lead_id < b.lead_id and a.phone_class and a.phone_class == b.phone_class}
    assert got == want and set(want.values()) == {identity.STRONG, identity.POSSIBLE, None}
    assert sorted(x.lead_id for x in each) == sorted(x.lead_id for x in k)
    for x in each:
        mine = [v for p, v in want.items() if x.lead_id in p]
        assert (x.strong, x.possible, x.discarded) == tuple(mine.count(v) for v in (identity.STRONG, identity.POSSIBLE, None)), x
    name = {x.lead_id: x.name_class for x in each}
    for p, x in near.items():
        mine = [v for (a, b), v in want.items() if frozenset((name[a], name[b])) == p]
        assert (x.strong, x.possible, x.discarded) == (mine.count(identity.STRONG), mine.count(identity.POSSIBLE), 0) and x.name_similarity >= 0.9


@pytest.mark.parametrize("seed", range(2))
def test_place_links_hold_every_pair(spark, seed):
    leads = spark.createDataFrame(_people(random.Random(seed), 90), PEOPLE)
    k = identity.keyed(leads).collect()
    want = {(a.lead_id, b.lead_id) for a in k for b in k if a.lead_id < b.lead_id and a.company_id and a.company_id == b.company_id and a.name and a.name == b.name and a.city_normalized and a.city_normalized == b.city_normalized
            and not (a.phone_normalized and a.phone_normalized == b.phone_normalized)}
    each = identity.Evidence(leads).place_links().collect()
    got = {(a.lead_id, b.lead_id) for a in each for b in each if a.lead_id < b.lead_id and a.place_class and a.place_class == b.place_class and not (a.phone_class and a.phone_class == b.phone_class)}
    assert got == want and want and sorted(x.lead_id for x in each) == sorted(x.lead_id for x in k)
    assert all(x.links == sum(x.lead_id in p for p in want) and x.rule == (identity.WEAK if x.links else None) for x in each)


def test_lists_of_candidates_by_broadcast_and_dealt(spark):
    """Rows of a list that fills several tasks are dealt to them; a task has one long list or some short ones."""
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("_key"))
    lists = spark.createDataFrame([("a", "S1|S2|S3"), ("c", "S9")], "key string, candidates string")
    want = {i: "S1|S2|S3" if i % 3 == 0 else None for i in range(900)}
    for most, page in ((1 << 20, 1 << 18), (1 << 20, 4), (0, 4)):
        got = models._with_lists(rows, lists, ["id"], most_bytes=most, page=page, task_bytes=600)
        assert got.count() == 900 and {r.id: r.candidates for r in got.collect()} == want
        if page == 4 and most:
            by_task = got.groupBy(F.spark_partition_id().alias("t")).agg(F.count_distinct("candidates").alias("lists"), F.count("candidates").alias("n")).where("n > 0").collect()
            assert len(by_task) == 4 and all(r.lists == 1 for r in by_task)
    assert "Sort " not in got._jdf.queryExecution().executedPlan().toString()


def test_candidates_stand_in_no_table_of_leads(spark):
    catalog = spark.createDataFrame([(f"S{i}", "Honda", f"CB {i}") for i in range(40)] + [("T1", "Bajaj", "Pulsar"), ("T2", "Bajaj", "Pulsar")], "sku string, brand string, line string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["honda", "pulsar", "cb", "HONDA", "cb 7", None, "nada"])], "id int, model_text_raw string")
    full, slim = models.match_models(rows, catalog, fuzzy=False), models.match_models(rows, catalog, fuzzy=False, candidates=False)
    assert "candidates" not in slim.columns
    again = slim.join(models.candidate_lists(slim, catalog), "model_text_raw", "left").fillna("", ["candidates"])
    of = lambda df: {r.id: (r.sku, r.match_state, r.match_type, r.candidates) for r in df.collect()}
    assert of(again) == of(full) and of(full)[0][3].count("|") == 39 and of(full)[1][3] == "T1|T2" and of(full)[5] == (None, "empty", "vacio", "")
    from leadspark.plans import queries
    assert "candidates" not in queries.kept_leads(spark, "/root/testdata/sf0.001").columns


def test_first_rows_take_one_shuffle(spark):
    from leadspark.operators import ingest

    rows = spark.createDataFrame([("a", 2, "x", None), ("a", 1, "x", None), ("b", 1, "x", None), ("b", 3, None, "x"), ("c", 5, "y", "y")], "lead_id string, row_number long, p string, q string")
    out = ingest.first_occurrence(rows)
    assert {r.lead_id: (r.row_number, r.n_rows, r.row_numbers, r.identical) for r in out.collect()} == {"a": (1, 2, "1,2", True), "b": (1, 2, "1,3", False), "c": (5, 1, "5", True)}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Aggregate(") == 2  # before the shuffle and after it


def test_components_of_stars_take_few_tables(spark, monkeypatch):
    """Leads in groups of three kinds, as identity makes them: one round on the whole graph."""
    from leadspark import scratch

    r, real, names = random.Random(2), scratch.materialize, []
    groups: dict = {}
    for i in range(4000):
        person = r.randrange(1500)
        for g in (("p", person), ("c", "z" if r.random() < 0.1 else person % 20, person % 7), ("n", person, r.random() < 0.1)):
            groups.setdefault(g, []).append(i)
    edges = [(min(m), x) for m in groups.values() for x in m if x != min(m)]
    parent = list(range(4000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    sizes = []

    def counted(df, name):
        out = real(df, name)
        names.append(name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(scratch, "materialize", counted)
    got = {x.node: x.component for x in scratch.components(spark.createDataFrame(edges, "a int, b int"), few=100).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert sum(n > 2000 for n in sizes) <= 5, sizes  # edges, pointers, labels and what they give


@pytest.mark.parametrize("name", ["g06_supervision_counters", "j11_analyzed", "j12_f36_supervision_rows", "j19_x02_lead_detail"])
def test_views_normalise_leads_once(spark, monkeypatch, name):
    from leadspark.plans import queries

    calls, kept = [], queries.kept_leads(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(queries, "kept_leads", lambda *_: calls.append(1) or kept)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_members_without_rules_are_the_same_leads(spark):
    from leadspark.operators import identity

    rows = [("a", "E", "Ana Paz", "1", "x@y.co", "Cali"), ("b", "E", "Ana Paz", "1", "x@y.co", None), ("c", "E", "Ana Pas", "1", None, None), ("d", "E", "Leo", None, None, "Cali"), ("e", "E", "leo", "2", None, "Cali"), ("f", "E", "Eva", "3", None, "Cali")]
    n = spark.createDataFrame(rows, "lead_id string, company_id string, customer_name string, phone_normalized string, email_normalized string, city_normalized string")
    full, slim = identity.resolve_identities(n)[1], identity.resolve_identities(n, rules=False)[1]
    assert "rule" not in slim.columns and sorted(map(tuple, slim.collect())) == sorted(map(tuple, full.select(*slim.columns).collect())) and slim.count() == 5
