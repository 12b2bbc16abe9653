"""Duplicate people within a company: pairs by rules, clusters, members and their best rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.similarity import similar_pairs
from leadspark.functions.text import normalize_key
from leadspark.scratch import components, materialize, meet

STRONG, POSSIBLE, WEAK = "PHONE_EMAIL_EXACT", "PHONE_NAME_SIMILAR", "NAME_CITY_MATCH"
THRESHOLD = 0.90


def _strength(rule):
    return F.when(rule == STRONG, "strong").when(rule == POSSIBLE, "possible").when(rule == WEAK, "weak")


def _order(rule):
    return F.when(rule == STRONG, 0).when(rule == POSSIBLE, 1).otherwise(2)


def keyed(leads: DataFrame) -> DataFrame:
    return leads.select("lead_id", "company_id", normalize_key(F.col("customer_name")).alias("name"), "phone_normalized", "email_normalized", "city_normalized")


PHONE = ["company_id", "phone_normalized"]
PLACE = ["company_id", "name", "city_normalized"]


SIMILAR = "company_id string, phone_normalized string, x string, y string, n_a long, m_a string, n_b long, m_b string, similarity double"


def _similar(threshold: float):
    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
        for batch in batches:
            out = []
            for company, phone, i, j, members in zip(*(batch.column(c).to_pylist() for c in (*PHONE, "i", "j", "members")), strict=True):
                left, right = [m for m in members if m["own"] == i], [m for m in members if m["own"] == j]
                for a, b, s in similar_pairs([m["name"] for m in left], None if i == j else [m["name"] for m in right], threshold):
                    a, b = sorted((left[a], right[b]), key=lambda m: m["name"].encode())
                    out.append((company, phone, a["name"], b["name"], a["n"], a["m"], b["n"], b["m"], s))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 9, kinds, strict=True)], [c.split()[0] for c in SIMILAR.split(", ")])
    return run


def similar_names(names: DataFrame, threshold: float = THRESHOLD, tile: int = 500) -> DataFrame:
    """(company_id, phone_normalized, x, y, n_a, m_a, n_b, m_b, similarity): different names of one phone, x before y, that are alike. names: a row for each name of a phone, with n and m.

    Up to about `tile` names of a phone are compared in one group. More are dealt to parts by hash, and each two parts
    meet in a group of their own: a phone with g names takes g / tile copies of each name in as many tasks as it has pairs
    of parts, no task holds more than two parts, and only pairs that are alike leave a task.
    """
    sizes = names.groupBy(*PHONE).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / tile).cast("int"))
    many = meet(names, materialize(sizes, "phones"), PHONE, "_n", ["name"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int"))
    met = many.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumns({"i": F.least("own", "_with"), "j": F.greatest("own", "_with")})
    groups = met.groupBy(*PHONE, "i", "j").agg(F.collect_list(F.struct("name", "n", "m", "own")).alias("members")).where(F.size("members") > 1)
    return groups.mapInArrow(_similar(threshold), SIMILAR)


def _groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, _n, _1, _2): number of leads, the smallest and the second one, of groups of two or more."""
    first = materialize(rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("lead_id").alias("_1")).where("_n > 1"), "first")
    rest = meet(rows.select("lead_id", *group), first, group, "_n", ["lead_id"]).where("lead_id <> _1").groupBy(*group).agg(F.min("lead_id").alias("_2"))
    return materialize(first.join(rest, group), "groups")


class Evidence:
    """What links the leads of a company, as tables of groups and no list of pairs.

    mails, names, places: groups of leads with one phone and e-mail, one phone and name, one name and city. similar: pairs
    of different names of one phone that are alike, with their leads' numbers and smallest ids. each: leads by phone, name, e-mail.
    """

    def __init__(self, leads: DataFrame):
        self.leads = materialize(keyed(leads), "identity")
        self.phones = self.leads.where("phone_normalized is not null")
        self.mailed = self.phones.where("email_normalized is not null")
        self.placed = self.leads.where("name <> '' and city_normalized is not null")
        self.mails, self.names, self.places = _groups(self.mailed, [*PHONE, "email_normalized"]), _groups(self.phones, [*PHONE, "name"]), _groups(self.placed, PLACE)
        self.each = materialize(self.phones.groupBy(*PHONE, "name", "email_normalized").agg(F.count("*").alias("n"), F.min("lead_id").alias("m")), "each")
        names = self.each.groupBy(*PHONE, "name").agg(F.sum("n").alias("n"), F.min("m").alias("m"))
        self.similar = materialize(similar_names(names), "similar")

    def phone_links(self) -> DataFrame:
        """(kind, lead_id, phone_class, mail_class, name_class, other_class, strong, possible, discarded, name_similarity): all pairs of leads of one phone with their rule, as classes.

        lead: a row for each lead with the smallest lead of its phone, of its phone and e-mail, of its phone and name, and in
        how many pairs of a phone's leads it is, by rule; without a phone, no class and no pair. pair: name_class and
        other_class are the classes of two similar names of a phone, with the number of their leads' pairs by rule. Two leads
        of a phone_class are STRONG with one mail_class, else POSSIBLE with one name_class or a pair row, else discarded.
        """
        name, mail, cell = [*PHONE, "name"], [*PHONE, "_mail", "_has"], [*PHONE, "name", "_mail", "_has"]
        marks = {"_mail": F.coalesce("email_normalized", F.lit("")), "_has": F.col("email_normalized").isNotNull()}
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        cells, shared = self.each.where("company_id is not null").withColumns(marks), materialize(self._shared(), "shared")

        def classes(group: list[str], to: str) -> DataFrame:
            return cells.groupBy(*group).agg(F.sum("n").alias(f"_of_{to}"), F.min("m").alias(f"{to}_class"), F.count("*").alias("_cells"))

        def sides(df: DataFrame, first: str, second: str, *more: str) -> DataFrame:
            """A row for each name of a pair, with the other one's number as _k."""
            return df.select(*PHONE, F.col("x").alias("name"), F.col(second).alias("_k"), *more).unionByName(df.select(*PHONE, F.col("y").alias("name"), F.col(first).alias("_k"), *more))

        near = sides(self.similar, "n_a", "n_b").groupBy(*name).agg(F.sum("_k").alias("_near"))
        same = sides(shared, "_a", "_b", "email_normalized").withColumns(marks).groupBy(*cell).agg(F.sum("_k").alias("_same"))
        known = meet(cells, materialize(classes(PHONE, "phone"), "phones"), PHONE, "_cells", ["name", "_mail"])
        known = meet(known, materialize(classes(name, "name").join(near, name, "left"), "names"), name, "_cells", ["_mail"])
        known = meet(known, materialize(classes(mail, "mail"), "mails"), mail, "_cells", ["name"]).join(same, cell, "left")
        strong = F.when(F.col("_has"), F.col("_of_mail") - 1).otherwise(0)
        possible = F.col("_of_name") - F.when(F.col("_has"), F.col("n")).otherwise(1) + zero(F.col("_near")) - zero(F.col("_same"))
        known = known.select(*cell, "n", "phone_class", F.when(F.col("_has"), F.col("mail_class")).alias("mail_class"), "name_class", strong.alias("strong"), possible.alias("possible"), (F.col("_of_phone") - 1 - strong - possible).alias("discarded"))
        held = meet(self.phones.where("company_id is not null").withColumns(marks).select("lead_id", *cell), materialize(known, "cells"), cell, "n", ["lead_id"]).drop(*cell)
        rest = self.leads.where("phone_normalized is null or company_id is null").select("lead_id", *(F.lit(0).cast("long").alias(c) for c in ("strong", "possible", "discarded")))
        by_mail = shared.groupBy(*PHONE, "x", "y").agg(F.sum(F.col("_a") * F.col("_b")).alias("_same"))
        strong = zero(F.col("_same"))
        pairs = self.similar.join(by_mail, [*PHONE, "x", "y"], "left").select(F.lit("pair").alias("kind"), F.col("m_a").alias("name_class"), F.col("m_b").alias("other_class"), strong.alias("strong"), (F.col("n_a") * F.col("n_b") - strong).alias("possible"), F.lit(0).cast("long").alias("discarded"), F.round("similarity", 4).alias("name_similarity"))
        out = held.unionByName(rest, allowMissingColumns=True).withColumn("kind", F.lit("lead")).unionByName(pairs, allowMissingColumns=True)
        return out.select("kind", "lead_id", "phone_class", "mail_class", "name_class", "other_class", "strong", "possible", "discarded", "name_similarity")

    def place_links(self) -> DataFrame:
        """(lead_id, place_class, phone_class, rule, links): all pairs of leads of one name and city without a common phone, as classes.

        A row for each lead: the smallest lead of its name and city, the smallest of those with its phone too, and with how
        many leads it is linked; without a name or city, no class and no link. Two leads of a place_class are linked unless they have one phone_class.
        """
        cell = [*PLACE, "_phone", "_has"]
        marks = {"_phone": F.coalesce("phone_normalized", F.lit("")), "_has": F.col("phone_normalized").isNotNull()}
        placed = self.placed.where("company_id is not null").withColumns(marks).select("lead_id", *cell)
        cells = materialize(placed.groupBy(*cell).agg(F.count("*").alias("_n"), F.min("lead_id").alias("_m")), "cells")
        places = materialize(cells.groupBy(*PLACE).agg(F.sum("_n").alias("_all"), F.min("_m").alias("place_class"), F.count("*").alias("_cells")), "places")
        known = meet(cells, places, PLACE, "_cells", ["_phone"]).withColumn("links", F.col("_all") - F.when(F.col("_has"), F.col("_n")).otherwise(1))
        known = materialize(known.select(*cell, "_n", "place_class", F.when(F.col("_has"), F.col("_m")).alias("phone_class"), "links"), "known")
        held = meet(placed, known, cell, "_n", ["lead_id"]).drop(*cell)
        rest = self.leads.where("not coalesce(name <> '' and city_normalized is not null and company_id is not null, false)").select("lead_id", F.lit(0).cast("long").alias("links"))
        return held.unionByName(rest, allowMissingColumns=True).select("lead_id", "place_class", "phone_class", F.when(F.col("links") > 0, WEAK).alias("rule"), "links")

    def _shared(self) -> DataFrame:
        """(company_id, phone_normalized, x, y, email_normalized, _a, _b): the e-mails that two similar names have in common, with the leads of each."""
        e = self.each.where("email_normalized is not null")
        mine, theirs = e.select(*PHONE, F.col("name").alias("x"), "email_normalized", F.col("n").alias("_a")), e.select(*PHONE, F.col("name").alias("y"), "email_normalized", F.col("n").alias("_b"))
        return self.similar.select(*PHONE, "x", "y").join(mine, [*PHONE, "x"]).join(theirs, [*PHONE, "y", "email_normalized"])

    def inside(self) -> DataFrame:
        """(m, pairs): pairs of leads of one phone and name without a common e-mail, by the smallest lead."""
        couples = lambda n: n * (n - 1) / 2
        mail = F.sum(F.when(F.col("email_normalized").isNotNull(), couples(F.col("n"))).otherwise(0))
        return self.each.groupBy(*PHONE, "name").agg(F.min("m").alias("m"), (couples(F.sum("n")) - mail).cast("long").alias("pairs")).where("pairs > 0").select("m", "pairs")

    def between(self) -> DataFrame:
        """(m, pairs): the same of two similar names, by the smallest lead of the first."""
        same = self._shared().groupBy(*PHONE, "x", "y").agg(F.sum(F.col("_a") * F.col("_b")).alias("_same"))
        out = self.similar.join(same, [*PHONE, "x", "y"], "left").select(F.col("m_a").alias("m"), (F.col("n_a") * F.col("n_b") - F.coalesce("_same", F.lit(0))).alias("pairs"))
        return out.where("pairs > 0")

    def weak(self) -> DataFrame:
        """(m): the smallest lead of each (name, city) group that has a pair without a common phone."""
        within = self.placed.where("phone_normalized is not null").groupBy(*PLACE, "phone_normalized").agg(F.count("*").alias("c")).groupBy(*PLACE).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("_within"))
        return self.places.join(within, PLACE, "left").where("_n * (_n - 1) / 2 > coalesce(_within, 0)").select(F.col("_1").alias("m"))

    def edges(self) -> DataFrame:
        """(a, b): stars that connect what the rules connect."""
        parts = [meet(rows, g, group, "_n", ["lead_id"]).where("lead_id <> _1").select(F.col("_1").alias("a"), F.col("lead_id").alias("b"))
                 for rows, g, group in ((self.mailed, self.mails, [*PHONE, "email_normalized"]), (self.phones, self.names, [*PHONE, "name"]), (self.placed, self.places, PLACE))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(self.similar.select(F.col("m_a").alias("a"), F.col("m_b").alias("b")))

    def best(self) -> DataFrame:
        """(lead_id, rule, strength, related_lead_id): the strongest edge of each lead; of equal ones the smallest related lead."""
        def other(rows, g, group):
            return meet(rows, g, group, "_n", ["lead_id"]).select("lead_id", F.when(F.col("lead_id") == F.col("_1"), F.col("_2")).otherwise(F.col("_1")).alias("related_lead_id"))

        strong = materialize(other(self.mailed, self.mails, [*PHONE, "email_normalized"]), "strong")
        # without a strong edge, no other lead of the phone has the lead's e-mail
        pairs = self.similar.select(*PHONE, F.col("x").alias("name"), "n_a", "m_b").unionByName(self.similar.select(*PHONE, F.col("y").alias("name"), F.col("n_b").alias("n_a"), F.col("m_a").alias("m_b")))
        near = materialize(pairs.groupBy(*PHONE, "name").agg(F.max("n_a").alias("_n"), F.min("m_b").alias("related_lead_id")), "near")
        alike = meet(self.phones, near, [*PHONE, "name"], "_n", ["lead_id"]).select("lead_id", "related_lead_id").unionByName(other(self.phones, self.names, [*PHONE, "name"]))
        possible = materialize(alike.groupBy("lead_id").agg(F.min("related_lead_id").alias("related_lead_id")).join(strong, "lead_id", "left_anti"), "possible")
        weak = other(self.placed, self.places, PLACE).join(strong, "lead_id", "left_anti").join(possible, "lead_id", "left_anti")
        named = lambda df, rule: df.select("lead_id", F.lit(rule).alias("rule"), "related_lead_id")
        out = named(strong, STRONG).unionByName(named(possible, POSSIBLE)).unionByName(named(weak, WEAK))
        return out.select("lead_id", "rule", _strength(F.col("rule")).alias("strength"), "related_lead_id")


def best_rules(leads: DataFrame) -> DataFrame:
    """(lead_id, rule, strength, related_lead_id): the strongest edge of each lead that has one; of equal ones the smallest related lead."""
    return Evidence(leads).best()


def resolve_identities(leads: DataFrame, evidence: Evidence | None = None, rules: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clusters, members). clusters: canonical_lead_id, company_id, size, strength, status, matched_rules. members: canonical_lead_id, lead_id, role, rule, strength, related_lead_id, status.

    Connectivity uses a star for each group of leads and an edge for each pair of similar names. Which rules hold in a
    cluster follows from counts of the groups: no list of pairs is made. Without `rules`, members lack rule, strength and
    related_lead_id, which take longer to find than who is a member.
    """
    e = Evidence(leads) if evidence is None else evidence
    comp = components(e.edges())
    found = lambda df, rule: df.select("m", F.lit(rule).alias("rule"))
    held = found(e.mails.select(F.col("_1").alias("m")), STRONG).unionByName(found(e.inside(), POSSIBLE)).unionByName(found(e.between(), POSSIBLE)).unionByName(found(e.weak(), WEAK)).distinct()
    held = held.join(comp, F.col("m") == F.col("node")).select("component", "rule")
    by_rule = held.groupBy("component").agg(F.array_sort(F.collect_set("rule")).alias("_rules"), F.min(_order(F.col("rule"))).alias("_o"), F.max(_order(F.col("rule"))).alias("_last"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    clusters = sizes.join(by_rule, "component").join(e.leads.select(F.col("lead_id").alias("component"), "company_id"), "component").select(
        F.col("component").alias("canonical_lead_id"), "company_id", "size", F.element_at(F.array(F.lit("strong"), F.lit("possible"), F.lit("weak")), F.col("_o") + 1).alias("strength"),
        F.when(F.col("_last") == 0, "auto").otherwise("possible_pending").alias("status"), F.array_join("_rules", ",").alias("matched_rules"))
    clusters = materialize(clusters, "clusters")

    def members() -> DataFrame:
        held = meet(comp, clusters.select(F.col("canonical_lead_id").alias("component"), "status", "size"), ["component"], "size", ["node"])
        role = F.when(F.col("node") == F.col("component"), "canonical").otherwise("member").alias("role")
        if not rules:
            return held.select(F.col("component").alias("canonical_lead_id"), F.col("node").alias("lead_id"), role, "status")
        return held.join(e.best(), F.col("node") == F.col("lead_id")).select(F.col("component").alias("canonical_lead_id"), "lead_id", role, "rule", "strength", "related_lead_id", "status")

    return clusters, members()


def merge_clusters(stored: DataFrame, stored_members: DataFrame, clusters: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, members, report) after a new resolution is merged into stored clusters.

    stored: cluster_id (long), company_id, canonical_lead_id, status, strength, matched_rules; stored_members: cluster_id,
    lead_id, role, rule, strength. clusters and members are those of resolve_identities().

    A new cluster and a stored one of its company meet if they share a lead. What meets, directly or through others, ends
    in one cluster: chains are the components of the graph of both, so a chain of absorptions has one result whatever the
    order. Of its stored clusters that which shares most leads with the chain goes on (of equal ones the smallest id) and
    takes over the others' members. Its canonical lead is the smallest of the chain's new clusters, its strength the
    strongest, and it is `auto` only if all of them are: a new possible link calls for review again. A new cluster that
    meets none is created under `new:` and its canonical lead; a stored one that meets none stays as it is.

    clusters: cluster_id (string), company_id, canonical_lead_id, status, strength, matched_rules, change (created, reused,
    kept), absorbed. members: cluster_id, lead_id, role, rule, strength, change (created, updated, unchanged; kept: in no
    new cluster), moved. report: clusters_created, clusters_reused (new clusters that met one), clusters_total,
    members_created, members_updated, members_unchanged, members_total.
    """
    new = materialize(members.select("canonical_lead_id", "lead_id", "rule", "strength").join(clusters.select("canonical_lead_id", "company_id"), "canonical_lead_id"), "new")
    old = materialize(stored_members.join(stored.select("cluster_id", "company_id"), "cluster_id").select("cluster_id", "company_id", "lead_id", "role", "rule", "strength"), "old")
    shared = materialize(new.join(old.select("cluster_id", "company_id", "lead_id"), ["company_id", "lead_id"]).groupBy("canonical_lead_id", "cluster_id").agg(F.count("*").alias("n")), "shared")
    mine, theirs = F.concat(F.lit("new:"), F.col("canonical_lead_id")), F.concat(F.lit("old:"), F.col("cluster_id").cast("string"))
    chains = materialize(components(shared.select(mine.alias("a"), theirs.alias("b")), "chains"), "chains")
    of_new = chains.where("node LIKE 'new:%'").select(F.substring("node", 5, 1 << 30).alias("canonical_lead_id"), "component")
    of_old = chains.where("node LIKE 'old:%'").select(F.substring("node", 5, 1 << 30).cast("long").alias("cluster_id"), "component")
    weights = shared.groupBy("cluster_id").agg(F.sum("n").alias("n")).join(of_old, "cluster_id")
    targets = weights.groupBy("component").agg((-F.max(F.struct("n", (-F.col("cluster_id")).alias("x")))["x"]).cast("string").alias("target"), (F.count("*") - 1).alias("absorbed"))
    targets = materialize(targets, "targets")
    # new clusters by the cluster that they end in, and what that is made of
    ends = clusters.join(of_new.join(targets, "component"), "canonical_lead_id", "left").withColumn("cluster_id", F.coalesce("target", F.concat(F.lit("new:"), F.col("canonical_lead_id"))))
    ends = materialize(ends.select("canonical_lead_id", "cluster_id", "company_id", "status", "strength", "matched_rules", F.col("target").isNotNull().alias("met"), F.coalesce("absorbed", F.lit(0)).cast("long").alias("absorbed")), "ends")
    order = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "possible", 1).otherwise(2)
    made = ends.groupBy("cluster_id").agg(
        F.min("company_id").alias("company_id"), F.min("canonical_lead_id").alias("canonical_lead_id"), F.when(F.bool_and(F.col("status") == "auto"), "auto").otherwise("possible_pending").alias("status"),
        F.min_by("strength", order).alias("strength"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("matched_rules", ","))))), ",").alias("matched_rules"),  # three rules
        F.when(F.bool_or("met"), "reused").otherwise("created").alias("change"), F.max("absorbed").alias("absorbed"))
    kept = stored.join(of_old.select("cluster_id"), "cluster_id", "left_anti").select(F.col("cluster_id").cast("string").alias("cluster_id"), "company_id", "canonical_lead_id", "status", "strength", "matched_rules", F.lit("kept").alias("change"), F.lit(0).cast("long").alias("absorbed"))
    out = materialize(made.unionByName(kept), "merged")
    # members: of a lead's rows in a chain that of the surviving cluster counts, else that of the smallest id
    moved = old.join(of_old.join(targets.select("component", "target"), "component"), "cluster_id", "left").withColumn("own", F.coalesce("target", F.col("cluster_id").cast("string")))
    best = F.min(F.struct((F.col("own") != F.col("cluster_id").cast("string")).alias("moved"), "cluster_id", "role", "rule", "strength")).alias("was")
    before = moved.groupBy(F.col("own").alias("cluster_id"), "lead_id").agg(best)
    after = new.join(ends.select("canonical_lead_id", "cluster_id"), "canonical_lead_id").select("cluster_id", "lead_id", F.struct("rule", "strength").alias("now"))
    sizes = out.select("cluster_id", F.col("canonical_lead_id").alias("_canonical"))
    both = before.join(after, ["cluster_id", "lead_id"], "full")
    counted = materialize(both.groupBy("cluster_id").agg(F.count("*").alias("_n")).join(sizes, "cluster_id"), "sizes")
    both = meet(both, counted, ["cluster_id"], "_n", ["lead_id"])
    role = F.when(F.col("now").isNull(), F.col("was.role")).when(F.col("lead_id") == F.col("_canonical"), "canonical").otherwise("member")
    rule, strength = F.coalesce("now.rule", "was.rule"), F.coalesce("now.strength", "was.strength")
    same = role.eqNullSafe(F.col("was.role")) & rule.eqNullSafe(F.col("was.rule")) & strength.eqNullSafe(F.col("was.strength"))
    change = F.when(F.col("now").isNull(), "kept").when(F.col("was").isNull(), "created").when(same, "unchanged").otherwise("updated")
    people = materialize(both.select("cluster_id", "lead_id", role.alias("role"), rule.alias("rule"), strength.alias("strength"), change.alias("change"), F.coalesce("was.moved", F.lit(False)).alias("moved")), "people")
    counts = {f"members_{c}": F.count_if(F.col("change") == c) for c in ("created", "updated", "unchanged")} | {"members_total": F.count("*")}
    report = ends.agg(F.count_if(~F.col("met")).alias("clusters_created"), F.count_if("met").alias("clusters_reused")).join(out.agg(F.count("*").alias("clusters_total"))).join(people.agg(*(v.alias(k) for k, v in counts.items())))
    return out, people, report


def identity_report(evidence: Evidence, clusters: DataFrame) -> DataFrame:
    """(metric, value): leads, edges by rule, discarded pairs, clusters and members by size. Pairs are counted and not listed."""
    couples = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0)).cast("long")
    every = evidence.each.groupBy(*PHONE).agg(F.sum("n").alias("n")).agg(couples("n").alias("value"))
    strong = evidence.mails.agg(couples("_n").alias("value"))
    possible = evidence.inside().unionByName(evidence.between()).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("value"))
    each = every.withColumn("k", F.lit("every")).unionByName(strong.withColumn("k", F.lit("strong"))).unionByName(possible.withColumn("k", F.lit("possible")))
    sums = each.groupBy().pivot("k", ["every", "strong", "possible"]).agg(F.first("value"))
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in ((f"edges {STRONG}", F.col("strong")), (f"edges {POSSIBLE}", F.col("possible")), ("pairs discarded", F.col("every") - F.col("strong") - F.col("possible")))))
    parts = [
        evidence.leads.agg(F.lit("leads_evaluated").alias("metric"), F.count("*").alias("value")),
        sums.select(F.explode(rows).alias("r")).select("r.metric", "r.value").where("value > 0"),
        clusters.groupBy(F.concat(F.lit("clusters of "), "size").alias("metric")).agg(F.count("*").alias("value")),
        clusters.groupBy(F.concat(F.lit("status "), "status").alias("metric")).agg(F.count("*").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster_conversations(members: DataFrame, chats: DataFrame) -> DataFrame:
    """All conversations of a cluster's leads, oldest first, without a date last."""
    return chats.join(members.select("canonical_lead_id", "lead_id"), "lead_id").orderBy("canonical_lead_id", F.col("started_at").asc_nulls_last(), "conversation_id")
