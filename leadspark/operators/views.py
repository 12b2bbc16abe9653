"""Views for supervisors, advisors and analysts: scoping, filters, joins for display, order and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import fields as f
from leadspark.functions.text import contains_ci
from leadspark.operators.ingest import latest_current
from leadspark.operators.models import match_models
from leadspark.scratch import materialize, meet

UNKNOWN = "Desconocido"


def scope_rows(leads: DataFrame, role: str, company: str | None = None, advisor: str | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """advisor: leads with an own current assignment; supervisor: the company's; admin: all, or a company's; any other role: none."""
    if role == "advisor" and assignments is not None:
        own = assignments.where(F.col("is_current") & (F.col("advisor_id") == advisor)).select("lead_id").distinct()
        return leads.join(own, "lead_id", "left_semi")
    if role == "supervisor" or (role == "admin" and company is not None):
        return leads.where(F.col("company_id").eqNullSafe(F.lit(company)) & F.lit(company is not None))
    return leads if role == "admin" else leads.where(F.lit(False))


def filter_rows(rows: DataFrame, contains: dict[str, str] | None = None, **equal) -> DataFrame:
    """Rows with the given values (None: any), and columns that contain a text, whatever its case."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for column, text in (contains or {}).items():
        rows = rows.where(contains_ci(F.col(column), F.lit(text)))
    return rows


def signal_filter(rows: DataFrame, column: str, state: str) -> DataFrame:
    """state: any (there), none (false or absent by name) or undetermined (unknown); unknown is never no."""
    if state == "any":
        return rows.where(F.coalesce(F.col(column).cast("string"), F.lit("false")) != "false")
    return rows.where(F.col(column).isNull()) if state == "undetermined" else rows.where(F.col(column).cast("string") == "false")


def supervision_rows(assignments: DataFrame, leads: DataFrame, scores: DataFrame, catalog: DataFrame, advisors: DataFrame) -> DataFrame:
    """A display row for each current assignment: lead, model, city, band and advisor; left joins, one pass."""
    a = assignments.where("is_current").select("lead_id", "company_id", "point_of_sale_id", "run_date", "priority_rank", "advisor_id", F.col("status").alias("assignment_status"))
    out = a.join(leads.select("lead_id", "customer_name", "status", "city_raw", "city_normalized", "model_text_raw", "sku"), "lead_id", "left").join(scores.select("lead_id", "queue", "band"), "lead_id", "left")
    out = out.join(catalog.select("sku", "brand", "line"), "sku", "left").join(advisors.select("advisor_id", F.col("name").alias("_advisor")), "advisor_id", "left")
    return out.select("lead_id", "customer_name", "status", "company_id", "point_of_sale_id", "run_date", "priority_rank", "assignment_status", F.coalesce("_advisor", F.when(F.col("advisor_id").isNull(), "Sin asignar (overflow)"), "advisor_id").alias("advisor"),
                      model_label().alias("model"), city_label().alias("city"), "queue", "band")


def model_label() -> Column:
    return F.coalesce(F.when(F.col("brand").isNotNull(), F.concat_ws(" ", "brand", "line")), F.col("model_text_raw"), F.lit(UNKNOWN))


def city_label() -> Column:
    return F.coalesce("city_normalized", "city_raw", F.lit(UNKNOWN))


def bool_label(c: Column) -> Column:
    return F.when(c, "Sí").when(~c, "No").otherwise(UNKNOWN)


def supervision_counters(rows: DataFrame) -> DataFrame:
    """(band, assignment_status, n, leads)."""
    return rows.groupBy("band", "assignment_status").agg(F.count("*").alias("n"), F.count_distinct("lead_id").alias("leads"))


def lifecycle_counters(leads: DataFrame, *by: str) -> DataFrame:
    s = F.col("status")
    return leads.groupBy(*by).agg(F.count_if(f.is_open(s)).alias("open"), F.count_if(s == "Cerrado").alias("closed"), F.count_if(s == "Perdido").alias("lost"), F.count_if(s == "Descartado").alias("discarded"))


def pending_conversations(talks: DataFrame, extractions: DataFrame) -> DataFrame:
    """Conversations without a current extraction; error rows are never current."""
    return talks.join(extractions.where("is_current").select("conversation_id"), "conversation_id", "left_anti")


def analyzed_conversations(talks: DataFrame, extractions: DataFrame, scores: DataFrame, assignments: DataFrame) -> DataFrame:
    """Conversations with a current success, their lead's band and number of assignments (joined as counts, so no rows multiply)."""
    e = extractions.where("is_current and status = 'success'").drop("lead_id")
    n = assignments.groupBy("lead_id").agg(F.count("*").alias("assignments"))
    return talks.join(e, "conversation_id").join(scores.select("lead_id", "band"), "lead_id", "left").join(n, "lead_id", "left").withColumn("assignments", F.coalesce("assignments", F.lit(0)))


def batch_status(batch: DataFrame, talks: DataFrame, leads: DataFrame, extractions: DataFrame) -> DataFrame:
    """(conversation_id, lead_id, company_id, status) of the conversations of a batch; pending without a current extraction."""
    now = extractions.where("is_current").select("conversation_id", F.col("status").alias("_s"))
    out = batch.select("conversation_id").join(talks.select("conversation_id", "lead_id"), "conversation_id", "left").join(leads.select("lead_id", "company_id"), "lead_id", "left").join(now, "conversation_id", "left")
    return out.select("conversation_id", "lead_id", "company_id", F.coalesce("_s", F.lit("pending")).alias("status"))


def claimed_models(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(lead_id, sku): the product that each of texts (lead_id, text) names, as match_models() finds it; ambiguous and unknown ones have none."""
    return match_models(texts, catalog, "text", candidates=False).where("match_state = 'matched'").select("lead_id", "sku")


def model_inconsistency(leads: DataFrame, claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """(lead_id, sku, claimed_sku, kind): a chat names another product than the lead: of the same brand, or of another. claims: lead_id, sku; ambiguous ones have none."""
    c = catalog.select("sku", "brand")
    d = claims.where("sku is not null").select("lead_id", F.col("sku").alias("claimed_sku")).distinct().join(leads.where("sku is not null").select("lead_id", "sku"), "lead_id").where("sku <> claimed_sku")
    d = d.join(c.withColumnRenamed("brand", "_own"), "sku").join(c.select(F.col("sku").alias("claimed_sku"), F.col("brand").alias("_claimed")), "claimed_sku")
    return d.select("lead_id", "sku", "claimed_sku", F.when(F.col("_own") == F.col("_claimed"), "same_brand").otherwise("other_brand").alias("kind"))


def lead_detail(leads: DataFrame, scores: DataFrame, assignments: DataFrame, talks: DataFrame) -> DataFrame:
    """A row per lead with its score, current assignment and conversation ids (of one lead, so bounded)."""
    c = talks.groupBy("lead_id").agg(F.array_join(F.array_sort(F.collect_list("conversation_id")), ",").alias("conversations"))
    a = latest_current(assignments.select("lead_id", "run_date", "advisor_id", "priority_rank", "is_current"), "lead_id", "run_date", "priority_rank").select("lead_id", "advisor_id", "priority_rank")
    return leads.select("lead_id", "customer_name", "status").join(scores.select("lead_id", "queue", "band"), "lead_id", "left").join(a, "lead_id", "left").join(c, "lead_id", "left")


def status_transitions(leads: DataFrame, events: DataFrame) -> DataFrame:
    """leads (lead_id, status, closed_at, close_reason) after all events (lead_id, new_status, reason, at, event_id), in order of at and event_id; with applied, unknown and reopenings (how many of each).

    An unknown status is rejected, and so is reopening a terminal lead. Closing sets closed_at once and a reason (the
    given one, else the stored one, else Otro); an open status clears both. Events without a time come first.

    A lead that is terminal stays so, hence a run of events is summed up by its first terminal event, the last open one
    before it, and the last terminal one and last valid reason from there on: minima and maxima that combine in any order,
    so a lead's events are neither sorted nor collected. The first terminal event is found first; then all others are
    judged by it.
    """
    e = events.select("lead_id", "new_status", "reason", F.struct("at", "event_id").alias("_at"))
    known, ends = f.is_known_status(F.col("new_status")), f.is_terminal(F.col("new_status"))
    first = e.groupBy("lead_id").agg(F.min(F.when(ends, F.col("_at"))).alias("_first"), F.count("*").alias("_n"))
    start = materialize(first.join(leads.select("lead_id", f.is_terminal(F.col("status")).alias("_ended")), "lead_id"), "first")
    x = meet(e, start, ["lead_id"], "_n", ["_at", "new_status"])
    late = F.col("_ended") | F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    opened, closed = known & ~ends & ~late, ends
    reason = f.normalize_close_reason(F.col("reason"))
    sums = x.groupBy("lead_id").agg(
        F.max_by(F.when(opened, F.col("new_status")), F.when(opened, F.col("_at"))).alias("_open"), F.max_by(F.when(closed, F.col("new_status")), F.when(closed, F.col("_at"))).alias("_end"), F.min(F.when(closed, F.col("_at"))).alias("_first"),
        F.max_by(F.when(closed & reason.isNotNull(), reason), F.when(closed & reason.isNotNull(), F.col("_at"))).alias("_reason"),
        F.count_if(opened | closed).alias("applied"), F.count_if(~known).alias("unknown"), F.count_if(known & ~ends & late).alias("reopenings"))
    y = leads.select("lead_id", "status", "closed_at", "close_reason").join(sums, "lead_id", "left")
    cleared, end = F.col("_open").isNotNull(), F.col("_end").isNotNull()
    old_time, old_reason = F.when(~cleared, F.col("closed_at")), F.when(~cleared, F.col("close_reason"))
    return y.select("lead_id", F.coalesce("_end", "_open", "status").alias("status"), F.when(end, F.coalesce(old_time, F.col("_first.at"))).otherwise(old_time).alias("closed_at"),
                    F.when(end, F.coalesce("_reason", f.normalize_close_reason(old_reason), F.lit("Otro"))).otherwise(old_reason).alias("close_reason"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("applied", "unknown", "reopenings")))


def page(rows: DataFrame, order: list, number: int, size: int = 50) -> tuple[DataFrame, int, int, int]:
    """(rows of the page, page, total, pages); numbers out of range go to the nearest page."""
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), number, total, pages


def page_after(rows: DataFrame, order: list[tuple[str, bool]], last: tuple | None, size: int = 50) -> DataFrame:
    """The next page by key: order is (column, descending) with a unique last column and no nulls, last the order's values in
    the last row shown. A deep page costs as much as the first: rows before it are filtered and not sorted."""
    if last is not None:
        past = F.lit(False)
        for i in reversed(range(len(order))):
            c, down = order[i]
            past = (F.col(c) < F.lit(last[i]) if down else F.col(c) > F.lit(last[i])) | ((F.col(c) == F.lit(last[i])) & past)
        rows = rows.where(past)
    return rows.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order)).limit(size)


def priority_reasons(reasons: Column) -> Column:
    """Commercial and urgency reasons; quality does not count towards the queue."""
    return F.filter(reasons, lambda r: r["dimension"].isin("commercial", "urgency"))


def analyzed_order(kind: str = "analyzed_desc") -> list[Column]:
    """Order of analysed conversations: analyzed_desc, analyzed_asc, conversation_desc or conversation_asc; ties by id."""
    column = F.col("started_at" if kind.startswith("conversation") else "created_at")
    return [column.asc() if kind.endswith("_asc") else column.desc(), F.col("conversation_id").asc()]


def trim_lists(rows: DataFrame, size: int = 25) -> DataFrame:
    """Array columns cut to their first items, for display."""
    arrays = [c for c, kind in rows.dtypes if kind.startswith("array")]
    return rows.withColumns({c: F.slice(c, 1, size) for c in arrays}) if arrays else rows
