"""Assignment of leads to advisors of their branch by remaining capacity, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadspark.functions.fields import is_terminal
from leadspark.operators.ingest import priority_rank
from leadspark.scratch import ranked

GROUP = ("company_id", "point_of_sale_id")


def eligible_candidates(leads: DataFrame, scores: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(lead_id, company, branch, queue) of open leads with a score that are not secondary members of an identity cluster."""
    out = leads.where(~is_terminal(F.col("status"))).select("lead_id", *GROUP).join(scores.select("lead_id", "queue"), "lead_id")
    if members is not None:
        out = out.join(members.where("role <> 'canonical' and status <> 'discarded'").select("lead_id"), "lead_id", "left_anti")
    return out


def open_load(assignments: DataFrame, leads: DataFrame) -> DataFrame:
    """(advisor_id, load): open leads whose current assignment is the advisor's."""
    live = leads.where(~is_terminal(F.col("status"))).select("lead_id")
    return assignments.where("is_current and status = 'assigned'").join(live, "lead_id", "left_semi").groupBy("advisor_id").agg(F.count("*").alias("load"))


def available_capacity(advisors: DataFrame, load: DataFrame | None = None) -> DataFrame:
    """advisors that are active, with remaining: capacity minus load, 0 at least."""
    a = advisors.where("active and daily_capacity > 0")
    a = a.join(load, "advisor_id", "left") if load is not None else a.withColumn("load", F.lit(0))
    return a.withColumn("remaining", F.greatest(F.lit(0), F.col("daily_capacity") - F.coalesce("load", F.lit(0))))


def assign_leads(candidates: DataFrame, advisors: DataFrame, kept: DataFrame | None = None, load: DataFrame | None = None) -> DataFrame:
    """A decision for each candidate: priority_rank, advisor_id, status (assigned or overflow) and reason.

    Giving each lead to the advisor with the most capacity left is the same as numbering the advisors' slots (r, r-1,
    ..., 1 of an advisor with r left; larger first, then advisor) and the leads (by rank), and joining on the number.
    kept (lead_id, advisor_id): open leads stay with an active advisor of their branch and take no slot.
    """
    queue = priority_rank(candidates)
    pool = available_capacity(advisors, load)
    if kept is None:
        queue = queue.withColumns({"_keep": F.lit(None).cast("string"), "_slot": F.col("priority_rank")})
    else:
        stay = kept.join(pool.select("advisor_id", *(F.col(c).alias(f"_{c}") for c in GROUP)), "advisor_id").select(F.col("lead_id").alias("_lead"), F.col("advisor_id").alias("_keep"), *(f"_{c}" for c in GROUP))
        queue = queue.join(stay, (F.col("lead_id") == F.col("_lead")) & (F.col("company_id") == F.col("_company_id")) & (F.col("point_of_sale_id") == F.col("_point_of_sale_id")), "left").drop("_lead", "_company_id", "_point_of_sale_id")
        queue = ranked(queue.withColumn("_stays", F.col("_keep").isNotNull()), [*GROUP, "_stays"], [F.col("priority_rank").asc()], "_place")
        queue = queue.withColumn("_slot", F.when(~F.col("_stays"), F.col("_place")))
    # a branch's slots are its advisors' places of one day: bounded by its staff, not by the leads
    slots = pool.where("remaining > 0").select(*GROUP, "advisor_id", F.explode(F.sequence(F.lit(1), F.col("remaining"))).alias("_left"))
    slots = slots.withColumn("_slot", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("_left").desc(), "advisor_id")))
    out = queue.join(slots.select(*GROUP, "_slot", F.col("advisor_id").alias("_given")), [*GROUP, "_slot"], "left")
    advisor = F.coalesce("_keep", "_given")
    reason = (F.when(F.col("_keep").isNotNull(), "continuidad: conserva el asesor vigente").when(F.col("_given").isNull(), "sin_capacidad")
              .otherwise(F.concat(F.lit("rank "), "priority_rank", F.lit(" por prioridad en "), "company_id", F.lit("/"), "point_of_sale_id", F.lit("; asesor con mayor capacidad restante"))))
    return out.select("lead_id", *GROUP, "queue", "priority_rank", advisor.alias("advisor_id"), F.when(advisor.isNull(), "overflow").otherwise("assigned").alias("status"), reason.alias("reason"))


def check_decisions(decisions: DataFrame, org: DataFrame, advisors: DataFrame) -> DataFrame:
    """Decisions that break the organisation, with the violation; none is right."""
    owner = org.select(F.col("point_of_sale_id").alias("_pos"), F.col("company_id").alias("_owner"))
    home = advisors.select(F.col("advisor_id").alias("_advisor"), F.col("company_id").alias("_home"), F.col("point_of_sale_id").alias("_branch"))
    out = decisions.join(owner, F.col("point_of_sale_id") == F.col("_pos"), "left").join(home, F.col("advisor_id") == F.col("_advisor"), "left")
    bad = (F.when(F.col("_owner").isNull(), "unknown_point_of_sale").when(F.col("_owner") != F.col("company_id"), "foreign_company")
           .when(F.col("advisor_id").isNotNull() & (F.col("_home").isNull() | (F.col("_home") != F.col("company_id")) | (F.col("_branch") != F.col("point_of_sale_id"))), "foreign_advisor"))
    return out.withColumn("violation", bad).where("violation is not null").select(*decisions.columns, "violation")


def assignment_summary(decisions: DataFrame) -> DataFrame:
    """(company, branch, candidates, assigned, overflow, advisors)."""
    return decisions.groupBy(*GROUP).agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "assigned").alias("assigned"), F.count_if(F.col("status") == "overflow").alias("overflow"), F.count_distinct("advisor_id").alias("advisors"))


def snapshot_assignments(stored: DataFrame, decisions: DataFrame, run_date: str) -> DataFrame:
    """stored with the rows of this run date no longer current, plus the decisions; other dates keep their flags."""
    day = F.to_date(F.lit(run_date))
    old = stored.withColumn("is_current", F.col("is_current") & (F.col("run_date") != day))
    new = decisions.withColumns({"run_date": day, "is_current": F.lit(True)})
    return old.unionByName(new.select(*stored.columns))


def changed(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """(lead_id, advisor_id, status, priority_rank, side) in one of the two and not in the other: none means nothing to write."""
    columns = ("lead_id", "advisor_id", "status", "priority_rank")
    a, b = current.select(*columns), decisions.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("gone")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
