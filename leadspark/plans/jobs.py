"""Jobs: the daily lead pipeline with its run log, and the quality audit."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import assign, audit, identity, ingest, models, scoring, signals
from leadspark.scratch import materialize

LOG = "run string, stage string, status string, rows long, seconds double, error string, sources map<string,string>"
#: Part of a run's key: a change of the stages' results begins runs anew.
VERSION = "2"


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number, and the sum and the exclusive or of two hashes of each row. One pass, combined before the shuffle."""
    x, y = F.xxhash64(*df.columns), F.xxhash64(F.lit("second"), *df.columns)
    r = df.select(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.bit_xor("y").alias("b")).first()
    return hashlib.sha256(f"{df.columns}:{r.n}:{r.s}:{r.b}".encode()).hexdigest()


def run_log(spark: SparkSession, store: str) -> DataFrame:
    """The log of all runs under store; empty before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/log")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{store}/log")


def lead_pipeline(spark: SparkSession, raw: DataFrame, org: DataFrame, catalog: DataFrame, advisors: DataFrame, talks: DataFrame, extractions: DataFrame | None = None, params: dict | None = None, fuzzy: bool = True,
                  open_load: DataFrame | None = None, kept: DataFrame | None = None, store: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, log). Stages: leads, conversations, members, signals, scores, assignments; each is written before the next reads it.

    Stage leads writes two tables: leads, and candidates (model_text_raw, candidates), a row for each ambiguous product
    text, as its list grows with the catalogue and is the same for all leads that have the text.

    A failing stage ends the run; what earlier stages wrote stays, and the log tells the whole error. talks:
    conversation_id, lead_id, messages. extractions: validated rows with lead_id; without them the rules read the chats.
    open_load (advisor_id, load) and kept (lead_id, advisor_id) go to the assignment.

    With store, a folder all executors share, tables are kept under it by the run's key, the hash of all sources'
    fingerprints and the parameters, and the log is a table there (run_log). A run with the same sources reads what it has
    finished before, status `reused`, and goes on with the first stage that is missing; other sources make another run.
    """
    tables: dict[str, DataFrame] = {}
    log: list[tuple] = []
    inputs = {"raw": raw, "org": org, "catalog": catalog, "advisors": advisors, "talks": talks, "extractions": extractions, "open_load": open_load, "kept": kept}
    sources = {k: fingerprint(v) for k, v in inputs.items() if v is not None} if store else {}
    run = hashlib.sha256(json.dumps([VERSION, sources, params, fuzzy], sort_keys=True, default=str).encode()).hexdigest()[:16]
    done = {r.stage for r in run_log(spark, store).where((F.col("run") == run) & (F.col("status") == "ok")).select("stage").collect()} if store else set()

    def consolidated() -> DataFrame:
        if extractions is not None:
            return signals.consolidate(extractions)
        return signals.consolidate(signals.labels_as_extractions(signals.weak_labels(talks)))

    def scored() -> DataFrame:
        s = scoring.lead_signals(tables["leads"], catalog, tables["signals"], tables["conversations"].where("status = 'linked'"))
        return scoring.score_leads(s, params)

    def keep(name: str, df: DataFrame) -> DataFrame:
        if not store:
            return materialize(df, name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/{run}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store}/{run}/{name}")

    stages: list[tuple[str, Callable[[], DataFrame]]] = [
        ("leads", lambda: ingest.normalize_leads(raw, org, catalog, fuzzy=fuzzy, candidates=False)),
        ("conversations", lambda: ingest.link_conversations(talks, tables["leads"])),
        ("members", lambda: identity.resolve_identities(tables["leads"])[1]),
        ("signals", consolidated), ("scores", scored),
        ("assignments", lambda: assign.assign_leads(assign.eligible_candidates(tables["leads"], tables["scores"], tables["members"]), advisors, kept, open_load))]
    for name, stage in stages:
        begun = time.time()
        try:
            reused = name in done
            tables[name] = spark.read.parquet(f"{store}/{run}/{name}") if reused else keep(name, stage())
            if name == "leads":
                tables["candidates"] = spark.read.parquet(f"{store}/{run}/candidates") if reused else keep("candidates", models.candidate_lists(tables["leads"], catalog))
            log.append((run, name, "reused" if reused else "ok", tables[name].count(), round(time.time() - begun, 3), None, sources))
        except Exception as e:  # noqa: BLE001  logged; the run ends here
            log.append((run, name, "failed", None, round(time.time() - begun, 3), f"{type(e).__name__}: {e}", sources))
        if store:
            spark.createDataFrame(log[-1:], LOG).coalesce(1).write.mode("append").parquet(f"{store}/log")
        if log[-1][2] == "failed":
            break
    return tables, spark.createDataFrame(log, LOG)


def quality_audit(raw: DataFrame, org: DataFrame, catalog: DataFrame, advisors: DataFrame, history: DataFrame, talks: DataFrame) -> dict[str, DataFrame]:
    """The audit's tables by name, ready for write_tables()."""
    columns = list(ingest.RAW)
    matched = materialize(ingest.normalize_leads(raw, org, catalog, fuzzy=False, candidates=False), "matched")
    stock = {} if "availability" not in catalog.columns else {"availability": audit.availability_check(catalog, org, advisors), "all_issues": audit.issues(raw, columns, matched, org, catalog, advisors, history, talks)}
    return stock | {
        "structure": audit.profile_columns(raw, columns), "missing": audit.missing_values(raw, columns), "issues": audit.issue_catalog(raw), "duplicates": audit.duplicate_keys(raw, "lead_id"), "phone_formats": raw.groupBy(audit.f.phone_format(F.col("telefono")).alias("format")).count(),
        "date_formats": audit.date_formats(raw, ["fecha_registro", "fecha_primer_contacto"]), "chronology": audit.chronology(raw), "catalog": audit.catalog_summary(catalog), "advisors": audit.advisor_summary(advisors, org), "history": audit.history_distribution(history),
        "history_catalog": audit.history_vs_catalog(history, catalog), "unknown_models": audit.unknown_models(history, catalog, matched), "orphans": talks.join(raw.select("lead_id").distinct(), "lead_id", "left_anti").select("conversation_id", "lead_id")}
