"""The daily job: its log, and a run that goes on where another one ended."""

import pytest
from pyspark.sql import functions as F

from leadspark.operators import assign
from leadspark.plans import jobs, queries
from leadspark.sources import bridge

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def inputs(spark):
    names = ("raw_leads", "org", "catalog", "advisors")
    return [*(bridge.read(spark, SMALL, n) for n in names), queries.talks(spark, SMALL).select("conversation_id", "lead_id", "messages")]


def test_a_run_that_failed_goes_on_with_the_failed_stage(spark, inputs, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    run = lambda **more: jobs.lead_pipeline(spark, *inputs, params=queries.PARAMS, fuzzy=False, store=store, **more)

    def broken(*_):
        raise ValueError("no desk " + "x" * 2000)

    with monkeypatch.context() as m:
        m.setattr(assign, "assign_leads", broken)
        tables, log = run()
    first = {r.stage: r for r in log.collect()}
    assert [r.status for r in first.values()] == ["ok"] * 5 + ["failed"] and "assignments" not in tables and first["assignments"].error.endswith("x" * 2000)
    assert set(first["leads"].sources) == {"raw", "org", "catalog", "advisors", "talks"} and all(len(h) == 64 for h in first["leads"].sources.values())
    tables, log = run()
    again = {r.stage: r for r in log.collect()}
    assert [r.status for r in again.values()] == ["reused"] * 5 + ["ok"] and {k: r.rows for k, r in again.items() if k != "assignments"} == {k: r.rows for k, r in first.items() if k != "assignments"}
    assert tables["assignments"].count() > 0 and jobs.run_log(spark, store).count() == 12
    # other sources, another run
    inputs[3] = inputs[3].withColumn("daily_capacity", F.col("daily_capacity") + 1)
    assert {r.status for r in run()[1].collect()} == {"ok"} and jobs.run_log(spark, store).select("run").distinct().count() == 2


def test_fingerprints_depend_on_rows_and_not_on_their_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "c")]
    of = lambda x: jobs.fingerprint(spark.createDataFrame(x, "n int, s string").repartition(3))
    assert of(rows) == of(rows[::-1]) and len({of(rows), of(rows[1:]), of([*rows, (2, None)]), of([(1, "a"), (3, "c")])}) == 4
