"""Every registered job against its check SQL on the smallest tables, and plan properties."""

import duckdb
import pytest
from conftest import ROOT

import __spark_entry__ as entry
from leafaudit.plans import derived as dv
from leafaudit.plans import issue_jobs, registry
from leafaudit.plans.library_jobs import page_listing
from leafaudit.plans.registry import Inputs
from leafaudit.operators import fidelity, library, state
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"
JOBS, CHECKS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job_equals_check(spark, duck, name):
    df = JOBS[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = canon(df.toArrow().to_pandas())
    assert name in CHECKS, "every registered job has a check"
    want = canon(duck.execute(CHECKS[name]).to_arrow_table().to_pandas())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["book", "page", "total_missing", "missing_text"]


def test_overview_never_reads_page_bodies(spark):
    inp = Inputs(spark, SF)
    plan = plan_of(library.overview_rollup(inp.derive(dv.host_books), inp.derive(page_listing)))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("html" not in line for line in schemas)


def test_top_n_is_cut_before_the_shuffle(spark):
    log = Inputs(spark, SF).derive(dv.live_log)
    assert "WindowGroupLimit" in plan_of(state.log_tail(log, 5))


def test_token_loss_joins_no_token_tables(spark):
    inp = Inputs(spark, SF)
    plan = plan_of(fidelity.token_loss(inp.derive(dv.corpus), inp.derive(dv.rendered), ["book", "page"]))
    assert "Union" in plan and plan.count("Join ") <= 2


def test_no_names_that_do_not_belong():
    for path in ROOT.rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(encoding="utf-8") or path.name == "test_registry.py"


def test_gate_of_verdicts_takes_no_join(spark):
    pages = Inputs(spark, SF).derive(dv.delivered)
    got = issue_jobs.gated(pages)
    assert "Join" not in plan_of(got) and got.columns == ["book", "lang", "page", "valid", "empty"]
    assert got.filter("empty").count() == pages.filter("html = ''").count() > 0
