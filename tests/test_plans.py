"""Physical-plan checks: shuffles, pushdown, no Python in the hot path, broadcast sides."""

import re

import pytest

import __spark_entry__ as E
from cohortlens.operators import cleaning, funnel
from cohortlens.plans import Pipeline
from helpers import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)


@pytest.fixture(scope="module")
def pipe(spark):
    return Pipeline.from_testdata(spark, SF_SMALL, run_date="2024-02-01")


def test_clean_events_shuffles_events_once(pipe):
    p = plan(pipe.clean_events)
    ex = exchanges(p)
    # event rows are shuffled once, by user: dedupe and windows work within that partitioning
    # (the slice is the constant 0 when no user is hot); the lookup side is broadcast
    assert sum("_uk" in e for e in ex) == 1
    assert not any("event_name" in e for e in ex)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


@pytest.mark.parametrize("name, columns", [
    ("validity_cohort_size", {"user_id", "event_type", "props", "event_id"}),
    ("validity_distinct_platform", {"user_id", "event_type", "props", "event_id"}),
    ("dq_lookup_coverage", {"user_id", "event_type", "props", "event_id"})])
def test_profiles_write_nothing_and_prune(spark, name, columns, monkeypatch):
    """Answers that duplicates cannot change: no intermediate table, no dedupe, a pruned scan."""
    from cohortlens.sources import sinks

    monkeypatch.setattr(sinks, "recorder", lambda what, df: pytest.fail(f"wrote {what}"))
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert not any("event_name" in e for e in exchanges(p))
    for s in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert {c.split(":")[0] for c in s.split(",")} <= columns | {"n_nationkey", "n_name"}


def test_plans_behind_written_tables(spark, monkeypatch):
    """The plans of written intermediates count too: the clean chain writes only the narrow user
    profile and the hot users, never event rows, when no user is hot."""
    from cohortlens.sources import sinks

    seen = []
    monkeypatch.setattr(sinks, "recorder", lambda what, df: seen.append((what, df.columns)))
    E.queries()["clean_events"](spark, SF_SMALL)
    assert [w for w, _ in seen] == ["user_profile", "hot_users"]
    assert all("event_name" not in c for _, c in seen)


def test_no_python_in_significance(pipe):
    p = plan(pipe.significance_results)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_report_is_one_pass_over_sessions(pipe):
    rep = funnel.build_funnel_report(pipe.session_funnel)
    p = plan(rep)
    gens = [ln for ln in p.split("\n") if "Generate explode" in ln and "step_id" in ln]
    assert len(gens) == 1  # one explode over the session rows, no seven-branch union
    assert "Union" not in p


def test_dedupe_is_partially_aggregated(spark):
    df = cleaning.dedup_exact(cleaning.drop_staging(E._raw(spark, SF_SMALL)))
    p = plan(df)
    assert "partial_min" in p  # copies collapse map-side, before the exchange


def test_scan_prunes_columns(spark):
    from cohortlens.operators import quality

    df = quality.date_range(E._raw(spark, SF_SMALL))
    p = df._jdf.queryExecution().executedPlan().toString()
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schema and all("props" not in s and "value" not in s for s in schema)


def plan_nodes(df):
    """All physical plan nodes (through adaptive wrappers and subqueries' main trees)."""
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        n = stack.pop()
        yield n
        if n.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(n.executedPlan())
            continue
        ch = n.children()
        stack.extend(ch.apply(i) for i in range(ch.size()))


def unpartitioned_windows(df) -> int:
    return sum(1 for n in plan_nodes(df)
               if n.getClass().getSimpleName() == "WindowExec" and n.partitionSpec().isEmpty())


def test_window_check_detects_global_windows(spark):
    from pyspark.sql import Window, functions as F

    df = spark.range(10).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert unpartitioned_windows(df) == 1


def test_no_unpartitioned_window(pipe):
    for df in (pipe.clean_events, pipe.session_funnel, pipe.funnel_report):
        assert unpartitioned_windows(df) == 0


def test_session_funnel_reuses_user_partitioning(pipe):
    ex = exchanges(plan(pipe.session_funnel))
    # events: one exchange on the user key; the session grouping adds none (the only other
    # exchange is the tiny lookup's own grouping)
    assert sum("_uk" in e for e in ex) == 1
    assert not any("session_id" in e for e in ex)
