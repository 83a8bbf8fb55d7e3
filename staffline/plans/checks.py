"""Plan checks on a DataFrame's physical plan (what the tests assert, usable by callers too).

They read the plan nodes or, for joins, the plan's text; nothing runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nested_loop_or_cartesian(df: DataFrame) -> list[str]:
    """Plan lines with a nested-loop or Cartesian join (empty when there is none)."""
    return [ln.strip() for ln in physical_plan(df).splitlines()
            if "BroadcastNestedLoopJoin" in ln or "CartesianProduct" in ln]


def _scans(df: DataFrame) -> list:
    """The Parquet scan nodes of the physical plan and of its scalar subqueries."""
    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    plan = df._jdf.queryExecution().sparkPlan()
    plans = [plan, *items(plan.subqueriesAll())]
    return [n for p in plans for n in items(p.collectLeaves()) if n.nodeName().startswith("Scan parquet")]


def scanned_columns(df: DataFrame) -> dict[str, set[str]]:
    """For every Parquet scan: file name → the columns it reads, from the scan nodes themselves."""
    out: dict[str, set[str]] = {}
    for n in _scans(df):
        path = n.relation().location().rootPaths().apply(0).toString()
        name = path.rstrip("/").split("/")[-1]
        out.setdefault(name, set()).update(n.requiredSchema().fieldNames())
    return out


def scans_of(df: DataFrame, name: str) -> int:
    """How often the plan scans the table whose path ends in ``name``."""
    return sum(n.relation().location().rootPaths().apply(0).toString().rstrip("/").endswith("/" + name) for n in _scans(df))


def exchanges(df: DataFrame) -> int:
    """Shuffles that the plan needs before run-time changes."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def assert_linear_plan(df: DataFrame) -> None:
    """No join in the plan pairs every row with every row of another input."""
    bad = nested_loop_or_cartesian(df)
    assert not bad, "nested-loop / Cartesian join in plan: " + "; ".join(bad)
