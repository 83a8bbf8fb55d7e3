"""Facet options and counts of all filters from one scan.

Each row gets a bit mask of the picks it fails. An option of facet k is a value of a row that fails none of the
picks that count for k: those before it (``cascade``, as the dashboard chains its pick lists) or all others
(``others``: what a click on the option would show). Rows are turned into (facet, value) pairs and counted with a
map-side aggregate, so the number of scans does not depend on the number of facets.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank
from ..schema import absent
from .filters import ALL

COMPANY_ANY = "Todas"
FACETS = ("company", "department", "role", "manager", "contract_type")


def manager_column(staff: DataFrame) -> str | None:
    """The column that the manager pick reads: the manager's id, else the manager's name (``gestor``), else none."""
    if not absent(staff, "manager_id"):
        return "manager_id"
    return "manager_name" if "manager_name" in staff.columns else None


def _passes(c: Column, pick) -> Column:
    """No pick or an empty one passes every row; 'all' every non-null value; a list its values."""
    if pick is None or pick == COMPANY_ANY:
        return F.lit(True)
    if isinstance(pick, str) and pick == ALL:
        return c.isNotNull()
    values = list(pick) if not isinstance(pick, (str, int)) else [pick]
    return F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(True)


def _columns(staff: DataFrame, facets) -> dict[str, str]:
    named = {f: manager_column(staff) if f == "manager" else f for f in facets}
    return {f: c for f, c in named.items() if c is not None and c in staff.columns}


def facet_options(staff: DataFrame, picks: Mapping[str, object], facets=FACETS, cascade: bool = True) -> DataFrame:
    """(facet_no, facet, value, rows, picked): every option that each facet offers under the picks of the others, how many rows
    have it, and whether its own pick holds it. ``picks``: facet -> None, 'all' or values. Null and blank
    values are no options."""
    cols = _columns(staff, facets)
    passes = {f: _passes(F.col(f"`{c}`"), picks.get(f)) for f, c in cols.items()}
    mask = sum((F.when(p, 0).otherwise(1 << i) for i, p in enumerate(passes.values())), F.lit(0))
    seen = staff.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(cols.values())],
                        mask.cast("int").alias("_failed"))
    entries = []
    for i, f in enumerate(cols):
        counted = (1 << i) - 1 if cascade else ((1 << len(cols)) - 1) & ~(1 << i)
        offered = (F.col("_failed").bitwiseAND(counted) == 0) & non_blank(F.col(f"_{i}"))
        entries.append(F.struct(F.lit(i + 1).alias("facet_no"), F.lit(f).alias("facet"), F.when(offered, F.col(f"_{i}")).alias("value"),
                                (F.col("_failed").bitwiseAND(1 << i) == 0).alias("picked")))
    pairs = seen.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    return (pairs.groupBy("facet_no", "facet", "value", "picked").agg(F.count(F.lit(1)).alias("rows"))
            .select("facet_no", "facet", "value", "rows", "picked").orderBy("facet_no", "value"))


def filtered(staff: DataFrame, picks: Mapping[str, object], facets=FACETS) -> DataFrame:
    """The rows that pass every pick, the manager's by id or by the column that stands in for it."""
    out = staff
    for f, c in _columns(staff, facets).items():
        if picks.get(f) is not None:
            out = out.where(_passes(F.col(f"`{c}`"), picks[f]))
    return out
