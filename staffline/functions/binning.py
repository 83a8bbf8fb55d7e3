"""Right-closed binning (the ``pd.cut`` rule) as a CASE expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (bin edges and labels as the reference shows them) -----------------------
TENURE_EDGES = (0, 6, 12, 24, 36, math.inf)
TENURE_LABELS = ("0-6m", "6-12m", "12-24m", "24-36m", "+36m")
RISK_EDGES = (0, 20, 40, 60, 80, 100)
RISK_LABELS = ("0–20", "20–40", "40–60", "60–80", "80–100")
PROMOTION_GAP_EDGES = (0, 3, 6, 12, 24, math.inf)
PROMOTION_GAP_LABELS = ("0–3m", "3–6m", "6–12m", "12–24m", "+24m")
# --------------------------------------------------------------------------------------------


def band_number(x: Column, edges: tuple, include_lowest: bool) -> Column:
    """1-based band of ``x`` for right-closed bins ``(e[i-1], e[i]]``; null outside every bin."""
    expr = None
    for i in range(1, len(edges)):
        lo, hi = edges[i - 1], edges[i]
        cond = (x >= F.lit(lo)) if (i == 1 and include_lowest) else (x > F.lit(lo))
        if not math.isinf(hi):
            cond = cond & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr
