"""Write the executed (AQE final) physical plans of chosen registered queries to PLANS.md.

Usage: python tools/plans.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["attrition_history", "headcount_monthly_tenure", "latest_review", "team_size", "risk_scores",
           "attrition_period_month_all_years"]


def main() -> None:
    from staffline.catalog import QUERIES
    from staffline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or DEFAULT
    spark = build_session()
    out = ["# Executed plans", "",
           f"AQE final physical plans after running each query on `{sf_dir}` (local[8]); generated by",
           "`tools/plans.py`. Expression ids are stripped. At this size AQE turns small joins into broadcast",
           "joins; at scale the same logical plans run as sort-merge joins with skew splitting.", ""]
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("+- == Initial Plan ==")[0]
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r", \[plan_id=\d+\]", "", plan)
        lines = [ln[:220] for ln in plan.splitlines()]
        out += [f"## `{name}`", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
