"""Scale check: the flagship monthly history and the tenure-band series on the sf staff table
blown up ×k (each spell copied k times with new ids and hire/exit shifted by a few days), to
see that time grows about linearly with the number of spells (no months × rows work).

Usage: python tools/scale_check.py [sf_dir] [k ...]    (prints one JSON line per k)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    from staffline import fixture
    from staffline.operators import headcount, prepare, attrition
    from staffline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ks = [int(x) for x in sys.argv[2:]] or [1, 10, 50]
    spark = build_session()
    base = fixture.staff(spark, sf_dir)
    for k in ks:
        copies = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c"))
        shift = F.col("_c") % 29  # spread copies over the month so month edges are exercised
        blown = copies.select(
            (F.col("employee_id") * k + F.col("_c")).alias("employee_id"),
            *[c for c in base.columns if c not in ("employee_id", "hire_date", "exit_date")],
            F.timestamp_add("DAY", shift, F.col("hire_date")).alias("hire_date"),
            F.timestamp_add("DAY", shift, F.col("exit_date")).alias("exit_date"),
        )
        staff = prepare.prepare_staff(blown, None, fixture.AS_OF)
        out = {"k": k, "spells": None}
        for name, fn in (("attrition_history", lambda s: attrition.attrition_history(s, as_of=fixture.AS_OF)),
                         ("headcount_monthly_tenure", lambda s: headcount.headcount_monthly_tenure(s, fixture.AS_OF))):
            t0 = time.perf_counter()
            fn(staff).write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - t0, 2)
        out["spells"] = base.count() * k
        print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
