"""Brute-force versions of the reference's definitions, for small hand-made or random inputs.

Plain Python loops over months × rows — the O(months × rows) definition the Spark operators
replace — written from the documented semantics (SURVEY §2, §4.4), used only as test oracles.
"""

from __future__ import annotations

import datetime as dt
import re

VOL = re.compile("voluntário|pedido|demissão|rescisão")


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def add_month(d: dt.date, k: int = 1) -> dt.date:
    y, m = divmod(d.month - 1 + k, 12)
    return dt.date(d.year + y, m + 1, 1)


def ceil_month(d: dt.date) -> dt.date:
    return d if d.day == 1 else add_month(month_start(d))


def spine(rows, as_of: dt.date):
    hires = [r["hire_date"] for r in rows if r["hire_date"] is not None]
    if not hires:
        return []
    exits = [r["exit_date"] for r in rows if r["exit_date"] is not None]
    lo = ceil_month(min(hires))
    hi = max(exits) if exits else as_of
    out, m = [], lo
    while m <= hi:
        out.append(m)
        m = add_month(m)
    return out


def active(r, m) -> bool:
    return r["hire_date"] is not None and r["hire_date"] <= m and (r["exit_date"] is None or r["exit_date"] > m)


def is_vol(r) -> bool:
    txt = r.get("exit_type") if "exit_type" in r else r.get("exit_reason")
    return txt is not None and VOL.search(txt.lower()) is not None


def history(rows, as_of):
    out = []
    for m in spine(rows, as_of):
        hc = sum(1 for r in rows if active(r, m))
        ex = [r for r in rows if r["exit_date"] is not None and month_start(r["exit_date"]) == m]
        v = sum(1 for r in ex if is_vol(r))
        d = len(ex)
        out.append((m.strftime("%Y-%m"), hc, d, v, d - v,
                    d / hc * 100 if hc else 0.0, v / hc * 100 if hc else 0.0, (d - v) / hc * 100 if hc else 0.0))
    return out


def monthly_by(rows, group, as_of):
    out = []
    for m in spine(rows, as_of):
        counts = {}
        for r in rows:
            if active(r, m) and r.get(group) is not None:
                counts[r[group]] = counts.get(r[group], 0) + 1
        out += [(m.strftime("%Y-%m"), g, c) for g, c in counts.items()]
    return sorted(out)


BANDS = ["0-6m", "6-12m", "12-24m", "24-36m", "+36m"]


def band_of(days: int) -> int:
    x = days / 30
    if x <= 6:
        return 1
    if x <= 12:
        return 2
    if x <= 24:
        return 3
    if x <= 36:
        return 4
    return 5


def tenure_bands(rows, as_of):
    out = []
    for m in spine(rows, as_of):
        act = [r for r in rows if active(r, m)]
        if not act:
            continue
        counts = [0] * 5
        for r in act:
            counts[band_of((m - r["hire_date"]).days) - 1] += 1
        out += [(m.strftime("%Y-%m"), k + 1, BANDS[k], counts[k]) for k in range(5)]
    return out


def period(rows, as_of, year=None, month=None):
    """Mean monthly attrition of a period (A4): the four month-list cases."""
    if not any(r["hire_date"] is not None for r in rows):
        return None
    if year is not None and month is not None:
        months = [dt.date(year, month, 1)]
    elif year is not None:
        months = [dt.date(year, k, 1) for k in range(1, 13)]
    elif month is not None:
        years = sorted({r[c].year for r in rows for c in ("hire_date", "exit_date") if r[c] is not None})
        months = [dt.date(y, month, 1) for y in years]
    else:
        months = spine(rows, as_of)
    used = []
    for m in months:
        hc = sum(1 for r in rows if active(r, m))
        if hc == 0:
            continue
        ex = [r for r in rows if r["exit_date"] is not None and month_start(r["exit_date"]) == m]
        v = sum(1 for r in ex if is_vol(r))
        used.append((hc, len(ex), v))
    return used


def growth(series):
    """series: list of (month, group, headcount) → dict (month, group) → (prev, abs, pct)."""
    out, last = {}, {}
    for m, g, hc in sorted(series):
        prev = last.get(g)
        if prev is None:
            out[(m, g)] = (None, None, 0.0)
        else:
            out[(m, g)] = (prev, hc - prev, round((hc - prev) / prev * 100, 2))
        last[g] = hc
    return out


def growth_summary(series, n):
    g = growth(series)
    months = sorted({m for m, _, _ in series})[-n:]
    out = {}
    for grp in sorted({x for _, x, _ in series}):
        rows = sorted((m, hc) for m, x, hc in series if x == grp)
        recent = [g[(m, grp)] for m, _ in rows if m in months]
        if not recent:
            continue
        first, last_ = rows[0][1], rows[-1][1]
        abs_vals = [r[1] for r in recent if r[1] is not None]
        out[grp] = (first, last_, last_ - first, round((last_ - first) / first * 100, 2) if first > 0 else 0.0,
                    round(sum(abs_vals) / len(abs_vals), 1) if abs_vals else None,
                    round(sum(r[2] for r in recent) / len(recent), 2))
    return out
