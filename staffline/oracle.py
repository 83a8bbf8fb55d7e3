"""DuckDB SQL for every registered query: the plain (nested-loop) definition of each KPI over the
raw test tables, used as an independent check of the Spark plans.

Conventions shared with the Spark side: months as 'YYYY-MM' text, counts BIGINT, rates DOUBLE,
rounded values with numpy's rule ``round_even(x * 10^k, 0) / 10^k``.
"""

from __future__ import annotations

AS_OF = "2001-12-01"

STAFF_SQL = """
SELECT o.o_orderkey AS employee_id, c.c_name AS name, n.n_name AS company, c.c_mktsegment AS department,
 CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Diretor' WHEN '2-HIGH' THEN 'Gerente'
      WHEN '3-MEDIUM' THEN 'Coordenador' WHEN '5-LOW' THEN 'Analista' ELSE NULL END AS role,
 o.o_custkey AS manager_id,
 CASE o.o_orderstatus WHEN 'F' THEN 'CLT' WHEN 'O' THEN 'PJ' ELSE 'Estágio' END AS contract_type,
 CASE o.o_orderkey % 4 WHEN 0 THEN 'Feminino' WHEN 1 THEN 'Masculino' WHEN 2 THEN 'M' ELSE NULL END AS gender,
 o.o_orderdate AS hire_date, x.exit_date,
 CASE WHEN x.exit_date IS NULL THEN NULL WHEN o.o_custkey % 4 = 0 THEN 'Pedido de demissão'
      WHEN o.o_custkey % 4 = 1 THEN 'Dispensa' WHEN o.o_custkey % 4 = 2 THEN 'Aposentadoria' ELSE NULL END AS exit_reason,
 x.last_promotion, x.last_merit
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey,
   max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS exit_date,
   max(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS last_promotion,
   max(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS last_merit
 FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey
"""

REVIEWS_SQL = """
SELECT l_orderkey AS employee_id, l_shipdate AS cycle_end, CAST(l_linenumber AS BIGINT) AS seq,
 CASE l_linenumber % 5 WHEN 0 THEN 'Excepcional' WHEN 1 THEN 'Acima do esperado' WHEN 2 THEN 'Dentro do esperado'
      WHEN 3 THEN 'Abaixo do esperado' ELSE 'Sem nota' END AS rating
FROM lineitem
"""

VOL = "coalesce(regexp_matches(lower(exit_reason), 'voluntário|pedido|demissão|rescisão'), false)"

# staff with day dates, voluntary flag and tenure; `last` = latest review per person.
BASE = f"""
staff AS ({STAFF_SQL}),
reviews AS ({REVIEWS_SQL}),
s AS (SELECT *, CAST(hire_date AS DATE) AS h, CAST(exit_date AS DATE) AS e, {VOL} AS vol FROM staff),
last AS (SELECT employee_id, rating FROM (
   SELECT employee_id, rating, row_number() OVER (PARTITION BY employee_id
     ORDER BY cycle_end DESC NULLS FIRST, seq DESC) AS rn FROM reviews WHERE employee_id IS NOT NULL) WHERE rn = 1),
sr AS (SELECT s.*, last.rating FROM s LEFT JOIN last USING (employee_id))
"""


def rnd(expr: str, k: int) -> str:
    scale = 10 ** k
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def ceil_month(d: str) -> str:
    return (f"(CASE WHEN CAST(date_trunc('month', {d}) AS DATE) = {d} THEN {d} "
            f"ELSE CAST(date_trunc('month', {d}) + INTERVAL 1 MONTH AS DATE) END)")


def spine_sql(src: str = "s", by: str | None = None, end: str | None = None) -> str:
    """Month starts from ceil(min hire) to max exit (or as_of) of ``src``, per ``by`` if given."""
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    where = f" WHERE {by} IS NOT NULL" if by else ""
    return f"""(SELECT {g}CAST(unnest(generate_series(CAST({ceil_month('lo')} AS TIMESTAMP), CAST(hi AS TIMESTAMP),
          INTERVAL 1 MONTH)) AS DATE) AS m
        FROM (SELECT {g}min(h) AS lo, {f"DATE '{end}'" if end else f"coalesce(max(e), DATE '{AS_OF}')"} AS hi FROM {src}{where}{grp}) WHERE lo IS NOT NULL)"""


def history_sql(end: str | None = None) -> str:
    """Per spine month: the nested-loop definition of headcount, exits and voluntary exits."""
    return f"""
WITH {BASE},
sp AS {spine_sql(end=end)},
hist AS (
  SELECT sp.m,
    count(*) FILTER (WHERE s.h <= sp.m AND (s.e IS NULL OR s.e > sp.m)) AS headcount,
    count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = sp.m) AS exits,
    count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = sp.m AND s.vol) AS voluntary
  FROM sp CROSS JOIN s GROUP BY sp.m)
"""


def rate(x: str, hc: str = "headcount") -> str:
    return f"(CASE WHEN {hc} > 0 THEN {x} / {hc} * 100.0 ELSE 0.0 END)"


def q_attrition_history(end: str | None = None) -> str:
    return history_sql(end) + f"""
SELECT strftime(m, '%Y-%m') AS month, headcount, exits, voluntary, exits - voluntary AS involuntary,
  {rate('exits')} AS attrition_total, {rate('voluntary')} AS attrition_vol, {rate('(exits - voluntary)')} AS attrition_inv
FROM hist ORDER BY m
"""



def q_attrition_history_by_department() -> str:
    return f"""
WITH {BASE},
sp AS {spine_sql('s', 'department')},
hist AS (
  SELECT sp.department, sp.m,
    count(*) FILTER (WHERE s.h <= sp.m AND (s.e IS NULL OR s.e > sp.m)) AS headcount,
    count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = sp.m) AS exits,
    count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = sp.m AND s.vol) AS voluntary
  FROM sp JOIN s ON s.department = sp.department GROUP BY sp.department, sp.m)
SELECT department, strftime(m, '%Y-%m') AS month, headcount, exits, voluntary, exits - voluntary AS involuntary,
  {rate('exits')} AS attrition_total, {rate('voluntary')} AS attrition_vol, {rate('(exits - voluntary)')} AS attrition_inv
FROM hist
"""


MONTHS_PT = "['Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto', 'Setembro', 'Outubro', 'Novembro', 'Dezembro']"


def q_period_label() -> str:
    return history_sql() + f"""
SELECT strftime(m, '%Y-%m') AS month,
  {MONTHS_PT}[month(m)] || '/' || CAST(year(m) AS VARCHAR) AS label_month_year,
  'Ano ' || CAST(year(m) AS VARCHAR) || ' (média mensal)' AS label_year,
  'Mês ' || {MONTHS_PT}[month(m)] || ' (média de todos os anos)' AS label_month,
  'Todo o período' AS label_all
FROM hist
"""


def q_attrition_history_means() -> str:
    return history_sql() + f""",
th AS (SELECT *, {rate('exits')} AS r_total, {rate('voluntary')} AS r_vol, {rate('(exits - voluntary)')} AS r_inv FROM hist)
SELECT CAST(floor(avg(headcount)) AS BIGINT) AS avg_headcount, CAST(floor(avg(exits)) AS BIGINT) AS avg_exits,
  {rnd('avg(r_total)', 1)} AS avg_attrition_total, {rnd('avg(r_vol)', 1)} AS avg_attrition_vol,
  {rnd('avg(r_inv)', 1)} AS avg_attrition_inv
FROM th
"""


def _period_months(year, month) -> str:
    if year is not None and month is not None:
        return f"(SELECT DATE '{year:04d}-{month:02d}-01' AS m)"
    if year is not None:
        return (f"(SELECT CAST(unnest(generate_series(TIMESTAMP '{year:04d}-01-01', TIMESTAMP '{year:04d}-12-01', "
                f"INTERVAL 1 MONTH)) AS DATE) AS m)")
    if month is not None:
        return (f"(SELECT DISTINCT make_date(CAST(yr AS BIGINT), {month}, 1) AS m FROM "
                f"(SELECT year(h) AS yr FROM s UNION ALL SELECT year(e) FROM s) WHERE yr IS NOT NULL)")
    return spine_sql()


PERIOD_SELECT = f"""
  coalesce({rnd('avg(ex / hc * 100.0)', 1)}, 0.0) AS attrition_total,
  coalesce({rnd('avg(vo / hc * 100.0)', 1)}, 0.0) AS attrition_vol,
  coalesce({rnd('avg((ex - vo) / hc * 100.0)', 1)}, 0.0) AS attrition_inv,
  CASE WHEN count(*) > 0 THEN CAST(floor(sum(hc) / count(*)) AS BIGINT) ELSE 0 END AS avg_headcount,
  CASE WHEN count(*) > 0 THEN {rnd('sum(ex) / count(*)', 1)} ELSE 0.0 END AS avg_exits,
  CASE WHEN count(*) > 0 THEN {rnd('sum(vo) / count(*)', 1)} ELSE 0.0 END AS avg_voluntary,
  CASE WHEN count(*) > 0 THEN {rnd('sum(ex - vo) / count(*)', 1)} ELSE 0.0 END AS avg_involuntary,
  count(*) AS months_used"""


def q_attrition_period(year=None, month=None) -> str:
    return f"""
WITH {BASE},
tm AS (SELECT m FROM {_period_months(year, month)} WHERE EXISTS (SELECT 1 FROM s WHERE h IS NOT NULL)),
mon AS (SELECT tm.m,
   count(*) FILTER (WHERE s.h <= tm.m AND (s.e IS NULL OR s.e > tm.m)) AS hc,
   count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = tm.m) AS ex,
   count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = tm.m AND s.vol) AS vo
 FROM tm CROSS JOIN s GROUP BY tm.m)
SELECT {PERIOD_SELECT} FROM mon WHERE hc > 0
"""


def q_attrition_by_department() -> str:
    return f"""
WITH {BASE},
sp AS {spine_sql('s', 'department')},
mon AS (SELECT sp.department, sp.m,
   count(*) FILTER (WHERE s.h <= sp.m AND (s.e IS NULL OR s.e > sp.m)) AS hc,
   count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = sp.m) AS ex,
   count(*) FILTER (WHERE CAST(date_trunc('month', s.e) AS DATE) = sp.m AND s.vol) AS vo
 FROM sp JOIN s ON s.department = sp.department GROUP BY sp.department, sp.m),
agg AS (SELECT department, {PERIOD_SELECT} FROM mon WHERE hc > 0 GROUP BY department),
d AS (SELECT DISTINCT department FROM s WHERE department IS NOT NULL)
SELECT d.department, coalesce(attrition_total, 0.0) AS attrition_total, coalesce(attrition_vol, 0.0) AS attrition_vol,
  coalesce(attrition_inv, 0.0) AS attrition_inv, coalesce(avg_headcount, 0) AS avg_headcount,
  coalesce(avg_exits, 0.0) AS avg_exits, coalesce(avg_voluntary, 0.0) AS avg_voluntary,
  coalesce(avg_involuntary, 0.0) AS avg_involuntary, coalesce(months_used, 0) AS months_used
FROM d LEFT JOIN agg USING (department)
"""


def _flags(year: int, month: int) -> str:
    import calendar

    last = f"DATE '{year:04d}-{month:02d}-{calendar.monthrange(year, month)[1]:02d}'"
    first = f"DATE '{year:04d}-{month:02d}-01'"
    return (f"f AS (SELECT *, coalesce(h <= {last}, false) AND (e IS NULL OR e > {last}) AS act, "
            f"coalesce(e >= {first} AND e <= {last}, false) AS ext FROM s)")


def q_attrition_flagged(year=2000, month=6) -> str:
    def r(x):
        return f"CASE WHEN a > 0 THEN {rnd(f'{x} / a * 100', 1)} ELSE 0.0 END"
    return f"""
WITH {BASE}, {_flags(year, month)},
a AS (SELECT count(*) FILTER (WHERE act) AS a, count(*) FILTER (WHERE ext) AS d,
        count(*) FILTER (WHERE ext AND vol) AS dv FROM f)
SELECT {r('d')} AS attrition_total, {r('dv')} AS attrition_vol, {r('(d - dv)')} AS attrition_inv,
  CASE WHEN a > 0 THEN a ELSE 0 END AS active, CASE WHEN a > 0 THEN d ELSE 0 END AS exits,
  CASE WHEN a > 0 THEN dv ELSE 0 END AS voluntary, CASE WHEN a > 0 THEN d - dv ELSE 0 END AS involuntary
FROM a
"""


def q_period_flags(year=2000, month=6) -> str:
    return f"""
WITH {BASE}, {_flags(year, month)}
SELECT count(*) FILTER (WHERE act) AS active, count(*) FILTER (WHERE ext) AS exited FROM f
"""


COMPARE = ("attrition_total", "attrition_vol", "attrition_inv", "avg_headcount", "avg_exits", "avg_voluntary",
           "avg_involuntary")


def q_attrition_compare(year=2000, month=6) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS measure, CAST(p.{c} AS DOUBLE) AS period, CAST(t.{c} AS DOUBLE) AS total, "
        f"CAST(p.{c} AS DOUBLE) - CAST(t.{c} AS DOUBLE) AS difference FROM p, t" for c in COMPARE)
    return f"""
WITH p AS ({q_attrition_period(year, month)}), t AS ({q_attrition_period(None, None)})
{parts}
"""


def _active_at(t: str) -> str:
    return f"(coalesce(h <= DATE '{t}', false) AND (e IS NULL OR e > DATE '{t}'))"


def q_headcount_at(group: str, t: str) -> str:
    return f"""
WITH {BASE},
g AS (SELECT {group}, count(employee_id) AS headcount FROM s WHERE {_active_at(t)} AND {group} IS NOT NULL GROUP BY {group})
SELECT {group}, headcount, headcount / sum(headcount) OVER () * 100.0 AS pct FROM g
"""


def q_headcount_compare(tp: str = "2000-06-30", tt: str = AS_OF) -> str:
    return f"""
WITH {BASE},
g AS (SELECT department,
   count(employee_id) FILTER (WHERE {_active_at(tp)}) AS headcount_period,
   count(employee_id) FILTER (WHERE {_active_at(tt)}) AS headcount_total
 FROM s WHERE department IS NOT NULL GROUP BY department
 HAVING count(*) FILTER (WHERE {_active_at(tp)}) > 0 OR count(*) FILTER (WHERE {_active_at(tt)}) > 0)
SELECT department, headcount_period, headcount_total, headcount_period - headcount_total AS difference,
  CASE WHEN headcount_total = 0 THEN NULL
       ELSE {rnd('(headcount_period - headcount_total) / headcount_total * 100', 2)} END AS change_pct
FROM g
"""


def monthly_sql(group: str, src: str = "s", end: str | None = None) -> str:
    """CTEs ``sp`` (global spine) and ``mg`` (month, group, headcount) by the nested loop."""
    return f"""sp AS {spine_sql(src, end=end)},
mg AS (SELECT sp.m, x.{group}, count(x.employee_id) AS headcount FROM sp JOIN {src} x
   ON x.h <= sp.m AND (x.e IS NULL OR x.e > sp.m) WHERE x.{group} IS NOT NULL GROUP BY sp.m, x.{group})"""


def q_headcount_monthly(group: str, src: str = "s", where: str = "", end: str | None = None) -> str:
    return f"""
WITH {BASE}, {monthly_sql(group, src, end)}
SELECT strftime(m, '%Y-%m') AS month, {group}, headcount FROM mg {where}
"""


def tenure_sql() -> str:
    return f"""sp AS {spine_sql()},
act AS (SELECT sp.m, datediff('day', s.h, sp.m) AS d FROM sp JOIN s ON s.h <= sp.m AND (s.e IS NULL OR s.e > sp.m)),
months AS (SELECT DISTINCT m FROM act),
bands AS (SELECT * FROM (VALUES (1, '0-6m'), (2, '6-12m'), (3, '12-24m'), (4, '24-36m'), (5, '+36m')) t(band_no, tenure_band)),
cnt AS (SELECT m, CASE WHEN d / 30 <= 6 THEN 1 WHEN d / 30 <= 12 THEN 2 WHEN d / 30 <= 24 THEN 3
                      WHEN d / 30 <= 36 THEN 4 ELSE 5 END AS band_no, count(*) AS c FROM act GROUP BY ALL),
tb AS (SELECT strftime(months.m, '%Y-%m') AS month, bands.band_no, bands.tenure_band,
          CAST(coalesce(c, 0) AS BIGINT) AS headcount
       FROM months CROSS JOIN bands LEFT JOIN cnt ON cnt.m = months.m AND cnt.band_no = bands.band_no)"""


def q_headcount_monthly_tenure() -> str:
    return f"WITH {BASE}, {tenure_sql()} SELECT * FROM tb"


def q_tenure_band_latest() -> str:
    return f"WITH {BASE}, {tenure_sql()} SELECT * FROM tb WHERE month = (SELECT max(month) FROM tb)"


def q_rating_latest() -> str:
    return f"""
WITH {BASE}, {monthly_sql('rating', 'sr')}, r AS (SELECT strftime(m, '%Y-%m') AS month, rating, headcount FROM mg)
SELECT * FROM r WHERE month = (SELECT max(month) FROM r)
"""


def growth_sql(group: str = "department", src: str = "s") -> str:
    return f"""{monthly_sql(group, src)},
g0 AS (SELECT strftime(m, '%Y-%m') AS month, {group}, headcount,
   lag(headcount) OVER (PARTITION BY {group} ORDER BY m) AS prev_headcount FROM mg),
g AS (SELECT month, {group}, headcount, prev_headcount, headcount - prev_headcount AS growth_abs,
   coalesce({rnd('(headcount - prev_headcount) / prev_headcount * 100', 2)}, 0.0) AS growth_pct FROM g0)"""


def q_headcount_growth() -> str:
    return f"WITH {BASE}, {growth_sql()} SELECT * FROM g"


def q_headcount_growth_recent() -> str:
    return f"""WITH {BASE}, {growth_sql()},
cut AS (SELECT month FROM (SELECT DISTINCT month FROM g) ORDER BY month DESC LIMIT 12)
SELECT * FROM g WHERE month IN (SELECT month FROM cut)"""


def q_growth_summary() -> str:
    return f"""WITH {BASE}, {growth_sql()},
cut AS (SELECT month FROM (SELECT DISTINCT month FROM g) ORDER BY month DESC LIMIT 12),
recent AS (SELECT department, {rnd('avg(growth_abs)', 1)} AS avg_growth_abs, {rnd('avg(growth_pct)', 2)} AS avg_growth_pct
   FROM g WHERE month IN (SELECT month FROM cut) GROUP BY department),
ends AS (SELECT department, arg_min(headcount, month) AS first_headcount, arg_max(headcount, month) AS last_headcount
   FROM g GROUP BY department)
SELECT department, first_headcount, last_headcount, last_headcount - first_headcount AS change,
  CASE WHEN first_headcount > 0 THEN {rnd('(last_headcount - first_headcount) / first_headcount * 100', 2)} ELSE 0.0 END
    AS change_pct, avg_growth_abs, avg_growth_pct
FROM ends JOIN recent USING (department)"""


def q_growth_gender_recent() -> str:
    return f"""WITH {BASE}, {growth_sql('gender')},
cut AS (SELECT month FROM (SELECT DISTINCT month FROM g) ORDER BY month DESC LIMIT 6)
SELECT gender, CAST(coalesce(sum(growth_abs), 0) AS BIGINT) AS growth_abs_sum, {rnd('avg(growth_pct)', 6)} AS growth_pct_avg
FROM g WHERE month IN (SELECT month FROM cut) GROUP BY gender"""


def q_tenure_at_exit() -> str:
    return f"""
WITH {BASE},
x AS (SELECT datediff('day', h, e) / 30 AS t, vol FROM s WHERE exit_date IS NOT NULL),
a AS (SELECT count(*) AS n, avg(t) AS t, avg(t) FILTER (WHERE vol) AS tv, avg(t) FILTER (WHERE NOT vol) AS ti,
        count(*) FILTER (WHERE vol) AS nv FROM x)
SELECT CASE WHEN n = 0 THEN 0.0 ELSE {rnd('t', 1)} END AS tenure_total,
  CASE WHEN n = 0 THEN 0.0 WHEN nv > 0 THEN {rnd('tv', 1)} ELSE {rnd('t', 1)} END AS tenure_vol,
  CASE WHEN n = 0 THEN 0.0 WHEN nv > 0 THEN {rnd('ti', 1)} ELSE {rnd('t', 1)} END AS tenure_inv
FROM a
"""


CONTRACT = f"""g AS (SELECT contract_type, count(*) AS quantity FROM s WHERE exit_date IS NULL AND contract_type IS NOT NULL
   GROUP BY contract_type),
cm AS (SELECT contract_type, quantity, {rnd('quantity / sum(quantity) OVER () * 100.0', 1)} AS pct FROM g)"""


def q_contract_mix() -> str:
    return f"WITH {BASE}, {CONTRACT} SELECT * FROM cm"


def q_contract_top4() -> str:
    return f"WITH {BASE}, {CONTRACT} SELECT * FROM cm ORDER BY quantity DESC, contract_type LIMIT 4"


def q_monthly_exits() -> str:
    return f"""
WITH {BASE}, pm AS (SELECT date_trunc('month', e) AS m, count(*) AS c FROM s WHERE e IS NOT NULL GROUP BY 1)
SELECT coalesce({rnd('avg(c)', 1)}, 0.0) AS avg_exits_per_month, CAST(coalesce(sum(c), 0) AS BIGINT) AS total_exits,
  count(*) AS months_with_exits FROM pm
"""


def q_basic_kpis() -> str:
    def share(c):
        return f"CASE WHEN total_active > 0 THEN {rnd(f'{c} / total_active * 100', 1)} ELSE 0.0 END"
    return f"""
WITH {BASE},
a AS (SELECT count(*) AS total_active,
   count(*) FILTER (WHERE upper(contract_type) = 'CLT') AS clt_count,
   count(*) FILTER (WHERE lower(gender) = 'feminino') AS female_count,
   count(*) FILTER (WHERE lower(gender) IN ('masculino', 'm')) AS male_count,
   count(*) FILTER (WHERE coalesce(regexp_matches(lower(role), 'coord|gerente|diretor'), false)) AS leader_count
 FROM s WHERE exit_date IS NULL)
SELECT total_active, clt_count, {share('clt_count')} AS clt_pct, female_count, {share('female_count')} AS female_pct,
  male_count, {share('male_count')} AS male_pct, leader_count, {share('leader_count')} AS leader_pct FROM a
"""


def q_quality_report() -> str:
    return f"""
WITH {BASE},
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE hire_date IS NULL) AS null_hire,
   count(*) FILTER (WHERE hire_date > TIMESTAMP '{AS_OF}') AS future_hire,
   count(*) FILTER (WHERE exit_date IS NOT NULL AND hire_date IS NOT NULL AND exit_date < hire_date) AS ebh,
   count(*) FILTER (WHERE exit_date IS NULL) AS active, count(*) FILTER (WHERE exit_date IS NOT NULL) AS exited FROM s)
SELECT 'error' AS severity, 'empty_table' AS rule, CAST(0 AS BIGINT) AS value FROM a WHERE total = 0
UNION ALL SELECT 'error', 'exit_before_hire', ebh FROM a WHERE total > 0 AND ebh > 0
UNION ALL SELECT 'warning', 'null_hire_date', null_hire FROM a WHERE total > 0 AND null_hire > 0
UNION ALL SELECT 'warning', 'future_hire_date', future_hire FROM a WHERE total > 0 AND future_hire > 0
UNION ALL SELECT 'stat', 'total_rows', total FROM a WHERE total > 0
UNION ALL SELECT 'stat', 'active', active FROM a WHERE total > 0
UNION ALL SELECT 'stat', 'exited', exited FROM a WHERE total > 0
"""


def q_latest_review() -> str:
    return f"WITH {BASE} SELECT employee_id, rating FROM last"


def d(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


TENURE_MONTHS = f"datediff('day', h, DATE '{AS_OF}') / 30"


def q_prepare_staff() -> str:
    return f"""
WITH {BASE}
SELECT employee_id, name, department, role, manager_id, contract_type, gender, {d('hire_date')}, {d('exit_date')},
  exit_reason, {d('last_promotion')}, {d('last_merit')}, company, exit_date IS NULL AS active,
  {TENURE_MONTHS} AS tenure_months, rating
FROM sr
"""


def q_core_fields() -> str:
    return f"WITH {BASE} SELECT employee_id, exit_date IS NULL AS active, {TENURE_MONTHS} AS tenure_months FROM s"


def q_coerce_dates() -> str:
    def parse(c):
        return (f"strftime(coalesce(try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%Y-%m-%d'), "
                f"try_strptime({c}, '%d/%m/%Y')), '%Y-%m-%d')")
    return f"""
WITH {BASE},
t AS (SELECT employee_id,
   CASE employee_id % 3 WHEN 0 THEN strftime(hire_date, '%Y-%m-%d') WHEN 1 THEN strftime(hire_date, '%d/%m/%Y')
        ELSE strftime(hire_date, '%Y-%m-%d %H:%M:%S') END AS ht,
   coalesce(strftime(exit_date, '%d/%m/%Y'), 'abc') AS et FROM staff)
SELECT employee_id, {parse('ht')} AS hire_date, {parse('et')} AS exit_date FROM t
"""


TEAM = """team AS (SELECT manager_id, count(employee_id) AS c FROM s WHERE manager_id IS NOT NULL GROUP BY manager_id)"""

SCORED = f"""{TEAM},
f AS (SELECT sr.employee_id, sr.name, sr.department, sr.role, sr.rating, sr.manager_id,
   datediff('day', CAST(sr.last_promotion AS DATE), DATE '{AS_OF}') / 30 AS months_since_promotion,
   datediff('day', CAST(sr.last_merit AS DATE), DATE '{AS_OF}') / 30 AS months_since_merit,
   CAST(coalesce(team.c, 0) AS BIGINT) AS team_size,
   CAST(CASE lower(sr.rating) WHEN 'excepcional' THEN 10 WHEN 'acima do esperado' THEN 7
        WHEN 'dentro do esperado' THEN 4 WHEN 'abaixo do esperado' THEN 1 ELSE 4 END AS DOUBLE) AS perf_raw,
   datediff('day', sr.h, DATE '{AS_OF}') / 30 AS tenure_months
 FROM sr LEFT JOIN team ON sr.manager_id = team.manager_id),
c AS (SELECT *, coalesce(CAST(perf_raw AS DOUBLE), 0.0) AS c_p, coalesce(CAST(months_since_promotion AS DOUBLE), 0.0) AS c_pr,
   coalesce(CAST(tenure_months AS DOUBLE), 0.0) AS c_te, coalesce(CAST(months_since_merit AS DOUBLE), 0.0) AS c_me,
   coalesce(CAST(team_size AS DOUBLE), 0.0) AS c_tm FROM f),
st AS (SELECT min(c_p) AS p0, max(c_p) AS p1, min(c_pr) AS pr0, max(c_pr) AS pr1, min(c_te) AS te0, max(c_te) AS te1,
   min(c_me) AS me0, max(c_me) AS me1, min(c_tm) AS tm0, max(c_tm) AS tm1 FROM c),
sc AS (SELECT c.*,
   1.0 - (CASE WHEN p1 - p0 = 0 THEN 0.0 ELSE (c_p - p0) / (p1 - p0) END) AS score_perf_inv,
   CASE WHEN pr1 - pr0 = 0 THEN 0.0 ELSE (c_pr - pr0) / (pr1 - pr0) END AS score_promotion,
   CASE WHEN te1 - te0 = 0 THEN 0.0 ELSE (c_te - te0) / (te1 - te0) END AS score_tenure,
   CASE WHEN me1 - me0 = 0 THEN 0.0 ELSE (c_me - me0) / (me1 - me0) END AS score_merit,
   CASE WHEN tm1 - tm0 = 0 THEN 0.0 ELSE (c_tm - tm0) / (tm1 - tm0) END AS score_team
 FROM c, st),
scored AS (SELECT *, least(greatest((CAST(0.3 AS DOUBLE) * score_perf_inv + CAST(0.25 AS DOUBLE) * score_promotion
   + CAST(0.15 AS DOUBLE) * score_tenure + CAST(0.15 AS DOUBLE) * score_team
   + CAST(0.15 AS DOUBLE) * score_merit) * 100.0, 0.0), 100.0) AS risk FROM sc),
reasons AS (SELECT *, CASE WHEN r0 = '' THEN 'Perfil estável' ELSE upper(left(r0, 1)) || lower(substr(r0, 2)) END AS reasons
 FROM (SELECT *, concat_ws(', ',
   CASE WHEN score_perf_inv > 0.6 THEN 'baixa performance' END,
   CASE WHEN score_promotion > 0.6 THEN 'muito tempo sem promoção' END,
   CASE WHEN score_team > 0.6 THEN 'gestor com equipe grande' END,
   CASE WHEN score_merit > 0.6 THEN 'sem mérito recente' END,
   CASE WHEN score_tenure < 0.2 THEN 'pouco tempo de casa (fase inicial)' END) AS r0 FROM scored))"""


def q_team_size() -> str:
    return f"""WITH {BASE}, {TEAM}
SELECT s.employee_id, s.manager_id, CAST(coalesce(team.c, 0) AS BIGINT) AS team_size FROM s LEFT JOIN team ON s.manager_id = team.manager_id"""


def q_risk(select: str) -> str:
    return f"WITH {BASE}, {SCORED} {select}"


def _bands(x: str, edges, lowest: bool) -> str:
    parts = []
    for i in range(1, len(edges)):
        lo, hi = edges[i - 1], edges[i]
        cond = f"{x} >= {lo}" if (i == 1 and lowest) else f"{x} > {lo}"
        if hi is not None:
            cond += f" AND {x} <= {hi}"
        parts.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


RISK_BANDS = _bands("risk", (0, 20, 40, 60, 80, 100), True)
GAP_BANDS = _bands("months_since_promotion", (0, 3, 6, 12, 24, None), False)
RISK_LABELS = "(VALUES (1, '0–20'), (2, '20–40'), (3, '40–60'), (4, '60–80'), (5, '80–100')) l(band_no, band)"
GAP_LABELS = "(VALUES (1, '0–3m'), (2, '3–6m'), (3, '6–12m'), (4, '12–24m'), (5, '+24m')) l(band_no, band)"


def q_risk_histogram() -> str:
    return q_risk(f"""
, b AS (SELECT {RISK_BANDS} AS band_no FROM scored), n AS (SELECT count(band_no) AS n FROM b),
bc AS (SELECT band_no, count(*) AS k FROM b WHERE band_no IS NOT NULL GROUP BY band_no)
SELECT l.band_no, l.band, CASE WHEN n.n > 0 THEN coalesce(bc.k, 0) / n.n * 100.0 END AS share_pct
FROM {RISK_LABELS} CROSS JOIN n LEFT JOIN bc ON bc.band_no = l.band_no""")


def q_risk_by_promotion_gap() -> str:
    return q_risk(f"""
, b AS (SELECT {GAP_BANDS} AS band_no, risk FROM scored),
bc AS (SELECT band_no, avg(risk) AS a FROM b WHERE band_no IS NOT NULL GROUP BY band_no)
SELECT l.band_no, l.band, {rnd('bc.a', 6)} AS avg_risk FROM {GAP_LABELS} LEFT JOIN bc ON bc.band_no = l.band_no""")


def history_rates() -> str:
    return history_sql() + f""",
th AS (SELECT m, strftime(m, '%Y-%m') AS month, headcount, exits, voluntary,
   {rate('exits')} AS attrition_total FROM hist)"""


def fmt1(x: str) -> str:
    return f"printf('%.1f', {rnd(x, 1)})"


def q_attrition_forecast() -> str:
    preds = [f"(slope0 * (n + {i}) + intercept)" for i in range(3)]
    trend = "(CASE WHEN slope0 > 0.1 THEN 'crescente' WHEN slope0 < -0.1 THEN 'decrescente' ELSE 'estável' END)"
    fc = ", ".join(f"CASE WHEN n >= 3 THEN greatest(0.0, {rnd(p, 1)}) END AS forecast_{i + 1}" for i, p in enumerate(preds))
    msg = (f"printf('Tendência %s identificada. Previsão de attrition para os próximos 3 meses: %s%%, %s%%, %s%%', "
           f"{trend}, {fmt1(preds[0])}, {fmt1(preds[1])}, {fmt1(preds[2])})")
    return history_rates() + f""",
x AS (SELECT attrition_total AS y, CAST(date_diff('month', (SELECT min(m) FROM th), m) AS DOUBLE) AS x FROM th),
a AS (SELECT count(*) AS n, coalesce(regr_slope(y, x), 0.0) AS slope0, regr_intercept(y, x) AS intercept FROM x)
SELECT CASE WHEN n >= 3 THEN {trend} END AS trend, CASE WHEN n >= 3 THEN {rnd('slope0', 3)} END AS slope, {fc},
  CASE WHEN n >= 3 THEN {msg}
       ELSE 'Dados insuficientes para análise preditiva. Necessário histórico de pelo menos 3 meses.' END AS message
FROM a
"""


def insights_sql() -> str:
    dept = q_attrition_by_department()
    return history_rates() + f""",
l3 AS (SELECT attrition_total, row_number() OVER (ORDER BY m DESC) AS r FROM th),
hr AS (SELECT max(attrition_total) FILTER (WHERE r = 1) AS r_last, max(attrition_total) FILTER (WHERE r = 3) AS r_third,
   count(*) FILTER (WHERE r <= 3) AS k, (SELECT avg(attrition_total) FROM th) AS mean_rate FROM l3),
dep AS ({dept}),
w AS (SELECT department AS worst, attrition_total AS worst_rate FROM dep ORDER BY attrition_total DESC, department LIMIT 1),
ten AS (SELECT avg(datediff('day', h, e) / 30) AS tenure FROM s WHERE exit_date IS NOT NULL),
j AS (SELECT * FROM hr, ten LEFT JOIN w ON true),
flags AS (SELECT *, (k >= 3 AND r_last > r_third * 1.2) AS rise, coalesce(mean_rate > 5.0, false) AS high,
   coalesce(worst_rate > 8.0, false) AS crit, coalesce(tenure < 12, false) AS short FROM j),
ins AS (
 SELECT 1 AS line_no, 'alert' AS kind, 'attrition_rising' AS rule, CAST(NULL AS VARCHAR) AS subject, r_last AS value,
   '⚠️ Attrition aumentou significativamente nos últimos meses. Recomenda-se investigar causas raiz.' AS message FROM flags WHERE rise
 UNION ALL SELECT 2, 'alert', 'attrition_above_benchmark', NULL, mean_rate,
   printf('⚠️ Attrition médio (%s%%) está acima do benchmark de mercado (3-5%%).', {fmt1('mean_rate')}) FROM flags WHERE high
 UNION ALL SELECT 3, 'alert', 'department_critical', worst, worst_rate,
   printf('🚨 Departamento ''%s'' apresenta attrition crítico (%s%%).', worst, {fmt1('worst_rate')}) FROM flags WHERE crit
 UNION ALL SELECT 4, 'alert', 'short_tenure', NULL, tenure,
   printf('⚠️ Tenure médio baixo (%s meses). Colaboradores estão saindo muito cedo.', {fmt1('tenure')}) FROM flags WHERE short
 UNION ALL SELECT 5, 'recommendation', 'attrition_rising', NULL, r_last,
   'Realizar pesquisa de clima organizacional e entrevistas de desligamento.' FROM flags WHERE rise
 UNION ALL SELECT 6, 'recommendation', 'department_critical', worst, worst_rate,
   printf('Priorizar ações de retenção no departamento %s.', worst) FROM flags WHERE crit
 UNION ALL SELECT 7, 'recommendation', 'short_tenure', NULL, tenure,
   'Melhorar processo de onboarding e engajamento nos primeiros meses.' FROM flags WHERE short)"""


def q_insights() -> str:
    return insights_sql() + f"\nSELECT line_no, kind, rule, subject, {rnd('value', 6)} AS value, message FROM ins"


def q_report_lines() -> str:
    return insights_sql() + f""",
hs AS (SELECT avg(attrition_total) AS mean_rate, min(month) AS m0, max(month) AS m1, count(*) AS nh FROM th),
act AS (SELECT count(*) FILTER (WHERE exit_date IS NULL) AS n_active FROM s),
na AS (SELECT count(*) FILTER (WHERE kind = 'alert') AS n_al, count(*) FILTER (WHERE kind = 'recommendation') AS n_rc FROM ins),
fixed AS (
 SELECT 10 AS line_no, '# 📊 Relatório de Pessoas' AS text, true AS keep
 UNION ALL SELECT 11, '', true UNION ALL SELECT 12, '## Resumo Executivo', true UNION ALL SELECT 13, '', true
 UNION ALL SELECT 14, printf('- **Attrition Médio**: %s%%', {fmt1('mean_rate')}), nh > 0 FROM hs
 UNION ALL SELECT 15, printf('- **Período Analisado**: %s a %s', m0, m1), nh > 0 FROM hs
 UNION ALL SELECT 16, printf('- **Total de Colaboradores Ativos**: %s', format('{{:,}}', n_active)), true FROM act
 UNION ALL SELECT 17, '', true
 UNION ALL SELECT 20, '## 🚨 Alertas Críticos', n_al > 0 FROM na UNION ALL SELECT 21, '', n_al > 0 FROM na
 UNION ALL SELECT 59, '', n_al > 0 FROM na
 UNION ALL SELECT 60, '## 💡 Recomendações de Ação', n_rc > 0 FROM na UNION ALL SELECT 61, '', n_rc > 0 FROM na
 UNION ALL SELECT 99, '', n_rc > 0 FROM na
 UNION ALL SELECT 100, '---', true UNION ALL SELECT 101, '', true
 UNION ALL SELECT 102, '*Relatório gerado automaticamente.*', true)
SELECT line_no, text FROM fixed WHERE keep
UNION ALL SELECT CAST(21 + row_number() OVER (ORDER BY line_no) AS INTEGER), '- ' || message FROM ins WHERE kind = 'alert'
UNION ALL SELECT CAST(61 + row_number() OVER (ORDER BY line_no) AS INTEGER),
  printf('%d. %s', row_number() OVER (ORDER BY line_no), message) FROM ins WHERE kind = 'recommendation'
"""


def q_facet_values() -> str:
    return f"WITH {BASE} SELECT DISTINCT department AS value FROM s WHERE department IS NOT NULL AND trim(department) <> ''"


FILTER = ("company = 'NATION_1' AND department IN ('BUILDING', 'MACHINERY') AND role IS NOT NULL "
          "AND contract_type IN ('CLT', 'PJ')")


def q_staff_filtered() -> str:
    return f"WITH {BASE} SELECT employee_id, name, company, department, role, contract_type FROM s WHERE {FILTER}"


def q_staff_filtered_count() -> str:
    return f"WITH {BASE} SELECT count(*) AS rows FROM s WHERE {FILTER}"


def q_name_search() -> str:
    return f"WITH {BASE} SELECT employee_id, name FROM s WHERE coalesce(regexp_matches(name, 'CUSTOMER#00000012', 'i'), false)"


def _picks(**picks) -> list[tuple[str, str, str]]:
    """(facet, column, whether a row passes) in order."""
    passes = {"company": "coalesce(company = 'NATION_1', false)", "department": "coalesce(department IN ('BUILDING', 'MACHINERY'), false)",
              "role": "role IS NOT NULL", "manager": "true", "contract_type": "coalesce(contract_type IN ('CLT', 'PJ'), false)"}
    return [(f, "manager_id" if f == "manager" else f, p) for f, p in passes.items()]


def q_facets(cascade: bool) -> str:
    picks, parts = _picks(), []
    for i, (f, c, own) in enumerate(picks):
        others = [p for j, (_, _, p) in enumerate(picks) if (j < i if cascade else j != i)]
        where = " AND ".join([f"trim(CAST({c} AS VARCHAR)) <> ''", *others])
        parts.append(f"SELECT {i + 1} AS facet_no, '{f}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS rows, {own} AS picked "
                     f"FROM staff WHERE {where} GROUP BY ALL")
    return f"WITH {BASE} " + " UNION ALL ".join(parts)


def q_staff_of_named_managers() -> str:
    return (f"WITH {BASE} SELECT employee_id, 'G' || (manager_id % 10) AS manager_name FROM staff WHERE manager_id % 10 IN (1, 7)")


def q_facets_of_named_managers() -> str:
    return f"""WITH {BASE} SELECT 1 AS facet_no, 'department' AS facet, department AS value, count(*) AS rows,
 department = 'BUILDING' AS picked FROM staff WHERE department IS NOT NULL GROUP BY department
UNION ALL SELECT 2, 'manager', 'G' || (manager_id % 10), count(*), true FROM staff WHERE department = 'BUILDING' GROUP BY manager_id % 10"""


def q_name_search_indexed() -> str:
    return f"WITH {BASE} SELECT employee_id, name FROM staff WHERE regexp_matches(lower(name), 'customer#0*12')"


def q_learned_dates() -> str:
    return (f"WITH {BASE} SELECT CASE WHEN employee_id % 2 = 1 THEN 'day' ELSE 'month' END AS dataset_id, employee_id, "
            f"{d('hire_date')}, {d('exit_date')} FROM staff")


def q_date_orders() -> str:
    col = lambda c: f"""SELECT CASE WHEN employee_id % 2 = 1 THEN 'day' ELSE 'month' END AS dataset_id, '{c}' AS "column",
 count(*) FILTER (employee_id % 2 = 1 AND day({c}) > 12) AS day_first_seen,
 count(*) FILTER (employee_id % 2 = 0 AND day({c}) > 12) AS month_first_seen, bool_or(employee_id % 2 = 1) AS day_first,
 false AS conflict FROM staff GROUP BY employee_id % 2"""  # noqa: E731
    return f"WITH {BASE} {col('hire_date')} UNION ALL {col('exit_date')}"


def q_available_years() -> str:
    return f"""WITH {BASE}
SELECT DISTINCT CAST(y AS INTEGER) AS year FROM (SELECT year(hire_date) AS y FROM s UNION ALL SELECT year(exit_date) FROM s)
WHERE y IS NOT NULL"""


def q_hires_in_period() -> str:
    return f"WITH {BASE} SELECT employee_id, {d('hire_date')} FROM s WHERE year(hire_date) = 2000 AND month(hire_date) = 6"


STAFF_COLUMNS = ("employee_id", "name", "department", "role", "manager_id", "contract_type", "gender", "hire_date",
                 "exit_date", "exit_reason", "last_promotion", "last_merit", "company")
EXPECTED = STAFF_COLUMNS[:-1]


def q_table_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT 'staff' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM staff"
        for c in STAFF_COLUMNS)
    return f"WITH {BASE} {parts}"


def q_schema_report() -> str:
    exp = ", ".join(f"('{c}')" for c in EXPECTED)
    return f"""WITH {BASE},
present AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM staff)),
expected AS (SELECT * FROM (VALUES {exp}) t(c))
SELECT 'staff' AS "table", e.c AS "column", CASE WHEN p.c IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM expected e LEFT JOIN present p ON p.c = e.c
UNION ALL SELECT 'staff', p.c, 'extra' FROM present p WHERE p.c NOT IN (SELECT c FROM expected)"""


def q_dataset_roundtrip() -> str:
    cols = ", ".join(d(c) if c in ("hire_date", "exit_date", "last_promotion", "last_merit") else c for c in STAFF_COLUMNS)
    return f"WITH {BASE} SELECT {cols} FROM staff"


DEPARTMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _catalog(depts) -> str:
    return " UNION ALL ".join(
        f"SELECT 'ds-{i}' AS dataset_id, '{dp.lower()}' AS name, '{dp.lower()}.xlsx' AS file_name, "
        f"count(*) AS rows FROM staff WHERE department = '{dp}'" for i, dp in depts)


def q_dataset_catalog() -> str:
    return f"WITH {BASE} {_catalog(list(enumerate(DEPARTMENTS)))}"


def q_dataset_delete() -> str:
    return f"WITH {BASE} {_catalog(list(enumerate(DEPARTMENTS))[1:])}"


def q_saved_results() -> str:
    rows = lambda k, sql, a, b, c: (f"SELECT '{k}' AS kind, count(*) AS rows, CAST({a} AS BIGINT) AS exits, CAST({b} AS BIGINT) "  # noqa: E731
                                    f"AS quantity, CAST({c} AS BIGINT) AS leaders FROM ({sql})")
    return " UNION ALL ".join([
        rows("attrition_history", q_attrition_history(), "sum(exits)", "NULL", "NULL"),
        rows("contract_mix", q_contract_mix(), "NULL", "sum(quantity)", "NULL"),
        rows("basic_kpis", q_basic_kpis(), "NULL", "NULL", "sum(leader_count)")])


def q_dataset_tables() -> str:
    return f"""WITH {BASE}, n AS (SELECT employee_id, count(*) AS n FROM reviews GROUP BY employee_id)
SELECT department, count(*) AS people, count(n) AS reviewed, CAST(sum(n) AS BIGINT) AS reviews
FROM staff LEFT JOIN n USING (employee_id) GROUP BY department"""


def q_dataset_versions() -> str:
    return (f"WITH {BASE} SELECT department, count(*) AS first_rows, count(exit_date) AS newest_rows FROM staff "
            "GROUP BY department")


def q_dataset_vacuum() -> str:
    return f"WITH {BASE} SELECT department, count(*) AS rows FROM staff WHERE department <> '{DEPARTMENTS[0]}' GROUP BY department"


def q_text_ids_and_dates() -> str:
    return f"""WITH {BASE} SELECT CASE employee_id % 3 WHEN 0 THEN 'A-' || employee_id
 WHEN 1 THEN lpad(CAST(employee_id AS VARCHAR), 10, '0') ELSE CAST(employee_id AS VARCHAR) END AS employee_id,
 CASE WHEN employee_id % 5 < 4 THEN {d('hire_date').split(' AS ')[0]} END AS hire_date, department FROM staff"""


def q_date_findings() -> str:
    return f"""WITH {BASE} SELECT 'hire_date' AS "column", count(*) FILTER (employee_id % 5 = 4) AS unparsed,
 count(*) FILTER (employee_id % 5 < 4 AND hire_date < DATE '1996-01-01') AS out_of_range FROM staff"""


def q_headcount_without_hire_column() -> str:
    return f"""WITH {BASE}, g AS (SELECT department, count(employee_id) AS headcount FROM staff
 WHERE department IS NOT NULL AND (exit_date IS NULL OR exit_date > TIMESTAMP '{AS_OF} 00:00:00') GROUP BY department)
SELECT department, headcount, headcount / sum(headcount) OVER () * 100.0 AS pct FROM g"""


def q_headcount_without_dates() -> str:
    return f"""WITH {BASE}, g AS (SELECT department, count(employee_id) AS headcount FROM staff
 WHERE department IS NOT NULL GROUP BY department)
SELECT department, headcount, headcount / sum(headcount) OVER () * 100.0 AS pct FROM g"""


def q_rates_without_exit_column() -> str:
    return ("SELECT 0.0::DOUBLE AS attrition_total, 0.0::DOUBLE AS attrition_vol, 0.0::DOUBLE AS attrition_inv, "
            "'warning' AS severity, 'missing_exit_column' AS rule")


def q_display_projection() -> str:
    return f"WITH {BASE} SELECT name AS nome, role AS cargo, department, employee_id FROM staff"


def q_null_clean() -> str:
    return f"""SELECT *, CASE WHEN headcount_period % 2 = 0 THEN NULL ELSE CAST(headcount_period AS DOUBLE) END AS marked
FROM ({q_headcount_compare()})"""


def q_result_json() -> str:
    return f"WITH {BASE}, {CONTRACT} SELECT CAST(to_json(struct_pack(contract_type, quantity, pct)) AS VARCHAR) AS json FROM cm"


def q_scan_staff() -> str:
    return "SELECT o_orderkey AS employee_id, strftime(o_orderdate, '%Y-%m-%d') AS hire_date FROM orders"


def _tidy(section: str, sql: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({sql})"
                              for c in cols)


def q_overview(year=2000, month=6) -> str:
    basic = ("total_active", "clt_count", "clt_pct", "female_count", "female_pct", "male_count", "male_pct",
             "leader_count", "leader_pct")
    period = ("attrition_total", "attrition_vol", "attrition_inv", "avg_headcount", "avg_exits", "avg_voluntary",
              "avg_involuntary", "months_used")
    contract = (f"SELECT 'contract_types' AS section, contract_type || ':quantity' AS metric, CAST(quantity AS DOUBLE) AS value "
                f"FROM ({q_contract_mix()}) UNION ALL SELECT 'contract_types', contract_type || ':pct', CAST(pct AS DOUBLE) "
                f"FROM ({q_contract_mix()})")
    return " UNION ALL ".join([
        _tidy("basic_kpis", q_basic_kpis(), basic),
        _tidy("attrition", q_attrition_period(year, month), period),
        _tidy("attrition_total", q_attrition_period(None, None), period),
        contract,
        _tidy("monthly_dismissals", q_monthly_exits(), ("avg_exits_per_month", "total_exits", "months_with_exits")),
        _tidy("tenure", q_tenure_at_exit(), ("tenure_total", "tenure_vol", "tenure_inv")),
    ])


SCORED_COLS = "employee_id, score_perf_inv, score_promotion, score_tenure, score_merit, score_team"


def _tidy_rows(section: str, sql: str, item: str | None, value: str = "headcount", month: bool = True) -> str:
    return (f"SELECT '{section}' AS section, {'month' if month else 'CAST(NULL AS VARCHAR)'} AS month, "
            f"CAST({item or 'NULL'} AS VARCHAR) AS item, CAST({value} AS DOUBLE) AS value FROM ({sql})")


def q_headcount_bundle() -> str:
    return " UNION ALL ".join([
        _tidy_rows("headcount_by_department", q_headcount_at("department", "2000-06-01"), "department", month=False),
        _tidy_rows("headcount_temporal", q_headcount_monthly("department"), "department"),
        _tidy_rows("headcount_growth", q_headcount_growth(), "department", "growth_pct"),
        _tidy_rows("headcount_gender", q_headcount_monthly("gender"), "gender"),
        _tidy_rows("headcount_tenure", q_headcount_monthly_tenure(), "tenure_band"),
        _tidy_rows("headcount_performance", q_headcount_monthly("rating", "sr"), "rating")])


def q_attrition_bundle() -> str:
    return " UNION ALL ".join([
        _tidy_rows("attrition_period", q_attrition_period(2000, None), None, "attrition_total", month=False),
        _tidy_rows("attrition_history", q_attrition_history(), None, "attrition_total")])


ORACLE = {
    "headcount_bundle": q_headcount_bundle(),
    "attrition_bundle": q_attrition_bundle(),
    "attrition_history": q_attrition_history(),
    "attrition_history_by_department": q_attrition_history_by_department(),
    "attrition_history_means": q_attrition_history_means(),
    "period_label": q_period_label(),
    "attrition_period_month": q_attrition_period(2000, 6),
    "attrition_period_year": q_attrition_period(2000, None),
    "attrition_period_month_all_years": q_attrition_period(None, 3),
    "attrition_period_all": q_attrition_period(None, None),
    "attrition_flagged": q_attrition_flagged(),
    "period_flags": q_period_flags(),
    "attrition_by_department": q_attrition_by_department(),
    "attrition_compare": q_attrition_compare(),
    "headcount_at": q_headcount_at("department", "2000-06-30"),
    "headcount_gender_at": q_headcount_at("gender", AS_OF),
    "headcount_at_month_start": q_headcount_at("department", "2000-06-01"),
    "headcount_compare": q_headcount_compare(),
    "headcount_monthly": q_headcount_monthly("department"),
    "headcount_monthly_gender": q_headcount_monthly("gender"),
    "headcount_monthly_rating": q_headcount_monthly("rating", "sr"),
    "headcount_monthly_tenure": q_headcount_monthly_tenure(),
    "headcount_growth": q_headcount_growth(),
    "growth_summary": q_growth_summary(),
    "growth_gender_recent": q_growth_gender_recent(),
    "headcount_slice": q_headcount_monthly("department", where="WHERE strftime(m, '%Y') = '2000'"),
    "tenure_band_latest": q_tenure_band_latest(),
    "rating_latest": q_rating_latest(),
    "headcount_growth_recent": q_headcount_growth_recent(),
    "tenure_at_exit": q_tenure_at_exit(),
    "contract_mix": q_contract_mix(),
    "contract_top4": q_contract_top4(),
    "monthly_exits": q_monthly_exits(),
    "basic_kpis": q_basic_kpis(),
    "quality_report": q_quality_report(),
    "latest_review": q_latest_review(),
    "prepare_staff": q_prepare_staff(),
    "core_fields": q_core_fields(),
    "coerce_dates": q_coerce_dates(),
    "team_size": q_team_size(),
    "risk_features": q_risk("SELECT employee_id, months_since_promotion, months_since_merit, team_size, perf_raw, "
                            "tenure_months FROM f"),
    "minmax_scores": q_risk(f"SELECT {SCORED_COLS} FROM sc"),
    "risk_scores": q_risk("SELECT employee_id, risk FROM scored"),
    "risk_reasons": q_risk("SELECT employee_id, reasons FROM reasons"),
    "risk_summary": q_risk(f"SELECT {rnd('avg(risk)', 1)} AS avg_risk, "
                           f"{rnd('avg(CASE WHEN risk > 60 THEN 1.0 ELSE 0.0 END) * 100', 1)} AS high_risk_pct FROM scored"),
    "risk_histogram": q_risk_histogram(),
    "risk_by_promotion_gap": q_risk_by_promotion_gap(),
    "risk_ranking": q_risk("SELECT employee_id, name, department, role, rating, risk, reasons FROM reasons"),
    "attrition_forecast": q_attrition_forecast(),
    "insights": q_insights(),
    "report_lines": q_report_lines(),
    "overview": q_overview(),
    "insights_with_trends": (f"SELECT * FROM ({q_insights()}) UNION ALL SELECT 8, 'trend', 'attrition_trend', trend, slope, message "
                             f"FROM ({q_attrition_forecast()}) WHERE trend IS NOT NULL"),
    "report_file": f"SELECT text, count(*) AS lines FROM ({q_report_lines()}) GROUP BY text",
    "month_numbers": history_sql() + f"SELECT strftime(m, '%Y-%m') AS month, {MONTHS_PT}[month(m)] AS name, month(m) AS number FROM hist",
    "attrition_history_until": q_attrition_history("2002-06-01"),
    "headcount_monthly_until": q_headcount_monthly("department", end="2002-06-01"),
    "period_flags_default": (f"WITH {BASE} SELECT unnest(['none', 'year']) AS period, count(*) FILTER (exit_date IS NULL) AS active, "
                             "CAST(0 AS BIGINT) AS exited FROM staff"),
    "history_from_summaries": q_attrition_history(),
    "headcount_from_summaries": q_headcount_monthly("department"),
    "prepare_staff_cached": (f"SELECT p.employee_id, p.department, c.active, c.tenure_months FROM (WITH {BASE} SELECT employee_id, "
                             f"department FROM staff) p JOIN ({q_core_fields()}) c USING (employee_id)"),
    "facets_cascade": q_facets(True),
    "facets_others": q_facets(False),
    "staff_of_named_managers": q_staff_of_named_managers(),
    "facets_of_named_managers": q_facets_of_named_managers(),
    "name_search_indexed": q_name_search_indexed(),
    "learned_dates": q_learned_dates(),
    "date_orders": q_date_orders(),
    "facet_values": q_facet_values(),
    "staff_filtered": q_staff_filtered(),
    "staff_filtered_count": q_staff_filtered_count(),
    "name_search": q_name_search(),
    "available_years": q_available_years(),
    "hires_in_period": q_hires_in_period(),
    "table_profile": q_table_profile(),
    "schema_report": q_schema_report(),
    "table_preview": f"SELECT * FROM ({q_dataset_roundtrip()}) ORDER BY employee_id LIMIT 5",
    "dataset_roundtrip": q_dataset_roundtrip(),
    "dataset_catalog": q_dataset_catalog(),
    "dataset_delete": q_dataset_delete(),
    "dataset_resaved": q_dataset_catalog(),
    "save_analysis": f"SELECT 'attrition_history' AS kind, * FROM ({q_attrition_history()})",
    "saved_results": q_saved_results(),
    "dataset_tables": q_dataset_tables(),
    "dataset_versions": q_dataset_versions(),
    "dataset_vacuum": q_dataset_vacuum(),
    "mixed_exit_types": q_attrition_history().replace(
        VOL, f"CASE WHEN employee_id % 2 = 1 THEN coalesce(manager_id % 3 = 0, false) ELSE {VOL} END"),
    "text_ids_and_dates": q_text_ids_and_dates(),
    "date_findings": q_date_findings(),
    "headcount_without_hire_column": q_headcount_without_hire_column(),
    "headcount_without_dates": q_headcount_without_dates(),
    "rates_without_exit_column": q_rates_without_exit_column(),
    "display_projection": q_display_projection(),
    "null_clean": q_null_clean(),
    "result_json": q_result_json(),
    "scan_staff": q_scan_staff(),
}
