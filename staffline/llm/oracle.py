"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from staffline.llm import secrets
from staffline.llm.store import LOWER, UPPER
from staffline.llm.urltree import RULES


def _verdicts(rules) -> tuple[str, str]:
    """CASE branches of rule and verdict, the longest rule first."""
    rule = verdict = ""
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        host, _, path = r.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rule += f" WHEN {fits} THEN '{r}'"
        verdict += f" WHEN {fits} THEN '{v}'"
    return f"CASE{rule} END", f"CASE{verdict} END"


def url_filter_sql(rules=RULES, depth: int = 8, least_labels: int = 3, max_kinds: int = 20, min_labels: int = 5, z: float = 1.96,
                   smoothing: float = 5.0, threshold: float = 0.8) -> str:
    """The path-template tree, one level of tables for each leading segment (``depth``: most segments of a path)."""
    rule, verdict = _verdicts(rules)
    segs = [f"s{i}" for i in range(depth)]
    parts = ", ".join(f"coalesce(regexp_replace(parts[{i + 1}], '[0-9]+', '#', 'g'), '') AS s{i}" for i in range(depth))
    at = "regexp_extract(rest, '^([^/?#]*)([^?#]*)', {})"
    sql = f"""WITH cut AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0
   THEN substr(url, position('://' IN url) + 3) ELSE '' END, '') AS rest FROM pages),
named AS (SELECT page_id, translate({at.format(1)}, '{UPPER}', '{LOWER}') AS host, {at.format(2)} AS path FROM cut),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS given, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM named),
urls AS (SELECT page_id, host, path, rule, given, {parts} FROM ruled),
t0 AS (SELECT host, {', '.join(segs)}, count(*) AS n, count(given) AS labelled,
   count(*) FILTER (given = 'block') AS blocked, '' AS template FROM urls GROUP BY ALL)"""
    for i in range(depth):
        sql += f""",
b{i} AS (SELECT host, template, s{i} AS seg, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b FROM t{i} GROUP BY ALL),
q{i} AS (SELECT host, template, count(*) AS kinds, sum(n) AS pn, sum(l) AS pl, sum(b) AS pb FROM b{i} GROUP BY ALL),
c{i} AS (SELECT b.host, b.template, seg, CASE WHEN seg = '' THEN ''
   WHEN kinds = 1 THEN '/' || seg
   WHEN (kinds > {max_kinds} AND n * {max_kinds} <= pn)
     OR (l >= {min_labels} AND pl - l >= {min_labels} AND abs(b / l - (pb - b) / (pl - l))
       < {z} * sqrt((pb + 1) / (pl + 2) * (1 - (pb + 1) / (pl + 2)) * (1 / l + 1 / (pl - l)))) THEN '/*'
   ELSE '/' || seg END AS part
   FROM b{i} b JOIN q{i} q ON b.host = q.host AND b.template = q.template),
t{i + 1} AS (SELECT t.* REPLACE (t.template || part AS template) FROM t{i} t JOIN c{i} c
   ON t.host = c.host AND t.template = c.template AND t.s{i} = c.seg)"""
    last, m = f"t{depth}", float(smoothing)
    same = " AND ".join(f"u.{s} = t.{s}" for s in segs)
    return sql + f""",
total AS (SELECT (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS p FROM {last}),
sums AS (SELECT host, template, regexp_replace(template, '/[^/]*$', '') AS parent, sum(blocked) AS b, sum(labelled) AS own
   FROM {last} GROUP BY host, template),
split AS (SELECT host, parent, (sum(b) + {m} * max(p)) / (sum(own) + {m}) AS prior FROM sums, total GROUP BY host, parent),
leaves AS (SELECT s.host, template, own, (b + {m} * prior) / (own + {m}) AS purity
   FROM sums s JOIN split x ON s.host = x.host AND s.parent = x.parent)
SELECT page_id, u.host, path, rule, coalesce(given, CASE WHEN purity >= {threshold} AND own >= {least_labels} THEN 'block' ELSE 'allow' END) AS verdict,
  t.template, purity
FROM urls u JOIN {last} t ON u.host = t.host AND {same} JOIN leaves x ON t.host = x.host AND t.template = x.template"""


def secrets_sql(max_owners: int = 1, max_repos: int = 3, min_token: int = 20, min_variety: int = 8) -> str:
    """Matches and the gaps between them by kind, places by running sums, owners by distinct counts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds, base = list(secrets.PATTERNS), len(secrets.BASE)
    found = " UNION ALL ".join(
        f"""SELECT rid, owner, repo, {n} AS kind, unnest(regexp_extract_all(t, {p})) AS m,
  unnest(list_slice(regexp_split_to_array(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS gap,
  unnest(range(len(regexp_extract_all(t, {p})))) AS k FROM d"""
        for n, p in enumerate(quote(v % min_token if k == "owned" else v) for k, v in secrets.PATTERNS.items()))
    least = " ".join(f"WHEN {n} THEN length(value) >= {secrets.LEAST[k]}" for n, k in enumerate(secrets.BASE))
    names = " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(kinds))
    told = f"CASE kind {names} END || ':' || start || ':' || stop"
    joined = lambda where: (f"coalesce(string_agg({told}, ',' ORDER BY start, kind, stop)"  # noqa: E731
                            f"{where and f' FILTER ({where})'}, '')")
    counts = [f"count(*) FILTER (kind = {n}) AS n_{k}" for n, k in enumerate(kinds)]
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, struct_pack(s := source, l := lang) AS repo,
  coalesce(text, '') AS t FROM documents),
found AS ({found}),
valued AS (SELECT *, CASE kind WHEN 0 THEN regexp_replace(m, {quote('^' + secrets.NAMED)}, '') ELSE m END AS value,
  sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS stop FROM found),
looked AS (SELECT rid, owner, repo, kind, m, value, CAST(stop AS BIGINT) AS stop, CAST(stop - length(m) AS BIGINT) AS start,
  len(list_distinct(string_split(value, ''))) >= {min_variety} AND NOT regexp_matches(lower(value), '{secrets.PLACEHOLDERS}') AS live
  FROM valued),
held AS (SELECT * FROM looked WHERE CASE kind {least}
  ELSE live AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') END),
spans AS (SELECT * FROM held h WHERE kind < {base} OR NOT EXISTS (SELECT 1 FROM held b WHERE b.rid = h.rid AND b.kind < {base}
  AND b.start < h.stop AND b.stop > h.start)),
known AS (SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(DISTINCT repo) AS repos FROM spans GROUP BY value),
judged AS (SELECT s.* REPLACE (s.live AND owners <= {max_owners} AND repos <= {max_repos} AS live),
  NOT (owners <= {max_owners} AND repos <= {max_repos}) AS copied FROM spans s JOIN known USING (value)),
told AS (SELECT rid, {', '.join(counts)}, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied,
  {joined(f'kind < {base}')} AS base, {joined('')} AS spans, {joined('live')} AS live
  FROM judged WHERE kind < {base} OR live GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(live, '') AS live FROM d LEFT JOIN told USING (rid)"""


ORACLE = {
    "op13_secret_ownership": secrets_sql(),
    "op2_url_filter": url_filter_sql(),
}
