"""op9: verdicts of all page urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliplens.llm import linkgraph as g

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return g.judge_urls(pages, RULES).select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def _sql() -> str:
    cases = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[1] != "block")):
        name, slash, rest = rule.partition("/")
        cases.append((f"(host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash}{rest}')",
                      rule, verdict))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    url, link = g.URL.replace("'", "''"), g.LINK.replace('\\"', '"').replace("'", "''")

    def lower(x):
        return f"translate({x}, '{g.UPPER}', '{g.LOWER}')"

    def share(amount, total):
        return f"(links * ({amount} // {total}) + (({amount} % {total}) * links) // {total})"

    parts = [f"""
WITH p AS (SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, '{url}', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
k AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM p),
counted AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good,
                   count(*) FILTER (ruled = 'block') AS bad FROM k GROUP BY host),
s0 AS (SELECT host, CASE WHEN good + bad = 0 THEN 0 ELSE ({g.UNIT} * good) // (good + bad) END AS trust,
              CASE WHEN good + bad = 0 THEN 0 ELSE ({g.UNIT} * bad) // (good + bad) END AS distrust
       FROM counted),
found AS (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst
          FROM p WHERE host <> ''),
l AS (SELECT src, dst, count(*) AS links FROM found WHERE dst <> '' AND dst <> src GROUP BY src, dst),
e AS (SELECT *, CAST(sum(links) OVER (PARTITION BY src) AS BIGINT) AS out,
             CAST(sum(links) OVER (PARTITION BY dst) AS BIGINT) AS into_ FROM l)"""]
    for i in range(g.ROUNDS):
        parts.append(f"""
m{i} AS (SELECT host, CAST(sum(trust) AS BIGINT) AS trust, CAST(sum(distrust) AS BIGINT) AS distrust FROM (
  SELECT dst AS host, {share("trust", "out")} AS trust, 0 AS distrust FROM e JOIN s{i} ON s{i}.host = e.src
  UNION ALL
  SELECT src AS host, 0 AS trust, {share("distrust", "into_")} AS distrust FROM e JOIN s{i} ON s{i}.host = e.dst)
  GROUP BY host),
s{i + 1} AS (SELECT coalesce(s0.host, m{i}.host) AS host,
  ({100 - g.FOLLOW} * coalesce(s0.trust, 0) + {g.FOLLOW} * coalesce(m{i}.trust, 0)) // 100 AS trust,
  ({100 - g.FOLLOW} * coalesce(s0.distrust, 0) + {g.FOLLOW} * coalesce(m{i}.distrust, 0)) // 100 AS distrust
  FROM s0 FULL JOIN m{i} ON m{i}.host = s0.host)""")
    return ",".join(parts) + f"""
SELECT page_id, k.host, path, rule,
       coalesce(ruled, CASE WHEN f.distrust > f.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN s{g.ROUNDS} f ON f.host = k.host"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": _sql()}
