"""The posting lens: the star and event tables seen as postings, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
SKILLS = ("the", "and", "that", "with", "der", "und", "nicht", "les", "que", "con", "los", "por")

SQL = f"""
SELECT d.doc_id AS id, s.s_name AS company, substr('SABC', CAST(s.s_suppkey % 4 + 1 AS INT), 1) AS priority,
  p.p_name || ' ' || p.p_type AS title, p.p_type AS role_category, p.p_name AS part_name, n.n_name AS location, r.r_name AS state, r.r_name = 'AMERICA' AS is_usa,
  d.text AS body, d.lang AS lang, d.source AS platform, p.p_size > 40 AS is_senior, p.p_size < 15 AS is_entry,
  CAST(p.p_size * 2 AS INT) AS new_grad_fit, CAST(100 - p.p_size * 2 AS INT) AS experienced_fit, CAST(d.n_chars % 101 AS INT) AS match_score,
  coalesce(e.first_ts, {AS_OF} - INTERVAL '30' DAY) AS first_seen, coalesce(e.last_ts, {AS_OF} - INTERVAL '30' DAY) AS last_seen,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE coalesce(e.first_ts, {AS_OF} - INTERVAL '30' DAY) - CAST(d.doc_id % 10 AS INT) * INTERVAL '1' DAY END AS posted_date,
  CASE WHEN d.doc_id % 10 = 0 THEN 'high' WHEN d.doc_id % 10 < 4 THEN 'medium' ELSE 'low' END AS eligibility_risk
FROM (SELECT *, doc_id % (SELECT count(*) FROM supplier) AS sk, doc_id % (SELECT count(*) FROM part) AS pk FROM documents) d
JOIN supplier s ON s.s_suppkey = d.sk JOIN part p ON p.p_partkey = d.pk
JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS first_ts, CAST(max(ts) AS TIMESTAMP) AS last_ts FROM events GROUP BY user_id) e ON e.user_id = d.doc_id % 150
"""

#: The skills of a posting as DuckDB computes them; in Spark `with_skills`.
DUCK_SKILLS = "list_filter([" + ", ".join(f"'{s}'" for s in SKILLS) + "], lambda t: contains(' ' || regexp_replace(lower(coalesce(body, '')), '[^a-z]+', ' ', 'g') || ' ', ' ' || t || ' '))"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "supplier", "part", "nation", "region", "events")
    out = SQL
    for t in names:
        out = out.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(out, **{t: read(spark, sf_dir, t) for t in names})


def with_skills(df: DataFrame) -> DataFrame:
    """df with its skills in list order; a text is cut into words once."""
    words = F.split(F.lower(F.coalesce("body", F.lit(""))), "[^a-z]+")
    return df.select("*", F.array_intersect(F.array(*map(F.lit, SKILLS)), words).alias("skills"))


def duck(body: str) -> str:
    """A DuckDB query over `lens` (and `skilled`, with skills)."""
    return f"WITH lens AS ({SQL}), skilled AS (SELECT *, {DUCK_SKILLS} AS skills FROM lens)\n{body}"
