"""Queries on keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.operators import hotkeys
from graphlode.plans.session import stage, table


def _valid() -> Column:
    return F.col("confidence").between(0.0, 1.0)  # NaN is greater than any number


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hotkeys.once(table(spark, sf_dir, "dependency_nodes"), "dep_id", "project", "qualified_name", "confidence")
    return rows.withColumn("qualified_name", hotkeys.normal_name(F.col("qualified_name")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.heavy_keys(_names(spark, sf_dir), ["project", "qualified_name"], "confidence", _valid(), 0.01).select("project", "qualified_name")


def p3_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.per_key(_names(spark, sf_dir), ["project", "qualified_name"], "confidence", _valid())


def p3_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_names(spark, sf_dir).where(_valid()).select("project", "qualified_name", "confidence"))
    return hotkeys.quantiles(rows, ["project", "qualified_name"], "confidence", (0.1, 0.5, 0.9))


_ROWS = r"""rows_once AS (
  SELECT dep_id, m.project AS project, m.confidence AS confidence,
         regexp_replace(replace(regexp_replace(m.qualified_name, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', '') AS qualified_name
  FROM (SELECT dep_id, min(struct_pack(project := project, qualified_name := qualified_name, confidence := confidence)) AS m
        FROM dependency_nodes WHERE dep_id IS NOT NULL GROUP BY dep_id))"""

QUERIES = {"p3_found": p3_found, "p3_means": p3_means, "p3_quantiles": p3_quantiles}
ORACLES = {
    "p3_found": f"""WITH {_ROWS}
SELECT project, qualified_name FROM rows_once WHERE project IS NOT NULL AND qualified_name IS NOT NULL
GROUP BY project, qualified_name HAVING count(*) >= 0.01 * (SELECT count(*) FROM rows_once)""",
    "p3_means": f"""WITH {_ROWS}
SELECT project, qualified_name, count(*) AS n_rows, count(*) FILTER (WHERE confidence BETWEEN 0 AND 1) AS n_valid,
       round(CAST(sum(CAST(confidence AS DECIMAL(20, 12))) FILTER (WHERE confidence BETWEEN 0 AND 1) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE confidence BETWEEN 0 AND 1), 0), 6) AS mean
FROM (SELECT project, qualified_name, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence FROM rows_once)
WHERE project IS NOT NULL AND qualified_name IS NOT NULL GROUP BY project, qualified_name""",
    "p3_quantiles": f"""WITH {_ROWS}, good AS (
  SELECT project, qualified_name, confidence, row_number() OVER (PARTITION BY project, qualified_name ORDER BY confidence) AS place,
         count(*) OVER (PARTITION BY project, qualified_name) AS n
  FROM rows_once WHERE project IS NOT NULL AND qualified_name IS NOT NULL AND confidence BETWEEN 0 AND 1)
SELECT project, qualified_name, q.quantile AS quantile, confidence AS result
FROM good, (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9)) AS q(quantile) WHERE place = greatest(1, CAST(ceil(q.quantile * n) AS BIGINT))""",
}
