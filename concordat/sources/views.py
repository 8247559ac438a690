"""Derived views over the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "v_flow": """
        SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(s_nationkey AS INT) AS i, CAST(c_nationkey AS INT) AS j,
               l_partkey AS k, p_type AS section, CAST(l_extendedprice AS DECIMAL(18,2)) AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    """,
    "v_bloc_member": """
        SELECT CAST(n_nationkey AS INT) AS code, CAST(1995 + n_nationkey % 4 AS INT) AS acc_year,
               CAST(CASE WHEN n_nationkey % 4 = 0 THEN 1999 END AS INT) AS exit_year
        FROM nation WHERE n_regionkey = 3
    """,
    "v_member": """
        SELECT CAST(n_nationkey AS INT) AS code,
               CAST(1995 + CASE WHEN n_nationkey % 7 = 0 THEN 2 ELSE 0 END AS INT) AS join_year
        FROM nation WHERE n_nationkey <> 24
    """,
    "v_ally": """
        SELECT CAST(a.n_nationkey AS INT) AS a, CAST(b.n_nationkey AS INT) AS b, y.year AS year, 1 AS atopally
        FROM nation a CROSS JOIN nation b
        CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) y
        WHERE a.n_nationkey <> b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 5 = 0 AND y.year <= 1999
    """,
    "v_pta": """
        SELECT CAST(a.n_nationkey AS INT) AS a, CAST(b.n_nationkey AS INT) AS b, y.year AS year,
               CAST(CASE WHEN (a.n_nationkey * b.n_nationkey) % 3 = 0 THEN 1 ELSE 0 END AS INT) AS label,
               CAST(CASE WHEN (a.n_nationkey * b.n_nationkey) % 3 = 0 AND (a.n_nationkey + b.n_nationkey) % 8 <> 7
                    THEN (a.n_nationkey + b.n_nationkey) % 8 END AS INT) AS depth_index
        FROM nation a CROSS JOIN nation b
        CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) y
        WHERE a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 2 = 0
    """,
    "v_node": """
        SELECT n.code AS code, n.year AS year,
               CASE WHEN (n.code + n.year) % 9 = 0 THEN CAST(NULL AS DECIMAL(18,2)) ELSE g.gdp END AS gdp,
               g.pop AS pop,
               CASE WHEN n.code = 24 OR (n.code * 3 + n.year) % 7 = 0 THEN CAST(NULL AS DOUBLE)
                    ELSE CAST((n.code * 37 + n.year * 11) % 61 AS DOUBLE) / 20 - 1 END AS idealpoint
        FROM (SELECT CAST(n_nationkey AS INT) AS code, y.year AS year FROM nation
              CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) y) n
        LEFT JOIN (SELECT CAST(c_nationkey AS INT) AS code, CAST(year(o_orderdate) AS INT) AS year,
                          CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS gdp,
                          CAST(COUNT(DISTINCT c_custkey) AS BIGINT) AS pop
                   FROM orders JOIN customer ON o_custkey = c_custkey
                   GROUP BY CAST(c_nationkey AS INT), CAST(year(o_orderdate) AS INT)) g
          ON n.code = g.code AND n.year = g.year
    """,
    "v_case": """
        SELECT o_orderkey AS case_id, CAST(year(o_orderdate) AS INT) AS year,
               CAST(CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) END AS INT) AS severity,
               concat(lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0'), '-',
                      CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr'
                        WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep'
                        WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END, '-',
                      substr(CAST(year(o_orderdate) AS VARCHAR(4)), 3, 2)) AS date_text
        FROM orders WHERE o_orderstatus = 'F'
    """,
    "v_case_party": """
        SELECT DISTINCT o_orderkey AS case_id, 'complainant' AS role, CAST(c_nationkey AS INT) AS party
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT DISTINCT o_orderkey AS case_id,
               CASE WHEN l_returnflag = 'R' THEN 'respondent' ELSE 'third_party' END AS role, CAST(s_nationkey AS INT) AS party
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE o_orderstatus = 'F' AND l_returnflag IN ('R', 'A')
    """,
    "v_case_section": """
        SELECT DISTINCT o_orderkey AS case_id, p_type AS section
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'
    """,
}

#: Common table expressions in front of an oracle's SELECT.
CTES = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view; Catalyst prunes columns and pushes filters through the views."""
    if name in VIEWS:
        return spark.sql(_bound(VIEWS[name]), **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in _bound(VIEWS[name])})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(sql: str) -> str:
    """sql with the tables after FROM and JOIN as parameters of SparkSession.sql."""
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", sql)


def oracle(select: str) -> str:
    return f"{CTES} {select}"
