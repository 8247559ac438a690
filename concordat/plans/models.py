"""Statistical models: regressions by distributed Newton rounds, with SQL that finds the same optimum another way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from concordat.operators import network, newton, stats, survival
from concordat.plans.catalog import DYADS, ORACLES, ROLES, _dyads, _scored, grf21_change_statistics, query
from concordat.sources.views import table


def recursive(f):
    """The query's SQL with recursive common table expressions."""
    ORACLES[f.__name__] = ORACLES[f.__name__].replace("WITH ", "WITH RECURSIVE ", 1)
    return f


def fit_sql(p: int, sweeps: int) -> str:
    """Common table expressions after cells (x: list of p regressors, n rows, s sum of outcomes): fitted (b), found one
    coordinate after another instead of by Newton's method."""
    return f"""steps(t, b) AS (SELECT 0, list_transform(range({p}), lambda i: 0.0::DOUBLE)
        UNION ALL SELECT t + 1, list_transform(b, lambda v, i: v + CASE WHEN i = t % {p} + 1 THEN step ELSE 0 END) FROM (
            SELECT t, b, SUM((s - n * m) * x[t % {p} + 1]) / SUM(n * m * (1 - m) * x[t % {p} + 1] * x[t % {p} + 1]) AS step
            FROM (SELECT t, b, x, n, s, 1 / (1 + exp(-list_dot_product(b, x))) AS m FROM steps, cells) GROUP BY t, b) WHERE t < {p * sweeps}),
    fitted AS (SELECT b FROM steps WHERE t = {p * sweeps})"""


def inverse_sql(name: str, matrix: str, p: int) -> str:
    """Common table expressions that give name (m), the inverse of the one positive definite matrix (m) of a table."""
    unit = f"list_transform(range(1, {p + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END)"
    return f"""{name}_steps(k, m) AS (SELECT 0, list_transform(m, lambda r, i: list_concat(r, {unit})) FROM {matrix}
        UNION ALL SELECT k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k + 1 THEN v / r[k + 1] ELSE v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1] END))
        FROM {name}_steps WHERE k < {p}),
    {name} AS (SELECT list_transform(m, lambda r: r[{p + 1}:]) AS m FROM {name}_steps WHERE k = {p})"""


def sums_sql(name: str, source: str, weight: str, x: str, p: int) -> str:
    """A common table expression name (m): the weighted sum of outer products of a list column."""
    return f"""{name} AS (SELECT list(r ORDER BY row_) AS m FROM (SELECT row_, list(v ORDER BY col_) AS r FROM (
        SELECT row_, col_, SUM({weight} * {x}[row_] * {x}[col_]) AS v FROM {source}, range(1, {p + 1}) a(row_), range(1, {p + 1}) b(col_) GROUP BY ALL) GROUP BY row_))"""


#: Dyad-years with disputes, alliances and centred log trade, the rows of the fixed-effects logit.
PANEL = """panel AS (SELECT d.year, d.i, d.j, CAST(EXISTS (SELECT 1 FROM scored s WHERE s.relation = 'C-R' AND s.severity >= 4 AND s.year = d.year AND s.a = d.i AND s.b = d.j) AS DOUBLE) AS y,
    CAST(COALESCE(a.atopally, 0) AS DOUBLE) AS ally, ln(exports) - AVG(ln(exports)) OVER () AS trade
    FROM dyads d LEFT JOIN v_ally a ON a.year = d.year AND a.a = d.i AND a.b = d.j)"""
#: Seven years, the effects of which come first in the SQL's own parameters, then ally, trade and their product.
LOGIT_SQL = (
    """years AS (SELECT list(year ORDER BY year) AS all_years FROM (SELECT DISTINCT year FROM panel)),
    rows_ AS (SELECT i, j, y, list_concat(list_transform(all_years, lambda v: CASE WHEN v = year THEN 1.0::DOUBLE ELSE 0.0 END), [ally, trade, ally * trade]) AS x,
        list_concat([1.0::DOUBLE, ally, trade, ally * trade], list_transform(all_years[2:], lambda v: CASE WHEN v = year THEN 1.0::DOUBLE ELSE 0.0 END)) AS z FROM panel, years),
    cells AS MATERIALIZED (SELECT x, CAST(COUNT(*) AS DOUBLE) AS n, SUM(y) AS s FROM rows_ GROUP BY x)""",
    fit_sql(10, 80),
    """beta AS (SELECT list_concat([b[1], b[8], b[9], b[10]], list_transform(b[2:7], lambda v: v - b[1])) AS b FROM fitted),
    residual AS (SELECT i, j, z, y - m AS e, m * (1 - m) AS w FROM (SELECT i, j, y, z, 1 / (1 + exp(-list_dot_product(b, z))) AS m FROM rows_, beta))""",
    sums_sql("information", "residual", "w", "z", 10),
    inverse_sql("bread", "information", 10),
    """scores AS (SELECT i, j, list(v ORDER BY k) AS u FROM (SELECT i, j, k, SUM(e * z[k]) AS v FROM residual, range(1, 11) r(k) GROUP BY i, j, k) GROUP BY i, j)""",
    sums_sql("meat", "scores", "1.0", "u", 10),
    """sandwich AS (SELECT list_transform(bread.m, lambda r: list_transform(bread.m, lambda c: g / (g - 1) * list_dot_product(list_transform(meat.m, lambda q: list_dot_product(q, r)), c))) AS v, bread.m AS bread
        FROM bread, meat, (SELECT CAST(COUNT(*) AS DOUBLE) AS g FROM scores)),
    names AS (SELECT list_concat(['intercept', 'ally', 'trade', 'ally_x_trade'], list_transform(all_years[2:], lambda v: 'year_' || v)) AS t FROM years)""",
)


def _panel(s, d):
    """Dyad-years with trade: dispute (a case of severity 4 or more), ally, trade (log, centred), their product, dyad."""
    arcs = _scored(s, d).filter("relation = 'C-R' AND severity >= 4").select("year", F.col("a").alias("i"), F.col("b").alias("j")).distinct().withColumn("y", F.lit(1.0))
    allies = table(s, d, "v_ally").select("year", F.col("a").alias("i"), F.col("b").alias("j"), F.col("atopally").cast("double").alias("ally"))
    rows = _dyads(s, d).select("year", "i", "j", F.log("exports").alias("trade")).join(arcs, ["year", "i", "j"], "left").join(allies, ["year", "i", "j"], "left").fillna(0.0, ["y", "ally"])
    rows = newton.stored(rows, "panel")
    mean = rows.agg(F.avg("trade")).first()[0] or 0.0
    return rows.withColumn("trade", F.col("trade") - mean).withColumn("ally_x_trade", F.col("ally") * F.col("trade")).withColumn("dyad", F.struct("i", "j"))


def _panel_fit(s, d):
    rows, years = newton.factor(_panel(s, d), "year")
    terms = ["ally", "trade", "ally_x_trade", *years]
    fit = newton.logit(rows, "y", terms)
    return fit, newton.cluster_covariance(fit, rows, "y", terms, "dyad")


@recursive
@query(
    "SELECT t[k] AS term, ROUND(b[k], 5) AS estimate, ROUND(sqrt(bread[k][k]), 5) AS std_error, ROUND(sqrt(v[k][k]), 5) AS cluster_error, ROUND(b[k] / sqrt(v[k][k]), 3) AS z FROM beta, sandwich, names, range(1, 11) r(k)",
    ROLES,
    DYADS,
    PANEL,
    *LOGIT_SQL,
)
def mod07_logit_fixed_effects(s, d):
    """Disputes of dyad-years on alliance, trade and their product with year effects, and errors clustered by dyad.

    Where every dyad of a year has a dispute no estimate is finite, and all figures are NaN."""
    fit, covariance = _panel_fit(s, d)
    bread = np.linalg.inv(fit.information[0]) if fit.bounded[0] else np.full_like(covariance, np.nan)
    error, cluster = np.sqrt(np.diag(bread)), np.sqrt(np.diag(covariance))
    rows = [(t, float(b), float(e), float(c), float(b / c)) for t, b, e, c in zip(fit.names, fit.estimates[0], error, cluster)]
    found = s.createDataFrame(rows, "term string, estimate double, std_error double, cluster_error double, z double")
    return found.select("term", *(F.round(c, 5).alias(c) for c in ("estimate", "std_error", "cluster_error")), F.round("z", 3).alias("z"))


@recursive
@query(
    "SELECT t[k] AS term, t[l] AS other, ROUND(v[k][l], 7) AS covariance FROM sandwich, names, range(1, 11) r(k), range(1, 11) q(l)",
    ROLES,
    DYADS,
    PANEL,
    *LOGIT_SQL,
)
def mod04_cluster_covariance(s, d):
    """The whole covariance matrix of that fit, with scores added up by dyad."""
    fit, v = _panel_fit(s, d)
    rows = [(a, b, float(v[k, l])) for k, a in enumerate(fit.names) for l, b in enumerate(fit.names)]  # noqa: E741
    return s.createDataFrame(rows, "term string, other string, covariance double").withColumn("covariance", F.round("covariance", 7))


TIE_TERMS = ["mutual", "gwout", "gwin", "delrecip", "stability", "trade", "sender_size", "receiver_size", "size_gap"]


def tie_features(s, d):
    """The features of every ordered pair of a year's nodes, with trade and size in logarithms."""
    rows = grf21_change_statistics(s, d)
    logs = {"trade": F.log1p("exports"), "sender_size": F.log1p("sender_pop"), "receiver_size": F.log1p("receiver_pop")}
    return rows.withColumns(logs).withColumn("size_gap", F.abs(F.col("sender_size") - F.col("receiver_size")))


@query()
def mod10_bootstrapped_ties(s, d):
    """Pseudo-likelihood of the yearly networks with 95 % intervals from 1000 draws of years."""
    whole, again, periods = newton.bootstrap_periods(tie_features(s, d), "tie", TIE_TERMS, "year", replicates=1000)
    low, high = np.quantile(again.params, [0.025, 0.975], axis=0)
    rows = [("edges" if t == "intercept" else t, float(b), float(lo), float(hi), int(again.converged.sum()), len(periods)) for t, b, lo, hi in zip(whole.names, whole.params[0], low, high)]
    found = s.createDataFrame(rows, "term string, estimate double, low double, high double, replicates long, periods long")
    return found.withColumns({c: F.round(c, 5) for c in ("estimate", "low", "high")})


#: Cases of known severity (levels 0 to 3) with numbers of respondents and third parties, and years from 1995.
CASES = """cases AS (SELECT case_id, CASE severity WHEN 1 THEN 0 ELSE severity - 2 END AS y, COALESCE(respondents, 0) AS respondents, COALESCE(thirds, 0) AS thirds, year - 1995 AS years
    FROM v_case LEFT JOIN (SELECT case_id, COUNT(*) FILTER (role = 'respondent') AS respondents, COUNT(*) FILTER (role = 'third_party') AS thirds FROM v_case_party GROUP BY case_id) USING (case_id) WHERE severity IS NOT NULL)"""
_ORDERED = (
    "cells AS MATERIALIZED (SELECT y, [CAST(respondents AS DOUBLE), CAST(thirds AS DOUBLE), CAST(years AS DOUBLE)] AS x, CAST(COUNT(*) AS DOUBLE) AS n FROM cases GROUP BY ALL)",
    """steps(t, b) AS (SELECT 0, [0.0::DOUBLE, 0.0, 0.0, -1.0, 0.0, 1.0]
        UNION ALL SELECT t + 1, list_transform(b, lambda v, i: v + CASE WHEN i = t % 6 + 1 THEN step ELSE 0 END) FROM (
            SELECT t, b, SUM(n * (rise * w1 - fall * w0)) / -SUM(n * ((rise * (1 - 2 * high) - rise * rise) * w1 * w1 + 2 * rise * fall * w1 * w0 - (fall * (1 - 2 * low) + fall * fall) * w0 * w0)) AS step
            FROM (SELECT *, high * (1 - high) / (high - low) AS rise, low * (1 - low) / (high - low) AS fall FROM (
                SELECT t, b, n, CASE WHEN t % 6 < 3 THEN -x[t % 6 + 1] WHEN y = t % 6 - 3 THEN 1 ELSE 0 END AS w1, CASE WHEN t % 6 < 3 THEN -x[t % 6 + 1] WHEN y = t % 6 - 2 THEN 1 ELSE 0 END AS w0,
                    CASE WHEN y = 3 THEN 1 ELSE 1 / (1 + exp(list_dot_product(b[1:3], x) - b[4 + y])) END AS high, CASE WHEN y = 0 THEN 0 ELSE 1 / (1 + exp(list_dot_product(b[1:3], x) - b[3 + y])) END AS low
                FROM steps, cells)) GROUP BY t, b) WHERE t < 720)""",
)
SEVERITY_TERMS = ["respondents", "thirds", "years"]


def _severities(s, d):
    parties = table(s, d, "v_case_party").groupBy("case_id").agg(F.count_if(F.col("role") == "respondent").alias("respondents"), F.count_if(F.col("role") == "third_party").alias("thirds"))
    level = F.when(F.col("severity") == 1, 0).otherwise(F.col("severity") - 2)
    rows = table(s, d, "v_case").filter("severity is not null").join(parties, "case_id", "left").fillna(0, ["respondents", "thirds"])
    return newton.stored(rows.select("case_id", level.alias("y"), "respondents", "thirds", (F.col("year") - 1995).alias("years")), "severities")


@recursive
@query("SELECT ['respondents', 'thirds', 'years', '0|1', '1|2', '2|3'][k] AS term, ROUND(b[k], 4) AS estimate FROM steps, range(1, 7) r(k) WHERE t = 720", CASES, *_ORDERED)
def mod02_ordered_logit(s, d):
    """Severity of cases by numbers of parties and year, with its thresholds."""
    fit = newton.ordered_logit(_severities(s, d), "y", SEVERITY_TERMS, 4)
    return s.createDataFrame([(t, float(b)) for t, b in zip(fit.names, fit.params[0])], "term string, estimate double").withColumn("estimate", F.round("estimate", 4))


@query()
def mod03_brant_test(s, d):
    """Whether the slopes of that model are the same for all thresholds."""
    found = newton.brant_test(_severities(s, d), "y", SEVERITY_TERMS, 4)
    return s.createDataFrame([(t, float(x), int(df), float(p)) for t, x, df, p in found], "term string, chi_square double, df int, p double")


#: Orders as spells from a fixed day, in quarters, with an event if filled, by priority.
SPELLS = """spells AS (SELECT o_orderpriority AS stratum, o_custkey AS customer, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 90 AS INT) AS tm, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS e,
    [CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0.0 END, CAST(o_custkey % 5 AS DOUBLE)] AS x FROM orders),
    cells AS MATERIALIZED (SELECT stratum, tm, x, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(e) AS DOUBLE) AS d FROM spells GROUP BY ALL)"""


def _risk_sql(source: str, k: str, l: str) -> str:  # noqa: E741
    """t, b, k, l and for each turn of tied events: gap (of the k-th terms from their mean) and spread (k by l)."""
    run = "OVER (PARTITION BY t, kk, ll, stratum ORDER BY tm DESC)"
    return f"""SELECT t, b, kk, ll, dx / d - (r1 - f * e1) / phi AS gap, (r2 - f * e2) / phi - (r1 - f * e1) / phi * (rl - f * el) / phi AS spread
        FROM (SELECT *, r0 - f * e0 AS phi FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) / d AS f FROM (
            SELECT *, SUM(s0) {run} AS r0, SUM(s1) {run} AS r1, SUM(sl) {run} AS rl, SUM(s2) {run} AS r2 FROM (
                SELECT t, b, kk, ll, stratum, tm, SUM(d) AS d, SUM(d * xk) AS dx, SUM(n * w) AS s0, SUM(n * w * xk) AS s1, SUM(n * w * xl) AS sl, SUM(n * w * xk * xl) AS s2, SUM(d * w) AS e0, SUM(d * w * xk) AS e1, SUM(d * w * xl) AS el, SUM(d * w * xk * xl) AS e2
                FROM (SELECT t, b, {k} AS kk, {l} AS ll, stratum, tm, n, d, exp(list_dot_product(b, x)) AS w, x[{k}] AS xk, x[{l}] AS xl FROM {source}) GROUP BY ALL)) WHERE d > 0))"""


_COX = (
    SPELLS,
    f"""steps(t, b) AS (SELECT 0, [0.0::DOUBLE, 0.0] UNION ALL SELECT t + 1, list_transform(b, lambda v, i: v + CASE WHEN i = t % 2 + 1 THEN step ELSE 0 END)
        FROM (SELECT t, b, SUM(gap) / SUM(spread) AS step FROM ({_risk_sql("steps, cells WHERE t < 40", "t % 2 + 1", "t % 2 + 1")}) GROUP BY t, b))""",
    f"""info AS (SELECT kk, ll, SUM(spread) AS v FROM ({_risk_sql("(SELECT * FROM steps WHERE t = 40), cells, range(1, 3) a(k1), range(1, 3) c(l1)", "k1", "l1")}) GROUP BY ALL),
    det AS (SELECT list(v ORDER BY kk, ll) AS v FROM info)""",
)


def _spells(s, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    rows = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("stratum"), F.col("o_custkey").alias("customer"), F.floor(days / 90).cast("int").alias("tm"), (F.col("o_orderstatus") == "F").cast("int").alias("e"),
        (F.col("o_totalprice") > 150000).cast("double").alias("heavy"), (F.col("o_custkey") % 5).cast("double").alias("rank"),
    )
    return newton.stored(rows, "spells")


@recursive
@query("SELECT ['heavy', 'rank'][k] AS term, ROUND(b[k], 5) AS estimate, ROUND(sqrt(CASE k WHEN 1 THEN v[4] ELSE v[1] END / (v[1] * v[4] - v[2] * v[3])), 5) AS std_error FROM steps, det, range(1, 3) r(k) WHERE t = 40", *_COX)
def mod06_cox(s, d):
    """Hazards of orders being filled, stratified by priority, with tied times by Efron's rule."""
    fit = survival.cox(_spells(s, d), "tm", "e", ["heavy", "rank"], "stratum")
    error = np.sqrt(np.diag(np.linalg.inv(fit.information[0])))
    found = s.createDataFrame([(t, float(b), float(x)) for t, b, x in zip(fit.names, fit.params[0], error)], "term string, estimate double, std_error double")
    return found.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@query()
def mod06_cox_clusters(s, d):
    """That model with errors clustered by customer."""
    rows, terms = _spells(s, d), ["heavy", "rank"]
    fit = survival.cox(rows, "tm", "e", terms, "stratum")
    error = np.sqrt(np.diag(survival.cox_cluster_covariance(fit, rows, "tm", "e", terms, "stratum", "customer")))
    return s.createDataFrame([(t, float(b), float(x)) for t, b, x in zip(terms, fit.params[0], error)], "term string, estimate double, cluster_error double")


#: Signed ties of severe cases: a case of severity 5 between complainant and respondent makes a pair enemies, else one
#: between complainant and third party friends.
SIGNED_TIES = "signed AS (SELECT year, least(a, b) AS x, greatest(a, b) AS y, MIN(CASE relation WHEN 'C-TP' THEN 1 ELSE -1 END) AS sign FROM scored WHERE a <> b AND severity = 5 AND relation <> 'TP-R' GROUP BY ALL)"
#: The statistics' changes by counting what each third node adds, a pair's own tie left out wherever it would count.
SIGNED_FEATURES = """w AS (SELECT year, x AS a, y AS b, sign FROM signed UNION ALL SELECT year, y, x, sign FROM signed),
    shared AS (SELECT p.year, p.a, q.a AS b, COUNT(*) FILTER (p.sign = 1) AS f, COUNT(*) FILTER (p.sign = -1) AS e FROM w p JOIN w q ON p.year = q.year AND p.b = q.b AND p.sign = q.sign AND p.a <> q.a GROUP BY ALL),
    wedge AS (SELECT p.year, p.a, q.b, q.sign AS far, COALESCE(s.f, 0) AS f, COALESCE(s.e, 0) AS e FROM w p JOIN w q ON p.year = q.year AND p.b = q.a AND q.b <> p.a AND p.sign = 1 LEFT JOIN shared s ON s.year = p.year AND s.a = p.a AND s.b = p.b),
    grid AS (SELECT m.year, m.code AS x, n.code AS y, COALESCE(g.sign, 0) AS sign FROM v_node m JOIN v_node n ON m.year = n.year AND m.code < n.code LEFT JOIN signed g ON g.year = m.year AND g.x = m.code AND g.y = n.code),
    changes AS (SELECT grid.*, r,
        (SELECT SUM(power(r, c)) FROM (SELECT COUNT(*) FILTER (w.sign = 1 AND w.b <> CASE v WHEN grid.x THEN grid.y ELSE grid.x END) AS c FROM (VALUES (grid.x), (grid.y)) t(v) LEFT JOIN w ON w.year = grid.year AND w.a = v GROUP BY v)) AS pos_degree,
        (SELECT SUM(power(r, c)) FROM (SELECT COUNT(*) FILTER (w.sign = -1 AND w.b <> CASE v WHEN grid.x THEN grid.y ELSE grid.x END) AS c FROM (VALUES (grid.x), (grid.y)) t(v) LEFT JOIN w ON w.year = grid.year AND w.a = v GROUP BY v)) AS neg_degree,
        exp(0.5::DOUBLE) * (1 - power(r, COALESCE(s.f, 0))) + COALESCE(k.pf, 0) AS pos_friends, exp(0.5::DOUBLE) * (1 - power(r, COALESCE(s.e, 0))) AS pos_enemies, COALESCE(k.ne, 0) AS neg_enemies
        FROM grid CROSS JOIN (SELECT 1 - exp(-0.5::DOUBLE) AS r) LEFT JOIN shared s ON s.year = grid.year AND s.a = grid.x AND s.b = grid.y LEFT JOIN (
            SELECT grid.year, grid.x, grid.y, SUM(CASE WHEN far = 1 THEN power(1 - exp(-0.5::DOUBLE), f - CAST(grid.sign = 1 AS INT)) END) AS pf, SUM(CASE WHEN far = -1 THEN power(1 - exp(-0.5::DOUBLE), e - CAST(grid.sign = -1 AS INT)) END) AS ne
            FROM grid JOIN wedge ON wedge.year = grid.year AND least(a, b) = x AND greatest(a, b) = y GROUP BY ALL) k ON k.year = grid.year AND k.x = grid.x AND k.y = grid.y)"""
_FIGURES = ("pos_degree", "neg_degree", "pos_friends", "pos_enemies", "neg_enemies")


def _signed_changes(s, d):
    rows = _scored(s, d).filter("a <> b AND severity = 5 AND relation <> 'TP-R'")
    sign = F.when(F.col("relation") == "C-TP", 1).otherwise(-1)
    signed = rows.groupBy("year", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(sign).alias("sign"))
    return network.signed_changes(newton.stored(signed, "signed"), table(s, d, "v_node").select("year", F.col("code").alias("v")))


@query(f"SELECT year, x, y, sign, {', '.join(f'ROUND({c}, 6) AS {c}' for c in _FIGURES)} FROM changes", ROLES, SIGNED_TIES, SIGNED_FEATURES)
def grf22_signed_changes(s, d):
    """Changes of the signed network's weighted degrees, shared friends and shared enemies with every pair's tie."""
    return _signed_changes(s, d).select("year", "x", "y", "sign", *(F.round(c, 6).alias(c) for c in _FIGURES))


SIGNED_TERMS = ["pos_edges", "neg_edges", "pos_degree", "neg_degree", "shared_friends", "shared_enemies", "pos_ally", "neg_ally"]
_CHOICE_SQL = (
    """rows_ AS MATERIALIZED (SELECT CASE sign WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS y, [1.0::DOUBLE, 0, pos_degree, 0, pos_friends, pos_enemies, COALESCE(atopally, 0), 0] AS f1, [0::DOUBLE, 1, 0, neg_degree, 0, neg_enemies, 0, COALESCE(atopally, 0)] AS f2
        FROM changes LEFT JOIN v_ally ON v_ally.year = changes.year AND v_ally.a = changes.x AND v_ally.b = changes.y)""",
    """steps(t, b) AS (SELECT 0, list_transform(range(8), lambda i: 0.0::DOUBLE)
        UNION ALL SELECT t + 1, list_transform(b, lambda v, i: v + CASE WHEN i = t % 8 + 1 THEN step ELSE 0 END) FROM (
            SELECT t, b, SUM(CASE y WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE 0 END - p1 * x1 - p2 * x2) / SUM(p1 * x1 * x1 + p2 * x2 * x2 - (p1 * x1 + p2 * x2) * (p1 * x1 + p2 * x2)) AS step
            FROM (SELECT t, b, y, f1[t % 8 + 1] AS x1, f2[t % 8 + 1] AS x2, e1 / (1 + e1 + e2) AS p1, e2 / (1 + e1 + e2) AS p2
                FROM (SELECT t, b, y, f1, f2, exp(list_dot_product(b, f1)) AS e1, exp(list_dot_product(b, f2)) AS e2 FROM steps, rows_)) GROUP BY t, b) WHERE t < 2400)""",
)


@recursive
@query("SELECT [" + ", ".join(f"'{t}'" for t in SIGNED_TERMS) + "][k] AS term, ROUND(b[k], 3) AS estimate FROM steps, range(1, 9) r(k) WHERE t = 2400", ROLES, SIGNED_TIES, SIGNED_FEATURES, *_CHOICE_SQL)
def mod12_signed_ties(s, d):
    """Pseudo-likelihood of the signed networks, years pooled, with balance terms; NaN where it has no finite maximum, as
    when every pair has a tie."""
    ally = table(s, d, "v_ally").select("year", F.col("a").alias("x"), F.col("b").alias("y"), F.col("atopally").alias("ally"))
    rows = _signed_changes(s, d).join(ally, ["year", "x", "y"], "left").fillna(0, ["ally"]).withColumns({"one": F.lit(1.0), "chosen": F.when(F.col("sign") == -1, 2).otherwise(F.col("sign"))})
    positive, negative = ["one", None, "pos_degree", None, "pos_friends", "pos_enemies", "ally", None], [None, "one", None, "neg_degree", None, "neg_enemies", None, "ally"]
    fit = newton.choice_logit(newton.stored(rows, "signed-changes"), "chosen", SIGNED_TERMS, [positive, negative])
    return s.createDataFrame([(t, float(b)) for t, b in zip(fit.names, fit.estimates[0])], "term string, estimate double").withColumn("estimate", F.round("estimate", 3))


#: How often documents have two letters and a point, in logarithms; how long they are is behind all three.
SIZES = """sizes AS (SELECT ln(1 + length(text) - length(replace(text, 'e', ''))) AS e, ln(1 + length(text) - length(replace(text, 'n', ''))) AS n, ln(1 + length(text) - length(replace(text, '.', ''))) AS stops FROM documents),
    r AS (SELECT corr(e, n) AS en, corr(e, stops) AS es, corr(n, stops) AS ns FROM sizes)"""


@query(f", {SIZES} SELECT x.name AS variable, ROUND(sqrt(x.v), 4) AS loading, ROUND(1 - x.v, 4) AS uniqueness FROM (SELECT unnest([{{'name': 'e', 'v': en * es / ns}}, {{'name': 'n', 'v': en * ns / es}}, {{'name': 'stops', 'v': es * ns / en}}]) AS x FROM r)")
def mod01_one_factor(s, d):
    """Loadings of three counts on one factor; the SQL has the closed form of three variables."""
    count = lambda c: F.log(1.0 + F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))))
    names = ["e", "n", "stops"]
    sizes = newton.stored(table(s, d, "documents").select(count("e").alias("e"), count("n").alias("n"), count(".").alias("stops")), "sizes")
    load, unique = newton.factor_analysis(newton.correlation(sizes, names))
    found = s.createDataFrame([(n, float(a), float(u)) for n, a, u in zip(names, load[:, 0], unique)], "variable string, loading double, uniqueness double")
    return found.select("variable", F.round("loading", 4).alias("loading"), F.round("uniqueness", 4).alias("uniqueness"))


@recursive
@query(
    """SELECT ally, point, ROUND(trade, 6) AS trade, ROUND(1 / (1 + exp(-eta)), 5) AS probability, ROUND(1 / (1 + exp(1.96 * error - eta)), 5) AS low, ROUND(1 / (1 + exp(-1.96 * error - eta)), 5) AS high FROM (
       SELECT ally, point, trade, list_dot_product(b, x) AS eta, sqrt(list_dot_product(list_transform(v, lambda r: list_dot_product(r, x)), x)) AS error FROM beta, sandwich, (
         SELECT ally, point, trade, [1.0::DOUBLE, ally, trade, ally * trade, 0, 0, 0, 0, 0, 0] AS x FROM (SELECT CAST(a AS INT) AS ally, CAST(k AS INT) AS point, low + (high - low) * k / 199 AS trade
           FROM (SELECT MIN(trade) AS low, MAX(trade) AS high FROM panel), range(2) q(a), range(200) p(k))))""",
    ROLES,
    DYADS,
    PANEL,
    *LOGIT_SQL,
)
def mod09_marginal_effects(s, d):
    """Probability of a dispute along trade, for allies and others, in the first year, with 95 % intervals of the linear
    predictor by the delta method and the clustered covariance."""
    fit, covariance = _panel_fit(s, d)
    low, high = _panel(s, d).agg(F.min("trade"), F.max("trade")).first()
    trade = low + (high - low) * np.arange(200) / 199
    rows = []
    for ally in (0, 1):
        x = np.zeros((200, len(fit.names)))
        x[:, 0], x[:, 1], x[:, 2], x[:, 3] = 1, ally, trade, ally * trade
        eta, error = x @ fit.estimates[0], np.sqrt(((x @ covariance) * x).sum(axis=1))
        bounds = [newton.logistic(eta + k * error) for k in (0, -1.96, 1.96)]
        rows += [(ally, k, float(trade[k]), *(float(b[k]) for b in bounds)) for k in range(200)]
    found = s.createDataFrame(rows, "ally int, point int, trade double, probability double, low double, high double")
    return found.select("ally", "point", F.round("trade", 6).alias("trade"), *(F.round(c, 5).alias(c) for c in ("probability", "low", "high")))


@query(
    """, t AS (SELECT d.year, CAST(floor(ln(exports) * 10) AS INT) AS score, CAST(EXISTS (SELECT 1 FROM scored s WHERE s.relation = 'C-R' AND s.severity >= 4 AND s.year = d.year AND s.a = d.i AND s.b = d.j) AS INT) AS y FROM dyads d),
       at_ AS (SELECT year, score, SUM(y) AS p, SUM(1 - y) AS q FROM t GROUP BY ALL), total AS (SELECT year, SUM(p) AS pa, SUM(q) AS qa FROM at_ GROUP BY year),
       pts AS (SELECT a.year, a.score, pa, qa, (SELECT SUM(p) FROM at_ b WHERE b.year = a.year AND b.score >= a.score) AS tp, (SELECT SUM(q) FROM at_ b WHERE b.year = a.year AND b.score >= a.score) AS fp FROM at_ a JOIN total USING (year)),
       areas AS (SELECT x.year, SUM(CASE WHEN x.score > z.score THEN x.p * z.q WHEN x.score = z.score THEN x.p * z.q / 2 ELSE 0 END) AS wins FROM at_ x JOIN at_ z ON x.year = z.year GROUP BY x.year),
       ap AS (SELECT at_.year, SUM(at_.p / pa * tp / (tp + fp)) AS ap FROM at_ JOIN pts USING (year, score) GROUP BY at_.year)
       SELECT year, score, ROUND(tp / NULLIF(pa, 0), 6) AS tpr, ROUND(fp / NULLIF(qa, 0), 6) AS fpr, ROUND(tp / (tp + fp), 6) AS precision, ROUND(wins / NULLIF(pa * qa, 0), 6) AS auc, ROUND(ap, 6) AS ap FROM pts JOIN areas USING (year) JOIN ap USING (year)""",
    ROLES,
    DYADS,
)
def grf15_roc(s, d):
    """How well trade tells disputes, year by year: the points and areas of the receiver and precision-recall curves."""
    arcs = _scored(s, d).filter("relation = 'C-R' AND severity >= 4").select("year", F.col("a").alias("i"), F.col("b").alias("j")).distinct().withColumn("y", F.lit(1))
    rows = _dyads(s, d).select("year", "i", "j", F.floor(F.log("exports") * 10).cast("int").alias("score")).join(arcs, ["year", "i", "j"], "left").fillna(0, ["y"])
    return stats.roc_points(rows, "year", "score", "y")
