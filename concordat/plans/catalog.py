"""Registered queries over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import disputes, documents, frames, index, network, retrieval, stats, trade
from concordat.sources.files import workspace
from concordat.sources.views import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fragments of oracles.
DYADS = "dyads AS (SELECT year, i, j, CAST(SUM(v) AS DOUBLE) AS exports, COUNT(DISTINCT k) AS n_products, COUNT(DISTINCT section) AS n_sections FROM v_flow WHERE i <> j GROUP BY ALL)"
SECTIONS = "sections AS (SELECT year, i, j, section, CAST(SUM(v) AS DOUBLE) AS exports FROM v_flow WHERE i <> j GROUP BY ALL)"
MEMBERS = "member_years AS (SELECT code, year FROM (SELECT DISTINCT year FROM v_flow) JOIN v_bloc_member ON year BETWEEN acc_year AND COALESCE(exit_year, 9999))"
ROLES = """roles AS (
    SELECT x.case_id, x.party AS a, y.party AS b, r.relation
    FROM (VALUES ('C-R', 'complainant', 'respondent'), ('TP-R', 'third_party', 'respondent'), ('C-TP', 'complainant', 'third_party')) r(relation, one, two)
    JOIN v_case_party x ON x.role = r.one JOIN v_case_party y ON y.role = r.two AND y.case_id = x.case_id),
scored AS (
    SELECT roles.*, year, severity, CASE relation WHEN 'C-R' THEN CAST(severity AS DOUBLE) WHEN 'TP-R' THEN 0.5 ELSE 0.0 END AS score
    FROM roles JOIN v_case USING (case_id))"""
SIGNED = ROLES + ", signed AS (SELECT year, least(a, b) AS x, greatest(a, b) AS y, MIN(CASE relation WHEN 'C-TP' THEN 1 ELSE -1 END) AS sign FROM scored WHERE a <> b GROUP BY ALL)"


def query(sql: str | None = None, *parts: str):
    """Register a function under its name; sql runs after the views and the given common table expressions."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            head = "".join(f", {p}" for p in parts)
            ORACLES[f.__name__] = oracle("").rstrip() + head + (sql if sql.startswith(",") else " " + sql)
        return f

    return add


def _dyads(s, d):
    return trade.dyad_year(table(s, d, "v_flow"))


def _years(s, d):
    return table(s, d, "v_flow").select("year").distinct()


def _member_years(s, d):
    return trade.members_by_year(table(s, d, "v_bloc_member"), _years(s, d))


def _scored(s, d):
    return disputes.with_cases(disputes.role_dyads(table(s, d, "v_case_party")), table(s, d, "v_case"))


@query("SELECT * FROM dyads", DYADS)
def agg01_dyad_year_trade(s, d):
    return _dyads(s, d)


@query(
    """SELECT year, i, j, section, ROUND(CAST(v AS DOUBLE) / SUM(v) OVER (PARTITION BY year, i, section)::DOUBLE, 6) AS partner_share,
       ROUND(CAST(v AS DOUBLE) / SUM(v) OVER (PARTITION BY year, i)::DOUBLE, 6) AS sector_dependence,
       ROUND(CAST(v AS DOUBLE) / SUM(v) OVER (PARTITION BY year, i, j)::DOUBLE, 6) AS bilateral_concentration
       FROM (SELECT year, i, j, section, SUM(v) AS v FROM v_flow WHERE i <> j GROUP BY ALL)"""
)
def agg16_dependence_indices(s, d):
    return trade.dependence(table(s, d, "v_flow"))


@query("SELECT a.year, a.i, a.j, a.exports, COALESCE(b.exports, 0.0) AS imports FROM dyads a LEFT JOIN dyads b ON a.year = b.year AND a.i = b.j AND a.j = b.i", DYADS)
def jon06_reverse_flow(s, d):
    return trade.with_reverse(_dyads(s, d).select("year", "i", "j", "exports"), "exports", "imports")


@query(
    """SELECT year, i, j, exports, imports, ROUND(exports / SUM(exports) OVER w, 4) AS export_dependence,
       CASE WHEN SUM(imports) OVER w > 0 THEN ROUND(imports / SUM(imports) OVER w, 4) END AS import_dependence
       FROM (SELECT a.year, a.i, a.j, a.exports, COALESCE(b.exports, 0.0) AS imports FROM dyads a LEFT JOIN dyads b ON a.year = b.year AND a.i = b.j AND a.j = b.i)
       WINDOW w AS (PARTITION BY year, i)""",
    DYADS,
)
def prj06_import_dependence(s, d):
    return trade.import_dependence(_dyads(s, d))


@query("SELECT code, year FROM member_years", MEMBERS)
def jon18_bloc_members_by_year(s, d):
    return _member_years(s, d)


@query(
    """, twice AS (
         SELECT 0 AS rep, year, i, j, k, section, v FROM v_flow UNION ALL
         SELECT 1, f.year, CASE WHEN a.code IS NULL THEN i ELSE 999 END, CASE WHEN b.code IS NULL THEN j ELSE 999 END, k, section, v
         FROM v_flow f LEFT JOIN member_years a ON a.code = i AND a.year = f.year LEFT JOIN member_years b ON b.code = j AND b.year = f.year),
       agg AS (SELECT rep, year, i, j, CAST(SUM(v) AS DOUBLE) AS exports, COUNT(DISTINCT k) AS n_products, COUNT(DISTINCT section) AS n_sections FROM twice WHERE i <> j GROUP BY ALL)
       SELECT * FROM (SELECT *, ROUND(exports / SUM(exports) OVER (PARTITION BY rep, year, i), 4) AS export_dependence FROM agg) WHERE rep = 0 OR i = 999 OR j = 999""",
    MEMBERS,
)
def bloc_dual_representation(s, d):
    return trade.dual_representation(table(s, d, "v_flow"), _member_years(s, d))


@query("SELECT d.* FROM dyads d JOIN v_member a ON a.code = i AND d.year >= a.join_year JOIN v_member b ON b.code = j AND d.year >= b.join_year", DYADS)
def flt06_membership_both_ends(s, d):
    return trade.both_members(_dyads(s, d), table(s, d, "v_member"))


@query("SELECT a, b, CAST(year AS INT) AS year, atopally FROM v_ally UNION ALL SELECT a, b, CAST(y AS INT), atopally FROM v_ally, generate_series(2000, 2005) g(y) WHERE year = 1999")
def win05_ally_forward_fill(s, d):
    return trade.forward_filled(table(s, d, "v_ally"), "year", 1999, 2005)


@query(
    """SELECT d.year, i, j, exports, COALESCE(label, 0) AS label, depth_index FROM dyads d
       LEFT JOIN v_pta p ON p.a = least(i, j) AND p.b = greatest(i, j) AND p.year = d.year""",
    DYADS,
)
def jon08_undirected_agreement(s, d):
    return trade.undirected(_dyads(s, d).select("year", "i", "j", "exports"), table(s, d, "v_pta"), {"label": "0", "depth_index": "cast(null as int)"})


@query(
    """SELECT d.year, i, j, CAST(a.gdp AS DOUBLE) AS gdp_1, a.idealpoint AS idealpoint_1, CAST(b.gdp AS DOUBLE) AS gdp_2, b.idealpoint AS idealpoint_2
       FROM dyads d LEFT JOIN v_node a ON a.code = i AND a.year = d.year LEFT JOIN v_node b ON b.code = j AND b.year = d.year""",
    DYADS,
)
def jon10_dual_role_attributes(s, d):
    nodes = table(s, d, "v_node").withColumn("gdp", F.col("gdp").cast("double"))
    return trade.dual_role(_dyads(s, d).select("year", "i", "j"), nodes, ["gdp", "idealpoint"])


LAGGED = DYADS + """, lagged AS (SELECT year, i, j, exports, MAX(exports) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS t1,
    MAX(exports) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS t2, MAX(exports) OVER (w RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS t3
    FROM dyads WINDOW w AS (PARTITION BY i, j ORDER BY year))"""


@query("SELECT * FROM lagged", LAGGED)
def jon09_gap_aware_lags(s, d):
    return _dyads(s, d).select("year", "i", "j", "exports", *(frames.gap_lag("exports", ["i", "j"], "year", k).alias(f"t{k}") for k in (1, 2, 3)))


@query("SELECT year, i, j, exports, t1, CASE WHEN year = 1996 THEN t1 ELSE t2 END AS t2, CASE WHEN year = 1996 THEN t1 WHEN year = 1997 THEN t2 ELSE t3 END AS t3 FROM lagged", LAGGED)
def win07_backward_imputation(s, d):
    return frames.backward_imputed(jon09_gap_aware_lags(s, d), "exports", {1: "t1", 2: "t2", 3: "t3"}, "year", 1995)


@query("SELECT year, i, j, ROUND(SUM(share * share), 6) AS hhi FROM (SELECT *, exports / SUM(exports) OVER (PARTITION BY year, i, j) AS share FROM sections) GROUP BY ALL", SECTIONS)
def agg15_section_hhi(s, d):
    return trade.hhi(table(s, d, "v_flow"))


@query(
    """SELECT a.year, a.i, a.j, a.top, COALESCE(b.top, 0.0) AS top_reverse FROM tops a LEFT JOIN tops b ON a.year = b.year AND a.i = b.j AND a.j = b.i""",
    SECTIONS + ", tops AS (SELECT year, i, j, MAX(exports) AS top FROM sections GROUP BY ALL)",
)
def jon07_max_reverse_dependence(s, d):
    tops = trade.section_year(table(s, d, "v_flow")).groupBy("year", "i", "j").agg(F.max("exports").alias("top"))
    return trade.with_reverse(tops, "top", "top_reverse")


@query("SELECT * FROM roles", ROLES)
def jon16_role_dyads(s, d):
    return disputes.role_dyads(table(s, d, "v_case_party"))


@query("SELECT * FROM scored", ROLES)
def prj11_role_severity(s, d):
    return _scored(s, d)


@query("SELECT a, b, year, case_id, relation, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b, year ORDER BY score DESC NULLS LAST, case_id, relation) AS n FROM scored) WHERE n = 1", ROLES)
def agg07_most_severe_case(s, d):
    return frames.argmax_row(_scored(s, d), ["a", "b", "year"], [F.col("score").desc_nulls_last(), F.col("case_id"), F.col("relation")]).select("a", "b", "year", "case_id", "relation", "score")


@query(
    """SELECT a, b, year, FIRST(case_id ORDER BY case_id DESC, relation) AS case_id, FIRST(severity ORDER BY case_id DESC, relation) FILTER (severity IS NOT NULL) AS severity
       FROM scored GROUP BY ALL""",
    ROLES,
)
def agg08_first_non_null(s, d):
    return frames.first_non_null(_scored(s, d), ["a", "b", "year"], [F.col("case_id").desc(), F.col("relation")], ["case_id", "severity"])


@query(
    """SELECT case_id, a, b, w.year, way, lag, ROUND(SUM(exports), 2) AS total, ROUND(AVG(exports), 6) AS mean
       FROM (SELECT DISTINCT case_id, a, b, year, section, CAST(lag AS INT) AS lag, way, CASE way WHEN 'out' THEN a ELSE b END AS i, CASE way WHEN 'out' THEN b ELSE a END AS j
             FROM scored JOIN v_case_section USING (case_id), generate_series(0, 3) l(lag), (VALUES ('out'), ('back')) x(way)) w
       LEFT JOIN sections f ON f.i = w.i AND f.j = w.j AND f.section = w.section AND f.year = w.year - lag GROUP BY ALL""",
    ROLES,
    SECTIONS,
)
def jon15_disputed_section_trade(s, d):
    return disputes.disputed_trade(_scored(s, d), table(s, d, "v_case_section"), trade.section_year(table(s, d, "v_flow")))


@query("SELECT case_id, " + ", ".join(f"MAX(CASE WHEN section = t{k} THEN 1 ELSE 0 END) AS s{k}" for k in range(1, 7)) + " FROM v_case_section, (SELECT " + ", ".join(f"MAX(CASE WHEN n = {k} THEN p_type END) AS t{k}" for k in range(1, 7)) + " FROM (SELECT p_type, ROW_NUMBER() OVER (ORDER BY p_type) AS n FROM (SELECT DISTINCT p_type FROM part))) GROUP BY case_id")
def prj26_section_dummies(s, d):
    names = table(s, d, "part").select("p_type").distinct().agg(F.array_sort(F.collect_set("p_type")).alias("names"))
    lists = table(s, d, "v_case_section").groupBy("case_id").agg(F.collect_set("section").alias("sections"))
    return lists.join(F.broadcast(names)).select("case_id", *(F.coalesce(F.array_contains("sections", F.get("names", F.lit(k - 1))), F.lit(False)).cast("int").alias(f"s{k}") for k in range(1, 7)))


@query(
    """, keys AS (SELECT DISTINCT year, a AS i, b AS j FROM scored)
       SELECT d.year, d.i, d.j, d.exports, CASE WHEN k.i IS NULL THEN 0 ELSE 1 END AS has_dispute FROM dyads d LEFT JOIN keys k ON k.year = d.year AND k.i = d.i AND k.j = d.j
       UNION ALL SELECT k.year, k.i, k.j, NULL, 1 FROM keys k ANTI JOIN dyads d ON k.year = d.year AND k.i = d.i AND k.j = d.j""",
    DYADS,
    ROLES,
)
def jon13_append_missing_disputes(s, d):
    return disputes.append_missing(_dyads(s, d).select("year", "i", "j", "exports"), _scored(s, d).select("year", F.col("a").alias("i"), F.col("b").alias("j")))


ANNUAL = "annual AS (SELECT party, year, " + ", ".join(f"COUNT(DISTINCT CASE WHEN role = '{r}' THEN case_id END) AS n_{r}" for r in ("complainant", "respondent", "third_party")) + " FROM v_case_party JOIN v_case USING (case_id) GROUP BY ALL)"


@query("SELECT * FROM annual", ANNUAL)
def jon04_annual_role_counts(s, d):
    return disputes.annual_roles(table(s, d, "v_case_party"), table(s, d, "v_case"))


@query(
    """SELECT a, b, CAST(year + 1 AS INT) AS year, CAST(SUM(n) OVER (PARTITION BY a, b ORDER BY year) AS BIGINT) AS cum_tp, 1 AS tp_before
       FROM (SELECT a, b, year, COUNT(DISTINCT case_id) AS n FROM scored WHERE relation = 'TP-R' GROUP BY ALL)""",
    ROLES,
)
def win03_tp_history_covariate(s, d):
    return disputes.third_party_history(_scored(s, d))


@query(
    """SELECT party, year, CAST(SUM(c) OVER w AS BIGINT) AS cum_complainant, CAST(SUM(r) OVER w AS BIGINT) AS cum_respondent, CAST(SUM(t) OVER w AS BIGINT) AS cum_third_party,
              MAX(CASE WHEN c + r + t > 0 THEN 1 ELSE 0 END) OVER w AS ever_participant
       FROM (SELECT n.code AS party, n.year, COALESCE(n_complainant, 0) AS c, COALESCE(n_respondent, 0) AS r, COALESCE(n_third_party, 0) AS t
             FROM v_node n LEFT JOIN annual a ON a.party = n.code AND a.year = n.year) WINDOW w AS (PARTITION BY party ORDER BY year)""",
    ANNUAL,
)
def win01_cumulative_roles(s, d):
    return disputes.cumulative_roles(jon04_annual_role_counts(s, d), table(s, d, "v_node").select(F.col("code").alias("party"), "year"))


@query(
    """SELECT code, year, COALESCE(LAST_VALUE(idealpoint IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       FIRST_VALUE(idealpoint IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS idealpoint FROM v_node WINDOW w AS (PARTITION BY code ORDER BY year)"""
)
def win04_locf_nocb(s, d):
    return table(s, d, "v_node").select("code", "year", frames.locf_nocb("idealpoint", ["code"], "year").alias("idealpoint"))


@query(
    """SELECT code, year, CASE WHEN idealpoint IS NULL AND year = 1995 THEN MAX(idealpoint) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) WHEN idealpoint IS NULL AND year IN (1997, 1999, 2001) THEN ROUND((MAX(idealpoint) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)
       + MAX(idealpoint) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)) / 2, 6) ELSE idealpoint END AS idealpoint FROM v_node WINDOW w AS (PARTITION BY code ORDER BY year)"""
)
def win06_interpolate(s, d):
    near = lambda k: frames.gap_lag("idealpoint", ["code"], "year", k)
    mean = F.round((near(1) + near(-1)) / 2, 6)
    return table(s, d, "v_node").select("code", "year", F.when(F.col("idealpoint").isNull() & (F.col("year") == 1995), near(-1)).when(F.col("idealpoint").isNull() & F.col("year").isin(1997, 1999, 2001), mean).otherwise(F.col("idealpoint")).alias("idealpoint"))


def _bloc_nodes(s, d):
    return table(s, d, "v_node").join(F.broadcast(_member_years(s, d)), ["code", "year"])


def _weighted(weight):
    return f"""SELECT year, ROUND(SUM(CASE WHEN idealpoint IS NOT NULL AND {weight} IS NOT NULL THEN idealpoint * CAST({weight} AS DOUBLE) END)
        / CAST(SUM(CASE WHEN idealpoint IS NOT NULL THEN {weight} END) AS DOUBLE), 6) AS idealpoint FROM v_node JOIN member_years USING (code, year) GROUP BY year"""


@query(_weighted("gdp"), MEMBERS)
def agg12_gdp_weighted_bloc(s, d):
    return _bloc_nodes(s, d).groupBy("year").agg(frames.weighted_mean("idealpoint", "gdp").alias("idealpoint"))


@query(
    """, m AS (SELECT code, year, idealpoint, CASE WHEN code % 4 = 1 THEN NULL ELSE CAST(pop AS DOUBLE) END AS pop FROM v_node JOIN member_years USING (code, year)),
       w AS (SELECT *, COALESCE(pop, MEDIAN(pop) OVER (PARTITION BY year)) AS weight FROM m)
       SELECT year, ROUND(SUM(CASE WHEN idealpoint IS NOT NULL THEN idealpoint * weight END) / SUM(CASE WHEN idealpoint IS NOT NULL THEN weight END), 6) AS idealpoint FROM w GROUP BY year""",
    MEMBERS,
)
def agg13_pop_weighted_bloc(s, d):
    """A missing weight is the median of the year's known weights; weights are renormalised over known values."""
    nodes = _bloc_nodes(s, d).withColumn("pop", F.when(F.col("code") % 4 != 1, F.col("pop").cast("double")))
    median = F.broadcast(nodes.groupBy("year").agg(F.median("pop").alias("median")))
    filled = nodes.join(median, "year").withColumn("weight", F.coalesce("pop", "median"))
    return filled.groupBy("year").agg(frames.weighted_mean("idealpoint", "weight").alias("idealpoint"))


@query("SELECT code, year, idealpoint FROM v_node WHERE code NOT IN (SELECT code FROM v_node WHERE gdp IS NULL)")
def flt10_complete_entities(s, d):
    return frames.complete_entities(table(s, d, "v_node"), "code", ["gdp"]).select("code", "year", "idealpoint")


@query(
    """SELECT 999 AS bloc, b AS partner, year, label, depth_index, a AS from_member FROM (
         SELECT w.*, ROW_NUMBER() OVER (PARTITION BY b, year ORDER BY depth_index DESC NULLS LAST, label DESC, a) AS n
         FROM (SELECT year, a, b, label, depth_index FROM v_pta UNION ALL SELECT year, b, a, label, depth_index FROM v_pta) w
         WHERE label = 1 AND a IN (SELECT code FROM member_years)) WHERE n = 1""",
    MEMBERS,
)
def jon26_bloc_agreement_inheritance(s, d):
    return trade.inherited_agreements(table(s, d, "v_pta"), _member_years(s, d))


BLOC_ROLES = """bloc_roles AS (SELECT case_id, CASE WHEN a IN (SELECT code FROM v_bloc_member) THEN 999 ELSE a END AS a,
    CASE WHEN b IN (SELECT code FROM v_bloc_member) THEN 999 ELSE b END AS b, relation, year FROM scored)"""


@query(
    """, one AS (SELECT case_id, CASE WHEN a = 999 THEN m.code ELSE a END AS a, b, relation, r.year, CASE WHEN a = 999 THEN 1 ELSE 0 END AS a_from_bloc FROM bloc_roles r LEFT JOIN member_years m ON a = 999 AND m.year = r.year)
       SELECT case_id, a, CASE WHEN b = 999 THEN m.code ELSE b END AS b, relation, o.year, a_from_bloc, CASE WHEN b = 999 THEN 1 ELSE 0 END AS b_from_bloc FROM one o LEFT JOIN member_years m ON b = 999 AND m.year = o.year
       WHERE a IS NOT NULL AND (b <> 999 OR m.code IS NOT NULL)""",
    ROLES,
    BLOC_ROLES,
    MEMBERS,
)
def jon19_bloc_disaggregation(s, d):
    members, rows = table(s, d, "v_bloc_member").select("code").distinct(), _scored(s, d)
    for end in ("a", "b"):
        rows = rows.join(members.select(F.col("code").alias(f"member_{end}")), F.col(end) == F.col(f"member_{end}"), "left")
    bloc = lambda c: F.when(F.col(f"member_{c}").isNotNull(), F.lit(999)).otherwise(F.col(c)).alias(c)
    rows = rows.select("case_id", bloc("a"), bloc("b"), "relation", "year")
    for end in ("a", "b"):
        rows = disputes.disaggregated(rows, _member_years(s, d), 999, end)
    return rows


@query(
    """SELECT case_id, CASE WHEN bool_or(m) AND bool_or(NOT m) THEN 'mixed' WHEN bool_or(m) THEN 'member_only' ELSE 'other_only' END AS kind
       FROM (SELECT case_id, party IN (SELECT code FROM v_bloc_member) AS m FROM v_case_party WHERE role IN ('complainant', 'respondent')) GROUP BY case_id"""
)
def set07_bloc_case_class(s, d):
    return disputes.bloc_classes(table(s, d, "v_case_party"), table(s, d, "v_bloc_member"))


@query(
    """SELECT doc_id, source, CASE WHEN STDDEV_SAMP(quality) OVER w > 0 THEN ROUND((quality - AVG(quality) OVER w) / STDDEV_SAMP(quality) OVER w, 6) ELSE 0.0 END AS z
       FROM labels JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY source)"""
)
def agg17_group_zscore(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return frames.with_zscore(rows, "quality", ["source"], "z").select("doc_id", "source", "z")


@query("SELECT year, x, y, sign FROM signed", SIGNED)
def agg10_signed_edges(s, d):
    return network.signed_edges(_scored(s, d))


@query("SELECT year, least(i, j) AS x, greatest(i, j) AS y, MAX(exports) AS exports FROM dyads GROUP BY ALL", DYADS)
def agg11_symmetrised_max(s, d):
    return network.node_covariates(_dyads(s, d), "exports")


@query("SELECT year, COUNT(*) FILTER (relation = 'C-R') AS n_c_r, COUNT(*) FILTER (relation = 'TP-R') AS n_tp_r, COUNT(*) FILTER (relation = 'C-TP') AS n_c_tp, COUNT(*) AS n_edges FROM scored GROUP BY year", ROLES)
def grf02_edge_type_counts(s, d):
    return network.edge_counts(_scored(s, d))


@query(
    """SELECT year, n_nodes, CAST(n_edges AS BIGINT) AS n_edges, ROUND(2 * n_edges / (n_nodes::DOUBLE * (n_nodes - 1)), 6) AS density, ROUND(2 * n_edges / n_nodes::DOUBLE, 6) AS avg_degree
       FROM (SELECT year, SUM(m) AS n_edges FROM (SELECT year, MAX(m) AS m FROM (SELECT year, a, b, COUNT(*) AS m FROM scored GROUP BY ALL) GROUP BY year, least(a, b), greatest(a, b)) GROUP BY year)
       JOIN (SELECT year, COUNT(DISTINCT v) AS n_nodes FROM (SELECT year, a AS v FROM scored UNION ALL SELECT year, b FROM scored) GROUP BY year) USING (year)""",
    ROLES,
)
def grf03_density(s, d):
    return network.density(_scored(s, d))


@query("SELECT year, ROUND(COUNT(*) FILTER (relation <> 'C-TP') / COUNT(*)::DOUBLE, 6) AS conflict_density, ROUND(COUNT(*) FILTER (relation = 'C-TP') / COUNT(*)::DOUBLE, 6) AS support_ratio FROM scored GROUP BY year", ROLES)
def grf04_conflict_density(s, d):
    return network.conflict_density(_scored(s, d))


@query(
    """, ends AS (SELECT year, a AS v, relation FROM scored WHERE a <> b UNION ALL SELECT year, b, relation FROM scored WHERE a <> b), n AS (SELECT year, COUNT(DISTINCT v) - 1 AS others FROM ends GROUP BY year)
       SELECT year, v, ROUND(COUNT(*) / others::DOUBLE, 6) AS degree, ROUND(COUNT(*) FILTER (relation <> 'C-R') / others::DOUBLE, 6) AS positive_degree,
              ROUND(COUNT(*) FILTER (relation = 'C-R') / others::DOUBLE, 6) AS negative_degree FROM ends JOIN n USING (year) GROUP BY year, v, others""",
    ROLES,
)
def grf05_signed_degree(s, d):
    """Each edge counts, and a third party's with a respondent is positive here, though it is negative among signs."""
    edges = _scored(s, d).filter("a <> b").select("year", F.col("a").alias("x"), F.col("b").alias("y"), F.when(F.col("relation") == "C-R", -1).otherwise(1).alias("sign"))
    return network.degree_centrality(edges)


@query(
    """SELECT a.year, COUNT(*) FILTER (a.sign * b.sign * c.sign > 0) AS balanced, COUNT(*) FILTER (a.sign * b.sign * c.sign < 0) AS unbalanced
       FROM signed a JOIN signed b ON a.year = b.year AND a.y = b.x JOIN signed c ON c.year = a.year AND c.x = a.x AND c.y = b.y GROUP BY a.year""",
    SIGNED,
)
def grf13_balanced_triangles(s, d):
    return network.triangles(agg10_signed_edges(s, d))


@query(
    "SELECT a.year, ROUND(COUNT(b.a) / COUNT(*)::DOUBLE, 6) AS reciprocity FROM arcs a LEFT JOIN arcs b ON a.year = b.year AND a.a = b.b AND a.b = b.a GROUP BY a.year",
    ROLES,
    "arcs AS (SELECT DISTINCT year, a, b FROM scored WHERE a <> b)",
)
def grf14_reciprocity(s, d):
    return network.reciprocity(_scored(s, d))


def _pairs(s, d):
    return network.undirected_multiplicity(_scored(s, d).filter("a <> b")).select("year", "x", "y", F.col("m").cast("double").alias("w"))


@query()
def grf06_betweenness(s, d):
    return network.betweenness(_pairs(s, d))


@query()
def grf08_louvain(s, d):
    return network.louvain(_pairs(s, d))


@query()
def grf07_eigenvector(s, d):
    return network.eigenvector(_pairs(s, d))


CR_ARCS = "arcs AS (SELECT DISTINCT year, a, b FROM scored WHERE relation = 'C-R' AND a <> b)"
TRIADS = """states AS (
    SELECT n.year, p.code AS p, q.code AS q, r.code AS r, pq.a IS NOT NULL AS pq, qp.a IS NOT NULL AS qp, pr.a IS NOT NULL AS pr, rp.a IS NOT NULL AS rp, qr.a IS NOT NULL AS qr, rq.a IS NOT NULL AS rq
    FROM (SELECT DISTINCT year FROM v_node) n JOIN v_node p ON p.year = n.year JOIN v_node q ON q.year = n.year AND p.code < q.code JOIN v_node r ON r.year = n.year AND q.code < r.code
    """ + " ".join(f"LEFT JOIN arcs {x}{y} ON {x}{y}.year = n.year AND {x}{y}.a = {x}.code AND {x}{y}.b = {y}.code" for x, y in ("pq", "qp", "pr", "rp", "qr", "rq")) + """),
counted AS (
    SELECT year, (pq AND qp)::INT + (pr AND rp)::INT + (qr AND rq)::INT AS m, (pq <> qp)::INT + (pr <> rp)::INT + (qr <> rq)::INT AS a,
           [pq::INT + pr::INT, qp::INT + qr::INT, rp::INT + rq::INT] AS sent, [qp::INT + rp::INT, pq::INT + rq::INT, pr::INT + qr::INT] AS got FROM states),
typed AS (
    SELECT year, concat(m, a, 3 - m - a, CASE
        WHEN m = 0 AND a = 2 THEN CASE WHEN list_max(sent) = 2 THEN 'D' WHEN list_max(got) = 2 THEN 'U' ELSE 'C' END
        WHEN m = 1 AND a = 1 THEN CASE WHEN list_max(got) = 2 THEN 'D' ELSE 'U' END
        WHEN a = 3 THEN CASE WHEN list_max(sent) = 1 THEN 'C' ELSE 'T' END
        WHEN m = 1 AND a = 2 THEN CASE WHEN list_min(got) = 0 THEN 'D' WHEN list_min(sent) = 0 THEN 'U' ELSE 'C' END ELSE '' END) AS triad FROM counted)"""


@query(
    "SELECT y.year, t.triad, COUNT(typed.triad) AS n FROM (SELECT DISTINCT year FROM v_node) y CROSS JOIN (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in network.TRIADS)
    + "]) AS triad) t LEFT JOIN typed ON typed.year = y.year AND typed.triad = t.triad GROUP BY ALL",
    ROLES,
    CR_ARCS,
    TRIADS,
)
def grf15_triad_census(s, d):
    rows = _scored(s, d).filter("relation = 'C-R'").select("year", "a", "b")
    return network.triad_census(rows, table(s, d, "v_node").select("year", F.col("code").alias("v")))


@query(
    """SELECT g.year, g.a, g.b, g.tie, g.mutual, COALESCE(l.tie, 0) AS before, COALESCE(l.mutual, 0) AS delrecip, 2 * COALESCE(l.tie, 0) - 1 AS stability,
       ROUND(power(1 - exp(-0.5::DOUBLE), (SELECT COUNT(*) FROM arcs x WHERE x.year = g.year AND x.a = g.a) - g.tie), 6) AS gwout,
       ROUND(power(1 - exp(-0.5::DOUBLE), (SELECT COUNT(*) FROM arcs x WHERE x.year = g.year AND x.b = g.b) - g.tie), 6) AS gwin,
       g.sender_pop, g.receiver_pop, abs(g.sender_pop - g.receiver_pop) AS absdiff_pop, g.sender_idealpoint, g.receiver_idealpoint, ROUND(abs(g.sender_idealpoint - g.receiver_idealpoint), 6) AS absdiff_idealpoint,
       COALESCE(e.exports, 0) AS exports, COALESCE(e.n_products, 0) AS n_products
       FROM grid g LEFT JOIN grid l ON l.year = g.year - 1 AND l.a = g.a AND l.b = g.b LEFT JOIN dyads e ON e.year = g.year AND e.i = g.a AND e.j = g.b""",
    ROLES,
    DYADS,
    CR_ARCS,
    """grid AS (SELECT x.year, x.code AS a, y.code AS b, CAST(t.a IS NOT NULL AS INT) AS tie, CAST(o.a IS NOT NULL AS INT) AS mutual, x.pop AS sender_pop, y.pop AS receiver_pop,
       x.idealpoint AS sender_idealpoint, y.idealpoint AS receiver_idealpoint FROM v_node x JOIN v_node y ON x.year = y.year AND x.code <> y.code
       LEFT JOIN arcs t ON t.year = x.year AND t.a = x.code AND t.b = y.code LEFT JOIN arcs o ON o.year = x.year AND o.a = y.code AND o.b = x.code)""",
)
def grf21_change_statistics(s, d):
    rows = _scored(s, d).filter("relation = 'C-R'").select("year", "a", "b")
    nodes = table(s, d, "v_node").select("year", F.col("code").alias("v"), "pop", "idealpoint")
    flows = _dyads(s, d).select("year", F.col("i").alias("a"), F.col("j").alias("b"), "exports", "n_products")
    found = network.change_statistics(rows, nodes, edge_covariates=flows, attributes=("pop", "idealpoint"))
    return found.withColumn("absdiff_idealpoint", F.round("absdiff_idealpoint", 6))


@query("SELECT party, COUNT(*) FILTER (role = 'complainant') AS complainant, COUNT(*) FILTER (role = 'respondent') AS respondent, COUNT(*) FILTER (role = 'third_party') AS third_party, COUNT(*) AS total FROM v_case_party GROUP BY party")
def agg26_role_totals(s, d):
    n = lambda r: F.count_if(F.col("role") == r).alias(r)
    return table(s, d, "v_case_party").groupBy("party").agg(n("complainant"), n("respondent"), n("third_party"), F.count(F.lit(1)).alias("total"))


@query("SELECT i, j, CAST(SUM(v) AS DOUBLE) AS exports FROM v_flow WHERE i <> j GROUP BY ALL ORDER BY exports DESC, i, j LIMIT 15")
def srt05_top_dyads(s, d):
    total = table(s, d, "v_flow").filter("i <> j").groupBy("i", "j").agg(F.sum("v").cast("double").alias("exports"))
    return total.orderBy(F.desc("exports"), "i", "j").limit(15)


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus)::DOUBLE, 6) AS row_share FROM orders GROUP BY o_orderstatus, o_orderpriority")
def agg20_crosstab(s, d):
    from pyspark.sql import Window

    n = table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


@query("SELECT c_mktsegment, ROUND(MEDIAN(c_acctbal), 4) AS median, ROUND(QUANTILE_CONT(c_acctbal, 0.05), 4) AS q05, ROUND(QUANTILE_CONT(c_acctbal, 0.95), 4) AS q95 FROM customer GROUP BY ALL")
def agg21_quantiles(s, d):
    q = lambda p, name: F.round(F.percentile("c_acctbal", F.lit(p)), 4).alias(name)
    return table(s, d, "customer").groupBy("c_mktsegment").agg(q(0.5, "median"), q(0.05, "q05"), q(0.95, "q95"))


@query("SELECT case_id, CAST(strptime(date_text, '%d-%b-%y') AS DATE) AS filed, year FROM v_case")
def q02_two_digit_dates(s, d):
    return table(s, d, "v_case").select("case_id", disputes.two_digit_date("date_text").alias("filed"), "year")


_MARKS = "[" + ", ".join(f"'{w}'" for w in documents.FOREIGN_WORDS) + "]"


def _line_words(line):
    return f"list_filter(regexp_extract_all(lower({line}), '{documents.RUN}'), lambda w: regexp_matches(w, '{documents.WORD}'))"


@query(
    f"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda line: len({_line_words('line')}) < 5 OR
        len(list_filter({_line_words('line')}, lambda w: list_contains({_MARKS}, w))) < 0.2 * len({_line_words('line')})), chr(10)) AS text FROM documents"""
)
def doc12_non_english_lines(s, d):
    return table(s, d, "documents").select("doc_id", documents.english_lines().alias("text"))


@query()
def doc24_chunks(s, d):
    return documents.chunks(table(s, d, "documents"))


BM25 = """terms AS (SELECT source, doc_id, term, COUNT(*) AS tf FROM (SELECT source, doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL),
    lengths AS (SELECT source, doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents),
    sizes AS (SELECT source, COUNT(*) AS n_docs, AVG(n) AS mean_length FROM lengths GROUP BY source),
    raw AS (SELECT source, term, ln(n_docs - COUNT(*) + 0.5) - ln(COUNT(*) + 0.5) AS idf FROM terms JOIN sizes USING (source) GROUP BY source, term, n_docs),
    df AS (SELECT source, term, CASE WHEN idf < 0 THEN 0.25 * AVG(idf) OVER (PARTITION BY source) ELSE idf END AS idf FROM raw),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS term FROM benchmark),
    scores AS (SELECT query_id, source, doc_id, ROUND(SUM(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean_length))), 6) AS score
               FROM asked JOIN terms USING (term) JOIN df USING (source, term) JOIN sizes USING (source) JOIN lengths USING (source, doc_id) GROUP BY ALL)"""


def stored_index(s, d, group="source"):
    """The index of the documents, written to the shared folder and opened from there."""
    path = workspace(s, "index")
    docs = table(s, d, "documents").select("doc_id", "source", "text").withColumn("everything", F.lit("all"))
    index.write_index(docs, path, "doc_id", group)
    return index.open_index(s, path)


def keyword_scores(s, d):
    """query_id, source, doc_id, score of the benchmark's texts, from a stored index of the documents."""
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(stored_index(s, d), asked).withColumnsRenamed({"group": "source", "key": "doc_id"})


@query("SELECT query_id, source, doc_id, score, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= 15", BM25)
def ret04_bm25_topk(s, d):
    found = keyword_scores(s, d)
    return retrieval.top_k(found, ["query_id", "source"], "score", "doc_id", 15)


@query(
    """SELECT query_id, vec_id, cosine, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM (
         SELECT q.vec_id AS query_id, e.vec_id, ROUND(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
           / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS cosine
         FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10"""
)
def ret03_knn(s, d):
    vectors = table(s, d, "embeddings")
    return retrieval.cosine_top_k(vectors, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query(
    """SELECT query_id, parent, ROUND(SUM(weight / (60 + rank - 1)), 9) AS score FROM (
         SELECT query_id, doc_id AS parent, rank, 0.5 AS weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 15
         UNION ALL SELECT query_id, doc_id, rank, 0.5 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 30) GROUP BY ALL""",
    BM25,
)
def ret06_rrf(s, d):
    found = keyword_scores(s, d)
    lists = [retrieval.top_k(found, keys, "score", "doc_id", k) for keys, k in ((["query_id", "source"], 15), (["query_id"], 30))]
    ranked = [x.select("query_id", F.col("doc_id").alias("parent"), (F.col("rank") - 1).alias("rank"), F.lit(0.5).alias("weight")) for x in lists]
    return retrieval.fused(ranked[0].unionByName(ranked[1]))


@query("SELECT conv_id, turn, role, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS seq FROM conversations")
def win08_sequence(s, d):
    return documents.sequence_numbers(table(s, d, "conversations"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "role", "seq")


@query("SELECT conv_id, turn, role, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS INT) AS occurrence, COUNT(*) OVER (PARTITION BY conv_id, role) AS total FROM conversations")
def win09_occurrence(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "role")
    return table(s, d, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w.orderBy("turn", "text")) - 1).alias("occurrence"), F.count(F.lit(1)).over(w).alias("total"))


PROBLEMS = """checked AS (SELECT case_id, CASE CAST(case_id % 11 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan' ELSE 'steel' END AS products,
    CASE CAST(case_id % 13 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'nan' ELSE '15' END AS sections, CASE CAST(case_id % 17 AS INT) WHEN 0 THEN '' ELSE '15' END AS title_sections,
    CASE CAST(case_id % 7 AS INT) WHEN 0 THEN 'subsidy' WHEN 1 THEN ' nan ' ELSE NULL END AS policy, severity FROM v_case)"""
_EMPTY = "({0} IS NULL OR {0} IN ('', 'nan'))"
_FILLED = "(trim(COALESCE({0}, '')) NOT IN ('', 'nan'))"


@query(
    " UNION ALL ".join(
        f"SELECT case_id, '{name}' AS problem FROM checked WHERE {rule}"
        for name, rule in {
            "empty_product_descriptions": _EMPTY.format("products"),
            "empty_hs_sections": _EMPTY.format("sections"),
            "empty_title_hs": _EMPTY.format("title_sections"),
            "mutual_exclusivity_violation": f"{_FILLED.format('products')} = {_FILLED.format('policy')}",
            "failed_severity": "severity IS NULL",
        }.items()
    ),
    PROBLEMS,
)
def doc27_violations(s, d):
    """Cases by the five classes of problems, from columns that hold planted ones; one pass over the cases."""
    pick = lambda n, odd, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in odd.items() for x in kv)), (F.col("case_id") % n).cast("int")), F.lit(other))
    null = lambda n, at, c: F.when(F.col("case_id") % n == at, F.lit(None)).otherwise(c)
    rows = table(s, d, "v_case").select(
        "case_id",
        null(11, 0, pick(11, {1: "", 2: "nan"}, "steel")).alias("products"),
        null(13, 0, pick(13, {1: "nan"}, "15")).alias("sections"),
        pick(17, {0: ""}, "15").alias("title_sections"),
        F.when(F.col("case_id") % 7 == 0, "subsidy").when(F.col("case_id") % 7 == 1, " nan ").alias("policy"),
        "severity",
    )
    return documents.problems(rows)


@query("SELECT year, COUNT(*) AS n, ROUND(COUNT(severity) / COUNT(*)::DOUBLE, 6) AS known FROM v_case GROUP BY year")
def viz03_annual_counts(s, d):
    return table(s, d, "v_case").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("severity") / F.count(F.lit(1)), 6).alias("known"))


@query("SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def doc29_page_parse(s, d):
    html = F.col("html")
    return table(s, d, "pages").select("page_id", F.trim(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


@query(
    """SELECT l_returnflag, ROUND(covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity), 6) AS slope,
       ROUND(avg(l_extendedprice) - covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) * avg(l_quantity), 4) AS intercept, COUNT(*) AS n FROM lineitem GROUP BY ALL"""
)
def mod08_ols(s, d):
    return stats.ols(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query(
    """SELECT grp, t, CAST(n AS BIGINT) AS n, d, ROUND(EXP(SUM(LN(1 - d / n::DOUBLE)) OVER (PARTITION BY grp ORDER BY t)), 6) AS survival FROM (
         SELECT grp, t, CAST(SUM(e) AS BIGINT) AS d, SUM(COUNT(*)) OVER (PARTITION BY grp ORDER BY t DESC) AS n
         FROM (SELECT o_orderpriority AS grp, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 90 AS INT) AS t, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS e FROM orders) GROUP BY grp, t)
       WHERE d > 0 AND d < n"""
)
def mod05_km(s, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = table(s, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.floor(days / 90).cast("int").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"))
    return stats.kaplan_meier(rows, "grp", "t", "e")
