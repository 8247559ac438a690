"""Scalar functions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.functions import text as t
from concordat.plans.catalog import query
from concordat.sources.views import table

NATIONS = {f"NATION_{k}": f"Nation {k}" for k in range(12)}
NATIONS_SQL = "CASE n_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NATIONS.items()) + " END"
#: Names with the oddities that the rules are for, made from the customers' names.
ODD = "concat(CASE c_custkey % 4 WHEN 0 THEN ' The ' WHEN 1 THEN 'the ' WHEN 2 THEN '' ELSE ' ' END, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN '*,' WHEN 1 THEN ' ' ELSE '' END)"
QUOTED = "concat(' ‘', c_mktsegment, '’ and “', c_name, '” ')"
TITLE = "concat(p_brand, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' - ' END, p_name, CASE WHEN p_partkey % 2 = 0 THEN concat(' (', p_type, ' - ', p_size, ')') ELSE '' END)"
LISTS = "CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderpriority, '; ', o_orderstatus, ';;') WHEN 1 THEN concat('[', chr(39), o_orderpriority, chr(39), ', \"', o_orderstatus, '\"]') WHEN 2 THEN concat(' ', o_orderpriority, ' | ', o_orderstatus) ELSE '' END"


def _odd(s, d, name, sql):
    return table(s, d, name).withColumn("odd", F.expr(sql))


@query(f"SELECT c_custkey, trim(translate({QUOTED}, '‘’“”', '''''\"\"')) AS name FROM customer")
def str01_plain_quotes(s, d):
    return _odd(s, d, "customer", QUOTED).select("c_custkey", t.plain_quotes(F.col("odd")).alias("name"))


@query(f"SELECT n_nationkey, COALESCE({NATIONS_SQL}, n_name) AS name FROM nation")
def str02_harmonised_names(s, d):
    return table(s, d, "nation").select("n_nationkey", F.coalesce(t.mapped(F.col("n_name"), NATIONS), "n_name").alias("name"))


@query("SELECT p_partkey, replace(replace(p_name, 'widget', 'gadget'), ' ', '_') AS name FROM part")
def str03_replaced(s, d):
    return table(s, d, "part").select("p_partkey", F.replace(F.replace("p_name", F.lit("widget"), F.lit("gadget")), F.lit(" "), F.lit("_")).alias("name"))


@query("SELECT p_partkey, code, substr(code, 1, 2) AS hs2 FROM (SELECT p_partkey, CASE WHEN length(raw) < 6 THEN lpad(raw, 6, '0') ELSE raw END AS code FROM (SELECT p_partkey, CAST(p_partkey * 37 AS VARCHAR) AS raw FROM part))")
def str04_zero_padded(s, d):
    code = t.zero_padded((F.col("p_partkey") * 37).cast("string"), 6)
    return table(s, d, "part").select("p_partkey", code.alias("code"), F.substring(code, 1, 2).alias("hs2"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ') AS name FROM part")
def str05_title_case(s, d):
    return table(s, d, "part").select("p_partkey", F.initcap("p_name").alias("name"))


@query(f"SELECT o_orderkey, array_to_string(list_filter(list_transform(regexp_split_to_array({LISTS}, '[;|]'), lambda x: trim(x)), lambda x: x <> ''), '#') AS items FROM orders WHERE o_orderkey % 4 <> 1")
def str06_split_list(s, d):
    return _odd(s, d, "orders", LISTS).filter("o_orderkey % 4 <> 1").select("o_orderkey", F.array_join(t.split_list(F.col("odd")), "#").alias("items"))


@query(
    f"""SELECT o_orderkey, array_to_string(list_filter(CASE WHEN regexp_matches(x, '^\\s*\\[') THEN list_transform(regexp_extract_all(x, '''[^'']*''|"[^"]*"'), lambda y: trim(substr(y, 2, length(y) - 2)))
       ELSE list_transform(regexp_split_to_array(x, '[;|]'), lambda y: trim(y)) END, lambda y: y <> ''), '#') AS items FROM (SELECT o_orderkey, {LISTS} AS x FROM orders)"""
)
def str07_list_literal(s, d):
    return _odd(s, d, "orders", LISTS).select("o_orderkey", F.array_join(t.listed(F.col("odd")), "#").alias("items"))


@query("SELECT o_orderkey, TRY_CAST(regexp_replace(concat(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'DS' END, o_orderkey), '^DS', '') AS INT) AS number FROM orders")
def str08_id_number(s, d):
    name = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("DS"), F.col("o_orderkey").cast("string"))
    return table(s, d, "orders").select("o_orderkey", t.id_number(name, "DS").alias("number"))


@query(f"SELECT p_partkey, trim(regexp_replace(CASE WHEN instr(x, ' - ') > 0 THEN substr(x, instr(x, ' - ') + 3) ELSE x END, '\\s*\\([^)]*\\)\\s*$', '')) AS product FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def str09_product(s, d):
    return _odd(s, d, "part", TITLE).select("p_partkey", t.product(F.col("odd")).alias("product"))


@query(f"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(trim({ODD})), '^the ', ''), '[,;:!*]+$', '')) AS name FROM customer")
def str10_normal_name(s, d):
    return _odd(s, d, "customer", ODD).select("c_custkey", t.normal_name(F.col("odd")).alias("name"))


ALIASES = {"MACHINERY": "machines", "FURNITURE.": "chairs", "BUILDING": "houses"}
ALIASES_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " END"
STOPPED = "concat(c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END)"


@query("SELECT c_custkey, COALESCE(" + ", ".join(ALIASES_SQL.format(x) for x in ("x", "regexp_replace(x, '\\.$', '')", "concat(x, '.')")) + f", x) AS name FROM (SELECT c_custkey, {STOPPED} AS x FROM customer)")
def str11_alias(s, d):
    return _odd(s, d, "customer", STOPPED).select("c_custkey", t.alias(F.col("odd"), ALIASES).alias("name"))


SPACED = "concat('Art.', p_size, '  Art.XV', p_size, ' ', p_name, p_size, CASE WHEN p_partkey % 2 = 0 THEN '  \t x' ELSE ' ' END)"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace({SPACED}, '\\s+', ' ', 'g')), '([a-z])([0-9])', '\\1 \\2', 'g'), 'Art\\.([A-Z])', 'Art. \\1', 'g') AS x FROM part")
def str12_spaced(s, d):
    return _odd(s, d, "part", SPACED).select("p_partkey", t.spaced(F.col("odd")).alias("x"))


KEYS = "concat(' ', p_type, ' / ', p_name, ' (', p_brand, ')')"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim({KEYS})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, CASE p_type WHEN 'SMALL' THEN 'little' ELSE lower(p_type) END AS special FROM part")
def str13_snake_key(s, d):
    return _odd(s, d, "part", KEYS).select("p_partkey", t.snake_key(F.col("odd")).alias("key"), t.snake_key(F.col("p_type"), {"small": "little"}).alias("special"))


@query("SELECT conv_id, turn, role, format('F{:02d}_DS{}_SEQ{:03d}', conv_id % 100, conv_id, turn) AS id FROM conversations")
def str14_format_id(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.format_string("F%02d_DS%d_SEQ%03d", F.col("conv_id") % 100, F.col("conv_id"), F.col("turn")).alias("id"))


HS = "CASE p_partkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN concat('HS ', p_size + 10) ELSE concat(p_size + 10, '.', p_partkey) END"


@query(f"SELECT p_partkey, chapter, CASE WHEN chapter BETWEEN 1 AND 24 THEN 1 WHEN chapter BETWEEN 25 AND 49 THEN 2 WHEN chapter >= 50 THEN 3 END AS section FROM (SELECT p_partkey, TRY_CAST(substr(regexp_replace({HS}, '[^0-9]', '', 'g'), 1, 2) AS INT) AS chapter FROM part)")
def str15_chapter_section(s, d):
    c = t.chapter(F.col("odd"))
    return _odd(s, d, "part", HS).select("p_partkey", c.alias("chapter"), F.when(c.between(1, 24), 1).when(c.between(25, 49), 2).when(c >= 50, 3).alias("section"))


@query("SELECT item_id, len(list_filter(CASE WHEN len(long) > 0 THEN long ELSE words END, lambda w: contains('the and of in with that', w))) > 0 AS found FROM (SELECT item_id, words, list_filter(words, lambda w: length(w) > 3) AS long FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS words FROM benchmark))")
def str16_keyword_match(s, d):
    return table(s, d, "benchmark").select("item_id", t.contains_keyword(F.col("text"), F.lit("the and of in with that")).alias("found"))


@query("SELECT doc_id, substr(text, 1, 120) AS start, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), ' [...]') ELSE text END AS context FROM documents")
def str17_preview(s, d):
    return table(s, d, "documents").select("doc_id", t.preview(F.col("text"), 120).alias("start"), t.preview(F.col("text"), 500, " [...]").alias("context"))


@query("SELECT case_id, array_to_string(list_sort(list(section)), '; ') AS sections FROM v_case_section GROUP BY case_id")
def str18_joined(s, d):
    return table(s, d, "v_case_section").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("section")), "; ").alias("sections"))


@query("SELECT case_id, party, concat('Dispute DS', case_id, ' of ', year, ': measures at issue for party ', party) AS query FROM v_case_party JOIN v_case USING (case_id) WHERE role = 'complainant'")
def str19_query_template(s, d):
    rows = table(s, d, "v_case_party").filter("role = 'complainant'").join(table(s, d, "v_case").select("case_id", "year"), "case_id")
    return rows.select("case_id", "party", F.format_string("Dispute DS%d of %d: measures at issue for party %d", "case_id", "year", "party").alias("query"))


@query("SELECT case_id, COALESCE(NULLIF(array_to_string(list_sort(list(party) FILTER (role = 'third_party')), ', '), ''), 'Unknown') AS third FROM v_case_party GROUP BY case_id")
def str20_name_or_unknown(s, d):
    third = F.array_sort(F.collect_list(F.when(F.col("role") == "third_party", F.col("party"))))
    return table(s, d, "v_case_party").groupBy("case_id").agg(t.name_or_unknown(F.transform(third, lambda x: x.cast("string"))).alias("third"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.missing') AS missing FROM events")
def json_fields(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("missing"))


@query("SELECT user_id, CAST(map_extract_value(m, 'error') AS BIGINT) AS errors, len(map_keys(m)) AS kinds FROM (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)")
def map_counts(s, d):
    counts = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.try_element_at("m", F.lit("error")).alias("errors"), F.size(F.map_keys("m")).cast("long").alias("kinds"))


@query("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS roles, list_has_any(list_distinct_ordered, ['system', 'assistant']) AS answered FROM (SELECT conv_id, list(role ORDER BY first) AS list_distinct_ordered FROM (SELECT conv_id, role, MIN(turn * 1000 + ascii(role)) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id)")
def array_ordered_distinct(s, d):
    first = table(s, d, "conversations").groupBy("conv_id", "role").agg(F.min(F.col("turn") * 1000 + F.ascii("role")).alias("first"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(roles.alias("r")).select("conv_id", F.array_join("r", ",").alias("roles"), F.arrays_overlap("r", F.array(F.lit("system"), F.lit("assistant"))).alias("answered"))


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS days, CAST(year(o_orderdate) AS INT) AS y, strftime(o_orderdate, '%d-%b-%y') AS text, CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS month FROM orders")
def date_functions(s, d):
    at = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), at.cast("date")).alias("days"), F.year(at).alias("y"), F.date_format(at, "dd-MMM-yy").alias("text"), F.trunc(at, "month").cast("string").alias("month"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 7, 2) AS banker, ROUND(ln(1 + l_quantity), 6) AS l1, ROUND(sqrt(l_quantity), 6) AS root, ROUND(exp(-l_discount), 6) AS e, CAST(floor(l_quantity / 7) AS BIGINT) AS f FROM lineitem")
def math_functions(s, d):
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_extendedprice") / 7, 2).alias("banker"), F.round(F.log1p(q), 6).alias("l1"), F.round(F.sqrt(q), 6).alias("root"), F.round(F.exp(-F.col("l_discount")), 6).alias("e"), F.floor(q / 7).alias("f"))
