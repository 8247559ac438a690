"""Document clean-up, retrieval end to end and plot data, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from concordat.functions import text as t
from concordat.operators import cleaning, documents, retrieval
from concordat.plans.catalog import BM25, DYADS, ROLES, SIGNED, _dyads, _scored, agg10_signed_edges, keyword_scores, query
from concordat.sources.views import table

#: Documents with the lines that clean-up is for.
DECORATED = """concat('WORLD TRADE ORGANIZATION', chr(10), 'WT/DS', doc_id, '/R', chr(10), 'G/L/12 IP/D/7', chr(10), 'RESTRICTED', chr(10), 'Page 3', chr(10), ' - 4 - ', chr(10), text, chr(10), 'WT/DS', doc_id, '/R',
    chr(10), '(anglais)', chr(10), '/', chr(10), '. , ;', chr(10), chr(10), chr(10), chr(10), 'Page A-12', chr(10), 'end  of   it ', CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), 'Table  of Contents') ELSE '' END)"""


def _decorated(s, d):
    return table(s, d, "documents").select("doc_id", F.expr(DECORATED).alias("text"))


def _blank(x, *patterns):
    for p in patterns:
        x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '{p}') THEN '' ELSE l END), chr(10))"
    return x


def _even(x):
    for p, to in ((r"\n{3,}", "concat(chr(10), chr(10))"), (r"[ \t]+", "' '"), (r" +\n", "chr(10)"), (r"^\s+|\s+$", "''")):
        x = f"regexp_replace({x}, '{p}', {to}, 'g')"
    return x


def _digest(x):
    return f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {x} AS x FROM documents)"


def _digested(rows, x):
    return rows.select("doc_id", x.alias("x")).select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@query("SELECT doc_id, array_to_string(list_concat(" + ", ".join(f"regexp_extract_all(h, '{p}')" for p in cleaning.HEADER_CODES) + f"), ' ') AS codes FROM (SELECT doc_id, substr({DECORATED}, 1, 800) AS h FROM documents)")
def doc03_header_codes(s, d):
    return _decorated(s, d).select("doc_id", F.array_join(cleaning.header_codes(F.col("text")), " ").alias("codes"))


@query(
    f"""SELECT doc_id, length(trim(x)) >= 50 AND (regexp_matches(substr(x, 1, 300), '(?im)page\\s+[ivxlc]+\\s*$') OR regexp_matches(x, '(?i)TABLE\\s+OF\\s+CONTENTS') OR
       len(list_filter(filled, lambda l: regexp_matches(l, '\\.{{10,}}'))) > 0.3 * len(filled)) AS contents FROM (SELECT doc_id, x, list_filter(string_split(x, chr(10)), lambda l: trim(l) <> '') AS filled
       FROM (SELECT doc_id, {DECORATED} AS x FROM documents))"""
)
def doc07_contents_page(s, d):
    return _decorated(s, d).select("doc_id", cleaning.is_contents_page(F.col("text")).alias("contents"))


@query(_digest(_blank(DECORATED, cleaning.HEADING_LINE, cleaning.LANGUAGE_LINE)))
def doc09_headings(s, d):
    return _digested(_decorated(s, d), cleaning.blanked(cleaning.blanked(F.col("text"), cleaning.HEADING_LINE), cleaning.LANGUAGE_LINE))


@query(_digest(_blank(DECORATED, cleaning.PAGE_LINE)))
def doc10_page_numbers(s, d):
    return _digested(_decorated(s, d), cleaning.blanked(F.col("text"), cleaning.PAGE_LINE))


TITLED = "concat(substr(text, 1, 24), chr(10), text, chr(10), lower(substr(text, 1, 24)), ' ', substr(text, 1, 24))"


@query(_digest(f"CASE WHEN length(ti) >= 10 THEN concat(ti, regexp_replace(substr({TITLED}, length(ti) + 1), concat('(?i)\\Q', replace(ti, ' ', '\\E\\s+\\Q'), '\\E'), '', 'g')) ELSE {TITLED} END").replace("FROM documents)", "FROM (SELECT *, substr(text, 1, 24) AS ti FROM documents))"))
def doc13_title_once(s, d):
    rows = table(s, d, "documents").select("doc_id", F.expr(TITLED).alias("text"), F.substring("text", 1, 24).alias("title"))
    return _digested(rows, cleaning.title_once(F.col("text"), F.col("title")))


@query(_digest(_even(_blank(DECORATED, cleaning.HEADING_LINE, cleaning.LANGUAGE_LINE, cleaning.PAGE_LINE, cleaning.NOISE_LINE))))
def doc14_cleaned(s, d):
    return _digested(_decorated(s, d), cleaning.cleaned(F.col("text")))


@query("SELECT doc_id, CASE WHEN trim(COALESCE(x, '')) = '' THEN 'empty' WHEN length(trim(x)) < 50 THEN 'scanned' WHEN lang IN ('fr', 'es') THEN 'non_english' END AS reason FROM (SELECT doc_id, lang, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE text END AS x FROM documents)")
def doc17_review_reason(s, d):
    rows = table(s, d, "documents").withColumn("x", F.when(F.col("doc_id") % 31 != 0, F.col("text")))
    return rows.select("doc_id", cleaning.review_reason(F.col("x"), F.coalesce(F.col("lang").isin("fr", "es"), F.lit(False)).cast("double")).alias("reason"))


@query("SELECT doc_id, n AS tokens, CASE WHEN n <= 6000 THEN 'whole' ELSE 'chunks' END AS route FROM (SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT) AS n FROM documents)")
def doc23_tokens_and_route(s, d):
    rows = table(s, d, "documents").select("doc_id", cleaning.token_estimate(F.col("text")).alias("tokens"))
    return rows.select("doc_id", "tokens", F.when(F.col("tokens") <= 6000, "whole").otherwise("chunks").alias("route"))


@query(
    """SELECT p_partkey, CASE WHEN x IS NULL THEN 'NO_DATA' WHEN len(list_filter(CASE WHEN len(long) > 0 THEN long ELSE words END, lambda w: contains(lower(x), w))) > 0 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict
       FROM (SELECT p_partkey, x, words, list_filter(words, lambda w: length(w) > 3) AS long FROM (SELECT p_partkey, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Small WIDGETS of steel' ELSE p_brand END AS x,
         list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: w <> '') AS words FROM part))"""
)
def doc28_title_validation(s, d):
    x = F.when(F.col("p_partkey") % 3 == 1, "Small WIDGETS of steel").when(F.col("p_partkey") % 3 == 2, F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", F.when(x.isNull(), "NO_DATA").when(t.contains_keyword(F.col("p_name"), x), "MATCH").otherwise("MISMATCH").alias("verdict"))


# retrieval

#: Weights, number of candidates and languages in place of document types, by task.
ROUTES = {"industry": (0.5, 0.5, 15, ("en", "fr")), "severity": (0.3, 0.7, 15, ("en",)), "third_party": (0.5, 0.5, 10, ("en", "de"))}
KEPT = 8


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


@query(" UNION ALL ".join(f"SELECT '{task}' AS task, {b}::DOUBLE AS keyword_weight, {v}::DOUBLE AS semantic_weight, {k} AS candidates, '{' '.join(langs)}' AS langs" for task, (b, v, k, langs) in ROUTES.items()))
def ret01_routes(s, d):
    return s.createDataFrame([(task, b, v, k, " ".join(langs)) for task, (b, v, k, langs) in ROUTES.items()], "task string, keyword_weight double, semantic_weight double, candidates int, langs string")


@query(" UNION ALL ".join(f"SELECT '{task}' AS task, doc_id FROM documents WHERE source = (SELECT MIN(source) FROM documents) AND lang IN ({_quoted(langs)})" for task, (*_, langs) in ROUTES.items()))
def ret02_metadata_filter(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang")
    docs = docs.join(F.broadcast(docs.agg(F.min("source").alias("source"))), "source")
    tasks = F.array(*(F.when(F.col("lang").isin(*langs), F.lit(task)) for task, (*_, langs) in ROUTES.items()))
    return docs.select(F.explode(F.filter(tasks, lambda x: x.isNotNull())).alias("task"), "doc_id")


COSINE = """list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"""


def _retrieve_sql(task):
    b, v, k, langs = ROUTES[task]
    return f""", near AS (SELECT q.vec_id AS query_id, d.source, d.doc_id, ROUND({COSINE}, 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) WHERE d.lang IN ({_quoted(langs)})),
       lists AS (SELECT query_id, source, doc_id, {v}::DOUBLE AS weight, ROW_NUMBER() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= {k}
         UNION ALL SELECT query_id, source, doc_id, {b}::DOUBLE, ROW_NUMBER() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank
         FROM (SELECT * FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) <= 15) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE lang IN ({_quoted(langs)}) QUALIFY rank <= {k}),
       fused AS (SELECT query_id, source, doc_id // 4 AS parent, ROUND(SUM(weight / (60 + rank - 1)), 9) AS score FROM lists GROUP BY ALL)
       SELECT query_id, source, parent, score, CAST(ROW_NUMBER() OVER (PARTITION BY query_id, source ORDER BY score DESC, parent) AS INT) AS rank FROM fused QUALIFY rank <= {KEPT}"""


def retrieve(s, d, task):
    """Route, filter, search by words and vectors within each case, fuse by parent and keep the best parents.

    The queries are the texts of the benchmark; their vectors, those of equal ids, are compared with each case's
    documents block by block. A query without a vector is searched by words alone. Keyword results come from the stored
    index and are cut to 15 before the filter, as the index of a case gives no more.
    """
    keyword, semantic, k, langs = ROUTES[task]
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"))
    docs, vectors = table(s, d, "documents").select("doc_id", "source", "lang"), table(s, d, "embeddings").select("vec_id", "embedding")
    own = vectors.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    held = vectors.join(docs.filter(F.col("lang").isin(*langs)).select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    near = retrieval.cosine_top_k(held, own, k, group="source").select("query_id", "source", F.col("vec_id").alias("doc_id"), F.col("cosine").alias("score"), "rank")
    keys = ["query_id", "source"]
    found = retrieval.top_k(keyword_scores(s, d), keys, "score", "doc_id", 15).drop("rank")
    found = found.join(docs.filter(F.col("lang").isin(*langs)).select("doc_id"), "doc_id", "left_semi")
    lists = near.withColumn("weight", F.lit(semantic)).unionByName(retrieval.top_k(found, keys, "score", "doc_id", k).withColumn("weight", F.lit(keyword)))
    part = F.col("weight") / (60 + F.col("rank") - 1)
    fused = lists.groupBy(*keys, F.floor(F.col("doc_id") / 4).alias("parent")).agg(F.round(F.sum(part), 9).alias("score"))
    return retrieval.top_k(fused, keys, "score", "parent", KEPT).select(*keys, "parent", "score", "rank")


@query(_retrieve_sql("severity"), BM25)
def ret09_retrieve(s, d):
    return retrieve(s, d, "severity")


@query("SELECT conv_id, array_to_string(list(parent ORDER BY first), ',') AS parents FROM (SELECT conv_id, turn // 2 AS parent, MIN(place) AS first FROM (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role, text) AS place FROM conversations) GROUP BY ALL) GROUP BY conv_id")
def ret08_parent_lookup(s, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn", "role", "text"))
    first = table(s, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("parent"), place.alias("place")).groupBy("conv_id", "parent").agg(F.min("place").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "parent"))), lambda x: x["parent"].cast("string"))
    return first.groupBy("conv_id").agg(F.array_join(ordered, ",").alias("parents"))


@query("SELECT conv_id, turn, role FROM (SELECT *, contains(lower(text), role) AS hit, bool_or(contains(lower(text), role)) OVER (PARTITION BY conv_id, role) AS any_hit FROM conversations) WHERE hit OR NOT any_hit")
def ret10_mention_filter(s, d):
    rows = table(s, d, "conversations").withColumn("hit", F.contains(F.lower("text"), F.col("role")))
    return rows.withColumn("any_hit", F.max("hit").over(Window.partitionBy("conv_id", "role"))).filter("hit or not any_hit").select("conv_id", "turn", "role")


# data of plots


@query("SELECT * FROM (SELECT measure, j, v, CAST(ROW_NUMBER() OVER (PARTITION BY measure ORDER BY v DESC, j) AS INT) AS rank FROM (SELECT j, 'exports' AS measure, ROUND(SUM(exports), 2) AS v FROM dyads WHERE i = 3 GROUP BY j UNION ALL SELECT i, 'imports', ROUND(SUM(exports), 2) FROM dyads WHERE j = 3 GROUP BY i UNION ALL SELECT j, 'products', SUM(n_products)::DOUBLE FROM dyads WHERE i = 3 GROUP BY j UNION ALL SELECT j, 'years', COUNT(*)::DOUBLE FROM dyads WHERE i = 3 GROUP BY j)) WHERE rank <= 7", DYADS)
def viz01_top_partners(s, d):
    flows = _dyads(s, d).filter("i = 3 or j = 3")
    one = lambda keep, end, name, v: flows.filter(keep).groupBy(F.col(end).alias("j")).agg(v.cast("double").alias("v")).select("j", F.lit(name).alias("measure"), "v")
    parts = one("i = 3", "j", "exports", F.round(F.sum("exports"), 2)).unionByName(one("j = 3", "i", "imports", F.round(F.sum("exports"), 2)))
    parts = parts.unionByName(one("i = 3", "j", "products", F.sum("n_products"))).unionByName(one("i = 3", "j", "years", F.count(F.lit(1))))
    return retrieval.top_k(parts, ["measure"], "v", "j", 7).select("measure", "j", "v", "rank")


@query("SELECT source, lang, COUNT(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source, lang LIMIT 15")
def viz02_type_counts(s, d):
    return table(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "lang").limit(15)


@query("SELECT party, COUNT(DISTINCT case_id) FILTER (role = 'complainant') AS brought, COUNT(DISTINCT case_id) FILTER (role = 'respondent') AS faced FROM v_case_party GROUP BY party ORDER BY brought + faced DESC, party LIMIT 12")
def viz04_top_litigants(s, d):
    """A party has a role in a case once, so that its cases are counted without telling them apart again."""
    of = lambda role: F.count_if(F.col("role") == role)
    per = table(s, d, "v_case_party").groupBy("party").agg(of("complainant").alias("brought"), of("respondent").alias("faced"))
    return per.orderBy(F.desc(F.col("brought") + F.col("faced")), "party").limit(12)


@query("SELECT ally, ROUND(quantile_cont(exports, 0.25), 4) AS q1, ROUND(quantile_cont(exports, 0.5), 4) AS q2, ROUND(quantile_cont(exports, 0.75), 4) AS q3, MIN(exports) AS least, MAX(exports) AS most FROM (SELECT exports, CASE WHEN x.a IS NULL THEN 0 ELSE 1 END AS ally FROM dyads d LEFT JOIN v_ally x ON x.year = d.year AND x.a = i AND x.b = j) GROUP BY ally", DYADS)
def viz05_stakes_by_alliance(s, d):
    ally = table(s, d, "v_ally").select("year", F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1).alias("ally"))
    rows = _dyads(s, d).join(ally, ["year", "i", "j"], "left").select("exports", F.coalesce("ally", F.lit(0)).alias("ally"))
    q = lambda p: F.round(F.percentile("exports", p), 4)
    return rows.groupBy("ally").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.min("exports").alias("least"), F.max("exports").alias("most"))


@query("SELECT year, relation, ROUND(100 * AVG(CASE WHEN severity >= 4 THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS rate, COUNT(*) AS n FROM scored WHERE severity IS NOT NULL GROUP BY ALL", ROLES)
def viz06_escalation_rate(s, d):
    rows = _scored(s, d).filter("severity is not null")
    return rows.groupBy("year", "relation").agg(F.round(100 * F.avg((F.col("severity") >= 4).cast("double")), 4).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("SELECT dimension, CAST(floor(v / 0.5) AS BIGINT) AS bin, COUNT(*) AS n FROM (SELECT 'severity' AS dimension, severity::DOUBLE AS v FROM v_case UNION ALL SELECT 'half', severity / 2.0 FROM v_case) WHERE v IS NOT NULL GROUP BY ALL")
def viz07_severity_histogram(s, d):
    wide = table(s, d, "v_case").select("case_id", F.col("severity").cast("double").alias("severity"), (F.col("severity") / 2.0).alias("half"))
    long = wide.unpivot(["case_id"], ["severity", "half"], "dimension", "v").filter("v is not null")
    return long.groupBy("dimension", F.floor(F.col("v") / 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT section, COUNT(DISTINCT case_id) AS cases FROM v_case_section GROUP BY section")
def viz08_section_counts(s, d):
    return table(s, d, "v_case_section").groupBy("section").agg(F.count_distinct("case_id").alias("cases"))


@query(", counted AS (SELECT year, CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS kind, COUNT(*) AS n FROM signed GROUP BY ALL) SELECT * FROM counted", SIGNED)
def viz09_signed_dyads(s, d):
    kind = F.when(F.col("sign") > 0, "positive").otherwise("negative")
    return agg10_signed_edges(s, d).groupBy("year", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
