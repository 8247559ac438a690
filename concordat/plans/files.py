"""Round trips of whole tables through files in the shared folder, each with the SQL of what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.plans.catalog import DYADS, _dyads, query
from concordat.sources import files
from concordat.sources.views import table


@query("SELECT doc_id, text, lang FROM documents")
def snk01_csv_round_trip(s, d):
    """Texts with quotes, commas and line ends, through the columns that are on the list."""
    path = files.workspace(s, "csv")
    files.write_csv(table(s, d, "documents"), path, ["doc_id", "text", "not_there", "lang"])
    return files.read_csv(s, path, "doc_id long, text string, lang string")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def src01_csv_inferred(s, d):
    path = files.workspace(s, "csv")
    files.write_csv(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return files.read_csv(s, path).withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def src02_csv_projection(s, d):
    path = files.workspace(s, "csv")
    files.write_csv(table(s, d, "supplier"), path)
    return files.read_csv(s, path, table(s, d, "supplier").schema, ["s_suppkey", "s_acctbal"])


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part")
def src03_csv_types(s, d):
    """Codes keep their zeros in front, as the schema says string."""
    path = files.workspace(s, "csv")
    files.write_csv(table(s, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code")), path)
    return files.read_csv(s, path, "p_partkey long, code string")


@query("SELECT year, i, j, exports FROM dyads WHERE year BETWEEN 1996 AND 1999 AND year <> 1998", DYADS)
def src04_file_per_year(s, d):
    """A folder with a file a year, one of which is missing."""
    folder = files.workspace(s, "years")
    once = files.workspace(s, "dyads")  # else each file would join and add up all flows again
    _dyads(s, d).select("year", "i", "j", "exports").write.parquet(once)
    flows = s.read.parquet(once)
    for year in (1995, 1996, 1997, 1999, 2000):  # a fixed list of files, not of rows
        files.write_csv(flows.filter(F.col("year") == year).drop("year"), f"{folder}/flows_Y{year}_V1")
    return files.read_years(s, folder, range(1996, 2000), "i int, j int, exports double")


@query("SELECT conv_id, turn, role, text FROM conversations")
def snk02_json_lines_round_trip(s, d):
    path = files.workspace(s, "jsonl")
    files.write_json_lines(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return files.read_json_lines(s, path, "conv_id long, turn long, role string, text string")


@query("SELECT count(*) AS n FROM (SELECT 1 FROM events LIMIT 25)")
def src07_json_lines_first(s, d):
    path = files.workspace(s, "jsonl")
    files.write_json_lines(table(s, d, "events").select("event_id", "event_type"), path)
    return files.read_json_lines(s, path, "event_id long, event_type string", 25).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT code, year, CAST(pop AS BIGINT) AS pop, idealpoint FROM v_node")
def snk03_json_documents(s, d):
    path = files.workspace(s, "json")
    node = table(s, d, "v_node").select("code", "year", "pop", "idealpoint")
    files.write_json_documents(node, "year", path)
    fields = "code int, year int, pop long, idealpoint double"
    return s.read.text(path).select(F.from_json("value", fields).alias("r")).select("r.*")


@query("SELECT event_type AS key, CAST(COUNT(*) AS INT) AS value FROM events GROUP BY event_type")
def src08_json_object(s, d):
    path = files.workspace(s, "json")
    counts = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    m = counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("value"))
    m.write.text(path)
    return files.read_json_map(s, f"{path}/part-*")


@query("SELECT case_id, severity * 2 AS score FROM v_case")
def snk08_resumed_results(s, d):
    """A first run that stopped after some cases, and a second one that takes up the others."""
    path, cases = files.workspace(s, "results"), table(s, d, "v_case").select("case_id", "severity")
    work = lambda rows: rows.select("case_id", (F.col("severity") * 2).alias("score"))
    files.resumed(cases.filter("case_id % 3 = 0"), ["case_id"], path, work, 1)
    return files.resumed(cases, ["case_id"], path, work)


@query("SELECT case_id, COALESCE(severity, 3) AS severity FROM v_case")
def snk14_recomputed(s, d):
    cases = table(s, d, "v_case").select("case_id", "severity")
    return files.recomputed(cases, cases.filter("severity is null"), ["case_id"], cases.withColumn("severity", F.lit(3)))


@query("SELECT CAST(n_nationkey AS INT) AS number, length(n_name) + 1 AS bytes, md5(n_name || chr(10)) AS digest FROM nation")
def src12_numbered_folders(s, d):
    """A folder for each nation with one text file; the commit's marker beside them belongs to none."""
    root = files.workspace(s, "folders")
    table(s, d, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(root)
    found = files.read_folders(s, root, "*.txt", r"=(\d+)/[^/]*$")
    return found.select("number", F.col("length").alias("bytes"), F.md5("content").alias("digest"))


@query("SELECT s_suppkey, ROUND(COALESCE(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, 0), 2) AS s_acctbal FROM supplier")
def snk09_overwritten_input(s, d):
    path = files.workspace(s, "table")
    table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("s_acctbal")).write.parquet(path)
    files.overwrite_in_place(s.read.parquet(path).fillna(0), path)
    return s.read.parquet(path).select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))
