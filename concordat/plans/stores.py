"""Stored indexes, key-value stores and resumed streams, each with its SQL."""

from __future__ import annotations

import datetime
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from concordat.operators import index, retrieval
from concordat.plans.catalog import BM25, query, stored_index
from concordat.sources import office
from concordat.sources.files import workspace
from concordat.sources.views import table
from concordat.streaming import resume


@query("SELECT source, CAST(n_docs AS BIGINT) AS n_docs, ROUND(mean_length, 6) AS mean_length, COUNT(*) AS n_terms, ROUND(AVG(idf), 6) AS mean_idf FROM raw JOIN sizes USING (source) GROUP BY ALL", BM25)
def snk07_stored_index(s, d):
    """What the stored index says of each group."""
    groups = stored_index(s, d).groups
    return groups.select(F.col("group").alias("source"), "n_docs", F.round("mean_length", 6).alias("mean_length"), "n_terms", F.round("mean_idf", 6).alias("mean_idf"))


@query("SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= 30", BM25.replace("FROM documents", "FROM (SELECT doc_id, text, 'all' AS source FROM documents)"))
def src14_global_index(s, d):
    """The first 30 documents of each query by the stored index of the whole corpus, which is one group."""
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = index.search(stored_index(s, d, "everything"), asked).select("query_id", F.col("key").alias("doc_id"), "score")
    return retrieval.top_k(found, ["query_id"], "score", "doc_id", 30)


#: Parents that searches name: some that are there, some that are not, one twice.
NAMED = "SELECT item_id * 7 AS doc_id, item_id FROM {benchmark} UNION ALL SELECT -item_id, item_id FROM {benchmark}"


@query(f"SELECT n.item_id, n.doc_id, d.doc_id IS NOT NULL AS found, d.lang, d.n_chars FROM ({NAMED.format(benchmark='benchmark')}) n LEFT JOIN documents d ON d.doc_id = n.doc_id")
def src15_point_reads(s, d):
    """Parents by their keys from a store of JSON documents, of which the buckets of the keys are read."""
    path = workspace(s, "parents")
    index.put(table(s, d, "documents").select("doc_id", "lang", "n_chars", "text"), path, "doc_id")
    keys = s.sql(NAMED, benchmark=table(s, d, "benchmark"))
    return index.get(s, path, keys, "doc_id", "lang string, n_chars bigint").select("item_id", "doc_id", "found", "lang", "n_chars")


@query("SELECT doc_id, lang, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INT) AS n_words FROM documents")
def snk08_resumed_stream(s, d):
    """Documents worked through as a stream of files that is stopped after two batches and run again to its end."""
    path = workspace(s, "stream")
    table(s, d, "documents").select("doc_id", "lang", "text").repartition(6, "doc_id").write.parquet(f"{path}/in")
    source = s.read.parquet(f"{path}/in")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    for stop in (2, None):
        resume.run(s, f"{path}/in", source.schema, lambda rows: rows.select("doc_id", "lang", words.alias("n_words")), path, "doc_id", files=1, stop_after=stop)
    return resume.results(s, f"{path}/results", "doc_id bigint, lang string, n_words int")


#: Documents as JSON records: some are no JSON, some have no text, and some keys come twice.
RECORDS = """SELECT concat('K', doc_id % 400) AS key, CASE WHEN doc_id % 17 = 0 THEN concat('no json ', lang) WHEN doc_id % 13 = 0 THEN concat('{{"lang": "', lang, '"}}') ELSE concat('{{"text": "', lang, ' ', source, ' ', doc_id, '"}}') END AS document FROM {documents}"""


@query(
    f"SELECT key, substr(document, 11, length(document) - 12) AS text FROM (SELECT key, MAX(document) AS document FROM ({RECORDS.format(documents='documents')}) WHERE starts_with(document, '{{\"text') GROUP BY key)"
)
def snk04_sqlite_export(s, d):
    """The texts of documents by key in SQLite databases, written to the shared folder and read back."""
    path = workspace(s, "sqlite")
    records = s.sql(RECORDS, documents=table(s, d, "documents"))
    office.export_sqlite(records, "key", "document", shards=4).write.parquet(path)
    return office.read_sqlite(s.read.parquet(path))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CAST(c_nationkey AS INT) AS c_nationkey FROM customer")
def src06_stata_scan(s, d):
    """Customers from Stata files, one for each nation and thousand of keys, made in tasks and kept as cells of a table."""
    path = workspace(s, "stata")
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("double")).alias("c_acctbal"), F.col("c_nationkey").cast("int").alias("c_nationkey"))

    def made(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        part.drop(columns="file").assign(c_custkey=part["c_custkey"].astype("float64")).to_stata(out, write_index=False, version=118)
        return pd.DataFrame({"path": [f"{part['file'].iloc[0]}.dta"], "content": [out.getvalue()]})

    keyed = rows.withColumn("file", F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / 1000)))
    keyed.groupBy("file").applyInPandas(made, "path string, content binary").write.parquet(path)
    return office.read_stata(s.read.parquet(path), "c_custkey bigint, c_name string, c_acctbal double, c_nationkey int").drop("path")


def workbook(rows: list[tuple], header: list[str]) -> bytes:
    """A workbook with an empty first sheet and the rows on a second one named data; dates by a style."""
    cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c s="1"><v>{(v - office.EPOCH.date()).days}</v></c>' if isinstance(v, datetime.date) else f"<c><v>{v!r}</v></c>"
    lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [header, *rows])
    main, link = office.MAIN[1:-1], office.LINK[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="first" sheetId="1" r:id="a"/><sheet name="data" sheetId="2" r:id="b"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CAST(o_orderdate AS DATE) AS filed FROM orders")
def src05_excel_scan(s, d):
    """Orders from workbooks of one month each and less, a named sheet and columns by their names."""
    path = workspace(s, "excel")
    rows = table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("filed"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("double")).alias("o_totalprice"), "o_orderpriority", "o_orderkey")

    def made(part: pd.DataFrame) -> pd.DataFrame:
        plain = part.drop(columns="file").astype(object).where(part.drop(columns="file").notna(), None)
        return pd.DataFrame({"path": [f"{part['file'].iloc[0]}.xlsx"], "content": [workbook(list(plain.itertuples(index=False, name=None)), list(plain.columns))]})

    keyed = rows.withColumn("file", F.concat_ws("-", F.date_format("filed", "yyyy-MM"), F.floor(F.col("o_orderkey") / 10000)))
    keyed.groupBy("file").applyInPandas(made, "path string, content binary").write.parquet(path)
    return office.read_excel(s.read.parquet(path), "o_orderkey bigint, o_orderpriority string, o_totalprice double, filed date", "data").drop("path")
