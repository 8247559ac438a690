"""Stored indexes and stores read no more than they have to; streams go on where they stopped; types and authors of odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from concordat.operators import cascades, doctypes, index
from concordat.streaming import resume


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"g{k % 2}", " ".join(f"w{j}" for j in range(k % 7, 60, 3))) for k in range(40)] + [(40, "g0", None), (41, "g1", " ")], "doc int, grp string, text string")
    index.write_index(docs, f"{tmp_path}/i", "doc", "grp", buckets=16)
    held = index.open_index(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "w3 w3 nothing"), (2, "nothing")], "query_id int, text string")
    found = index.search(held, asked)
    wanted = {r.bucket for r in index.asked_terms(asked, 16).select("bucket").distinct().collect()}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and len(wanted) < 16
    read = {int(m) for f in held.postings.filter(F.col("bucket").isin(*wanted)).inputFiles() for m in re.findall(r"bucket=(\d+)", f)}
    assert {r.query_id for r in found.collect()} == {1} and wanted <= {int(m) for f in held.postings.inputFiles() for m in re.findall(r"bucket=(\d+)", f)} | wanted and read
    assert {(r["group"], r.n_docs) for r in held.groups.collect()} == {("g0", 21), ("g1", 21)}
    assert index.search(held, asked.limit(0)).count() == 0


def test_documents_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}" if k % 3 else None, k / 2) for k in range(50)], "id long, t string, x double")
    index.put(rows, f"{tmp_path}/kv", "id", buckets=8)
    keys = spark.createDataFrame([(3, "a"), (4, "b"), (99, "c"), (4, "d"), (None, "e")], "id long, why string")
    found = sorted(map(tuple, index.get(spark, f"{tmp_path}/kv", keys, "id", "t string, x double", buckets=8).collect()), key=lambda r: r[1])
    assert found == [(3, "a", True, None, 1.5), (4, "b", True, "t4", 2.0), (99, "c", False, None, None), (4, "d", True, "t4", 2.0), (None, "e", False, None, None)]


def test_stream_goes_on(spark, tmp_path):
    schema = "id int, v string"
    given = f"{tmp_path}/in"
    for k in range(4):
        spark.createDataFrame([(k, "a"), (k + 1, f"b{k}")], schema).coalesce(1).write.mode("append").parquet(given)
    kind = spark.read.parquet(given).schema
    seen = []

    def work(rows):
        seen.extend(r.id for r in rows.collect())
        return rows.select("id", F.upper("v").alias("v"))

    path = f"{tmp_path}/out"
    assert resume.run(spark, given, kind, work, path, "id", stop_after=1) == 1
    first = sorted(map(tuple, resume.results(spark, f"{path}/results", schema).collect()))
    assert len(first) == 2
    assert resume.run(spark, given, kind, work, path, "id") == 3
    done = resume.results(spark, f"{path}/results", schema).collect()
    assert sorted(r.id for r in done) == [0, 1, 2, 3, 4] and set(map(tuple, done)) >= set(first)  # each key once, earlier results stay
    assert resume.run(spark, given, kind, work, path, "id") == 0 and len(seen) == 5
    assert resume.results(spark, f"{tmp_path}/none", schema).count() == 0


def test_work_that_fails_is_tried_again(spark, tmp_path):
    given, path = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(3).coalesce(1).write.parquet(given)

    def broken(rows):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        resume.run(spark, given, spark.range(1).schema, broken, path, "id")
    assert resume.run(spark, given, spark.range(1).schema, lambda rows: rows, path, "id") == 1
    assert resume.results(spark, f"{path}/results", "id long").count() == 3


def test_types_of_odd_texts(spark):
    rows = [
        (None, "UNKNOWN", ""),
        ("", "UNKNOWN", ""),
        ("LAND – GOODS\nWORKING PROCEDURES\nrest\nThe following", "Working_Procedures", "WORKING PROCEDURES"),  # the title runs on, so the whole head is searched
        ("Report of  the\tPanel", "Report_Of_Panel", "Report of  the\tPanel"),
        ("a panel report and an appellate body report", "Report_Of_Appellate_Body", "a panel report and an appellate body report"),
        ("x" * 1195 + " addendum", "Addendum", "x" * 1195 + " addendum"),
        ("1. Body\n" + "y " * 596 + "addendum", "UNKNOWN", ""),
        ("LAND – GOODS\n" + "\n" * 15 + "Addendum", "Addendum", "Addendum"),
        ("odd \x01 sign, statement by Land", "Statement", "odd \x01 sign, statement by Land"),
    ]
    table = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(rows)], "k int, text string")
    found = [tuple(r)[1:] for r in doctypes.with_doc_type(table, "text").select("k", "doc_type", "doc_type_raw").orderBy("k").collect()]
    expected = [r[1:] for r in rows]
    expected[2] = ("Working_Procedures", "rest")
    assert found[0] == expected[0] and found[1] == expected[1] and [f[0] for f in found] == [e[0] for e in expected]
    assert found[3][1] == expected[3][1] and found[6] == expected[6] and found[7] == expected[7] and found[8] == expected[8]


def test_authors_and_sections_of_odd_rows(spark):
    rows = [(1, None, None, None, None, None, None), (2, "Communication", "from ab", "by x", ["A"], [], None), (3, "Understanding", None, None, ["A", "B"], ["C"], []), (4, "Request_For_Consultations", None, None, [], [], [])]
    table = spark.createDataFrame(rows, "k int, t string, raw string, text string, c array<string>, r array<string>, o array<string>")
    found = {r.k: (r.author, r.author_name, r.author_confidence, r.author_stage) for r in cascades.with_author(table, "t", "raw", "text", "c", "r", "o", {}).collect()}
    assert found == {1: ("unknown", "Unknown", "low", "external"), 2: ("unknown", "Unknown", "low", "external"), 3: ("joint", "A, B & C", "high", "rule"), 4: ("complainant", "Complainant", "high", "rule")}
    codes = spark.createDataFrame([(1, "0101|xx| 9701", None, None), (2, "9801", [30], None), (3, None, None, [2, 1, 2])], "k int, codes string, f array<int>, t array<int>")
    got = {r.k: (r.sections, r.case_type, r.method, r.confidence) for r in cascades.with_sections(codes.withColumn("p", F.lit("product")), "codes", "f", "p", "t", "p").collect()}
    every = "|".join(map(str, range(1, 22)))
    assert got == {1: ("1|21", "product", "explicit_hs", "high"), 2: (every, "product", "model", "medium"), 3: ("1|2", "product", "title_fallback", "low")}


def test_scores_are_added_up_where_the_document_is(spark, tmp_path):
    docs = spark.createDataFrame([(k, "g", f"a b{k % 3}") for k in range(20)], "doc_id long, source string, text string")
    index.write_index(docs, str(tmp_path / "index"), "doc_id", "source")
    found = index.search(index.open_index(spark, str(tmp_path / "index")), spark.createDataFrame([(1, "a b1"), (2, "b2")], "query_id long, text string"))
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20 + 6


def test_index_has_few_files_whatever_the_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"g{k % 2}", " ".join(f"w{k}x{j}" for j in range(60))) for k in range(60)], "doc int, grp string, text string")
    keys = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        index.write_index(docs, f"{tmp_path}/i", "doc", "grp", buckets=2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    held = index.open_index(spark, f"{tmp_path}/i")
    for part in ("terms", "postings"):
        assert len(spark.read.parquet(f"{tmp_path}/i/{part}").inputFiles()) <= 2 * index.SLICES
    assert held.postings.count() == held.terms.count() == 3600


def test_index_of_odd_rows(spark, tmp_path):
    once = [(1, "g", "a\x0bb\x0c\ra\x1ca  "), (2, "g", "a\xa0a a"), (3, "g", None), (4, "g", " \n"), (5, "h", ""), (2, None, "a"), (None, "g", "é é")]
    more = [(2, "g", " b a"), (2, "g", "a"), (None, "g", "é a")]
    known = {("g", 1, 3, "a", 1), ("g", 1, 3, "b", 1), ("g", 1, 3, "a\x1ca", 1), ("g", 2, 2, "a\xa0a", 1), ("g", 2, 2, "a", 1), (None, 2, 1, "a", 1), ("g", None, 2, "é", 2)}
    added = known - {("g", 2, 2, "a", 1), ("g", None, 2, "é", 2)} | {("g", 2, 2, "a", 2), ("g", 2, 2, "b", 1), ("g", 2, 1, "a", 1), ("g", None, 2, "é", 3), ("g", None, 2, "a", 1)}
    for name, rows, postings, n in (("once", once, known, 5), ("more", once + more, added, 8)):
        index.write_index(spark.createDataFrame(rows, "doc int, grp string, text string"), f"{tmp_path}/{name}", "doc", "grp")
        held = index.open_index(spark, f"{tmp_path}/{name}")
        found = held.postings.select("group", "key", "length", "term", "tf").collect()
        assert set(map(tuple, found)) == postings and len(found) == len(postings)
        assert {(r["group"], r.n_docs) for r in held.groups.collect()} == {("g", n), (None, 1), ("h", 1)}


def test_first_rule_of_any_text(spark):
    import random

    words = sorted({w for p, _ in doctypes.RULES for w in re.findall("[a-z]+", p.replace("\\s", " "))} | {"replies", "21.5", "21.3", "22.6", "\x01", "an", "utopia"})
    rng = random.Random(5)
    texts = [" ".join(rng.choice((str.upper, str.title, str))(w) for w in rng.choices(words, k=rng.randint(2, 60))) for _ in range(300)] + ["panel\x01report", "panel report", "Key status report"]
    table = spark.createDataFrame([(k, f"{t}\n") for k, t in enumerate(texts)], "k int, text string")
    typed = doctypes.with_doc_type(table, "text")
    found = {r.k: r.doc_type for r in typed.collect()}
    first = lambda t: next((name for p, name in doctypes.RULES if re.search(p, t.replace(" ", " "), re.I | re.S | re.A)), "UNKNOWN")
    assert [found[k] for k in range(len(texts))] == [first(t) for t in texts]
    assert "(?=" not in typed._jdf.queryExecution().optimizedPlan().toString()
