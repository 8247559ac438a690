import datetime

import numpy as np

from concordat.operators import disputes, documents, frames, stats


def test_file_parts(spark):
    names = ["135-2.pdf", "135-2A1.pdf", "135R.pdf", "135R-00.pdf", "135ABR.pdf", "135RW.pdf", "135ARB.pdf", "D15.pdf", "x.pdf"]
    found = spark.createDataFrame([(n,) for n in names], "name string").select("name", documents.file_parts("name").alias("p")).collect()
    assert {r["name"]: (r["p"]["case_no"], r["p"]["kind"], r["p"]["number"], r["p"]["variant"], r["p"]["part"]) for r in found} == {
        "135-2.pdf": (135, "numbered", 2, None, None),
        "135-2A1.pdf": (135, "numbered", 2, "A", 1),
        "135R.pdf": (135, "report", None, None, None),
        "135R-00.pdf": (135, "report", None, None, 0),
        "135ABR.pdf": (135, "appeal_report", None, None, None),
        "135RW.pdf": (135, "compliance_report", None, None, None),
        "135ARB.pdf": (135, "arbitration", None, None, None),
        "D15.pdf": (15, "decision", None, None, None),
        "x.pdf": (None, "other", None, None, None),
    }


def test_dates_parties_and_codes(spark):
    df = spark.createDataFrame(
        [("on 7 November 1996 at", "A; B ;", "72.08", "07-Nov-96"), ("le 1er août 2003", "['A', 'B']", "HS 87", "07-Nov-05"), ("7 de marzo de 2001", "", "nan", None)],
        "t string, p string, c string, d string",
    )
    found = df.select(documents.text_date("t").alias("t"), documents.parties("p").alias("p"), documents.section_of_code("c").alias("c"), disputes.two_digit_date("d").alias("d")).collect()
    assert [r.t for r in found] == [datetime.date(1996, 11, 7), datetime.date(2003, 8, 1), datetime.date(2001, 3, 7)]
    assert [r.p for r in found] == [["A", "B"], ["A", "B"], []]
    assert [r.c for r in found] == [15, 17, None]
    assert [r.d for r in found] == [datetime.date(1996, 11, 7), datetime.date(2005, 11, 7), None]


def test_null_aware_helpers(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "k string, v double")
    assert df.filter(frames.not_in("k", ["a"])).count() == 2
    assert {r.z for r in df.select(frames.zscore("v", ["k"]).alias("z")).collect()} == {0.0, None}


def test_logit_and_clusters():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [0.5, -1.0])))).astype(float)
    beta = stats.logit(x, y)
    assert np.allclose(beta, [0.5, -1.0], atol=0.15)
    assert (np.diag(stats.cluster_covariance(x, y, beta, rng.integers(0, 50, 4000))) > 0).all()


def test_routed_chunks(spark):
    long = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(140))
    rows = spark.createDataFrame([(1, "a b\nc"), (2, long), (3, None), (4, " \n ")], "doc_id long, text string")
    found = documents.routed_chunks(rows).collect()
    assert [tuple(r) for r in found if r.doc_id == 1] == [(1, "1_full", "1_full", False, 0, 3, "a b\nc")]
    cut = sorted((r for r in found if r.doc_id == 2), key=lambda r: r.chunk_index)
    assert {r.doc_id for r in found} == {1, 2} and len(cut) > 20 and all(r.is_chunked and len(r.chunk) <= 1200 for r in cut)
    parents = documents.chunk_spans(long, 6000, 800)
    at = 0
    for r in cut:
        at = long.index(r.chunk, at)
        first = next((k for k, (a, b) in enumerate(parents) if a <= at < b), len(parents) - 1)
        assert r.parent_id == f"2_parent_{first:03d}"


def test_long_texts_go_to_python_in_small_batches(spark):
    from concordat.operators import cleaning, documents, pages

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.createDataFrame([(1, "a b", "<p>x</p>")], "doc_id long, text string, html string")
    before = spark.conf.get(key)
    try:
        for use in (documents.chunks, lambda df: cleaning.clean_steps(df, "text"), pages.case_titles, pages.case_records):
            spark.conf.set(key, "10000")
            use(rows)
            assert int(spark.conf.get(key)) <= 256
    finally:
        spark.conf.set(key, before)
