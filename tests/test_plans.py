"""What the plans of large joins and round trips must not do; results are compared with SQL in test_catalog."""

import re

from concordat.plans import catalog, cleaning, files, panel

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_disputed_trade_stays_with_its_case(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(catalog.jon15_disputed_section_trade(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"Exchange hashpartitioning\([^)]*\b(lag|way)#", found)


def test_flows_are_added_up_once_for_all_years(spark, monkeypatch):
    written, write = [], files.files.write_csv
    monkeypatch.setattr(files.files, "write_csv", lambda df, path: (written.append(plan(df)), write(df, path)))
    assert files.src04_file_per_year(spark, SF).count()
    assert len(written) == 5 and not any("Join" in p or "Exchange" in p for p in written)


def test_litigants_are_counted_without_telling_cases_apart_again(spark):
    assert "Expand" not in plan(cleaning.viz04_top_litigants(spark, SF))


def test_first_section_is_a_filter_of_parts(spark):
    assert "EqualTo(p_type," in plan(panel.jon12_semi_join(spark, SF))
