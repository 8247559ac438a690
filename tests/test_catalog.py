"""Every query of the catalog equals its SQL on the smallest tables; those without SQL keep their invariants."""

import duckdb
import pandas as pd
import pytest

from concordat.plans import catalog, cleaning, files, labels, panel, strings  # noqa: F401  all register their queries
from concordat.sources.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return "~"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_louvain_partitions_the_nodes(spark):
    found = catalog.grf08_louvain(spark, SF).toPandas()
    assert not found.duplicated(["year", "v"]).any()
    assert (found["modularity"] >= 0).all()


def test_betweenness_of_a_path(spark):
    from concordat.operators import network

    pairs = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 1.0)], "year int, x int, y int, w double")
    found = {r.v: r.betweenness for r in network.betweenness(pairs).collect()}
    assert found == {1: 0.0, 2: 0.666667, 3: 0.666667, 4: 0.0}


def test_eigenvector_of_a_star_and_of_two_parts(spark):
    from concordat.operators import network

    star, parts = [(1, 0, k, 2.0) for k in range(1, 5)], [(2, 1, 2, 1.0), (2, 3, 4, 1.0), (3, 1, 2, 1.0), (3, 2, 3, 1.0), (3, 8, 9, 1.0)]
    pairs = spark.createDataFrame(star + parts, "year int, x int, y int, w double")
    found = {(r.year, r.v): r.eigenvector for r in network.eigenvector(pairs).collect()}
    assert found == {
        **{(1, k): 0.353553 for k in range(1, 5)}, (1, 0): 0.707107, **{(2, k): 0.5 for k in range(1, 5)},
        (3, 1): 0.5, (3, 2): 0.707107, (3, 3): 0.5, (3, 8): 0.0, (3, 9): 0.0,
    }


def test_every_triad_has_its_type(spark):
    from collections import Counter

    from concordat.operators import network

    ways = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))
    codes = Counter(network.triad_type(c) for c in range(64))
    assert [codes[x] for x in network.TRIADS] == [1, 6, 3, 3, 3, 6, 6, 6, 6, 2, 3, 3, 3, 6, 6, 1]
    arcs = spark.createDataFrame([(c, 7 - a, 7 - b) for c in range(64) for bit, (a, b) in enumerate(ways) if c >> bit & 1], "year int, a int, b int")
    nodes = spark.createDataFrame([(c, v) for c in range(64) for v in (5, 6, 7)], "year int, v int")
    found = network.triad_census(arcs, nodes).filter("n <> 0").collect()
    assert {r.year: (r.triad, r.n) for r in found} == {c: (network.triad_type(c), 1) for c in range(64)} and len(found) == 64
    known = {"021D": ((1, 0), (1, 2)), "021U": ((0, 1), (2, 1)), "111D": ((0, 1), (1, 0), (2, 1)), "111U": ((0, 1), (1, 0), (1, 2)), "120D": ((1, 0), (1, 2), (0, 2), (2, 0)), "120U": ((0, 1), (2, 1), (0, 2), (2, 0))}
    assert {name: network.triad_type(sum(1 << ways.index(w) for w in arcs)) for name, arcs in known.items()} == {name: name for name in known}


def test_chunks_cover_texts():
    from concordat.operators.documents import chunk_spans

    for text in ("", "a" * 50, "one two. three\n\nfour five\nsix " * 20, "x" * 500 + " y"):
        spans = chunk_spans(text, 40, 10)
        assert all(0 <= a < b <= len(text) and b - a <= 40 for a, b in spans)
        covered = {i for a, b in spans for i in range(a, b)}
        assert covered == set(range(len(text)))


def test_nearest_vectors_go_in_blocks(spark):
    import numpy as np

    from concordat.operators import retrieval

    x = np.random.default_rng(5).normal(size=(130, 8)).round(1)
    x[90:] = x[7]
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (500, None), (501, [0.0] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<float>").repartition(3)
    asked = table.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    x = x.astype(np.float32).astype(float)
    cosine = (x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]).round(6)
    want = {(q, v, r + 1): cosine[q, v] for q in range(0, 130, 20) for r, v in enumerate(sorted(set(range(130)) - {q}, key=lambda v: (-cosine[q, v], v))[:10])}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (7, 1000):
            near = retrieval.cosine_top_k(table, asked, 10, rows=rows)
            assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
            found = {(r.query_id, r.vec_id, r["rank"]): r.cosine for r in near.collect()}
            assert {k for k in found if k[0] != 500} == set(want) and all(abs(found[k] - want[k]) < 2e-6 for k in want)
            assert [k[1] for k in found if k[0] == 500] == list(range(10)) and all(found[k] is None for k in found if k[0] == 500)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
