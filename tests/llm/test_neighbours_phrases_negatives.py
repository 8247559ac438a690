"""Nearest neighbours by recall against brute force; collocations and hard negatives against brute force and SQL."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concordat.llm import negatives, neighbours, phrases, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row long, score double, rank int, query string, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, 0.5, 3, "q", "a") for r in rows], VECTORS)


def awkward(rng, n=400, d=6):
    """Vectors in clusters with nulls, zeros, other lengths, copies, repeated and null ids."""
    centres = rng.normal(size=(8, d))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 8] + 0.4 * rng.normal(size=d)], int(rng.integers(0, 4))) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same, i % 4) for i in range(60)]
    rows += [(2000, None, 1), (2100, [0.0] * d, 1), (2200, [1.0, None] + [0.0] * (d - 2), 2), (2300, [math.nan] + [0.5] * (d - 1), 0), (2400, [math.inf] * d, 0), (2500, [], 3)]
    rows += [(2600, [0.5, -0.25], 1), (None, same, 2), (100, rows[5][1], 0), (0, rows[0][1], None), (2700, [2.0] * d, None)]
    return rows


def usable(rows, d, zero=True):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.array(v + [0.0] * (d - len(v))), label))
    return out


def brute_neighbours(rows, d, k, step):
    kept = usable(rows, d, zero=False)
    out = []
    for at, (i, v, _) in enumerate(kept):
        if i is not None and i % step == 0:
            far = sorted((float(np.sqrt(((v - w) ** 2).sum())), j is None, j or 0, b) for b, (j, w, _) in enumerate(kept) if b != at)
            out.append((i, [x[0] for x in far[:k]]))
    return out


def by_query(found, k):
    """Lists of distances of each answered query, whatever rows share its id."""
    out = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(r)
    return out


def test_neighbours_on_awkward_rows(spark):
    rows = awkward(np.random.default_rng(1))
    table = vectors(spark, rows)
    found = neighbours.nearest_neighbours(table.repartition(3), F.col("vec_id") % 50 == 0).collect()
    want = collections.Counter((i, round(d, 6)) for i, far in brute_neighbours(rows, 6, 10, 50) for d in far)
    got = collections.Counter((r["query_id"], round(r["score"], 6)) for r in found)
    assert sum((want & got).values()) >= 0.98 * sum(want.values()) and sum(got.values()) == sum(want.values())
    assert {r["query_id"] for r in found} == {i for i, _ in brute_neighbours(rows, 6, 10, 50)}
    held = collections.defaultdict(list)
    for i, v, _ in usable(rows, 6, zero=False):
        held[i].append(v)
    for r in found[:200]:
        assert any(math.isclose(r["score"], np.sqrt(((a - b) ** 2).sum()), abs_tol=1e-12) for a in held[r["query_id"]] for b in held[r["vec_id"]])
    for answers in by_query(found, 10).values():
        if len(answers) == 10:
            assert [r["rank"] for r in answers] == list(range(1, 11))
            order = [(r["score"], r["vec_id"] is None, r["vec_id"] or 0) for r in answers]
            assert order == sorted(order)


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(i * 100, [float(i), 1.0], 0) for i in range(7)])
    found = by_query(neighbours.nearest_neighbours(few, F.col("vec_id") % 100 == 0).collect(), 10)
    assert all(len(v) == 6 for v in found.values()) and len(found) == 7
    assert [r["vec_id"] for r in found[300]] == [200, 400, 100, 500, 0, 600]
    for empty in (few.limit(0), few.filter("vec_id = 100"), vectors(spark, [(100, None, 1)])):
        assert neighbours.nearest_neighbours(empty, F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.nearest_neighbours(few, F.col("vec_id") < 0).collect() == []


def test_recall_in_many_dimensions(spark):
    """Near uniform directions are the hardest case; the graph and the walk together find nine in ten and more."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x[:1500] = x[0] + 0.01 * rng.normal(size=(1500, 64)).astype(np.float32)  # a third of all rows in one place
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(4000), "embedding": pa.array(list(x))}))
    found = neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect()
    q = np.arange(0, 4000, 100)
    d = ((x[q, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    d[np.arange(40), q] = np.inf
    truth = {int(i): set(map(int, row)) for i, row in zip(q, np.argsort(d, axis=1)[:, :10])}
    assert len(found) == 400
    assert sum(r["vec_id"] in truth[r["query_id"]] for r in found) >= 0.95 * 400


def brute_negatives(rows, d, step, percent=80):
    kept = [(i, np.floor(256 * v).astype(int), label) for i, v, label in usable(rows, d) if label is not None]
    rank = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % step:
            continue
        others = sorted(((-int(v @ w), rank(j), b) for b, (j, w, _) in enumerate(kept) if b != a))
        positives = [x for x in others if kept[x[2]][2] == label][:5]
        for s, _, b in positives:
            window = [x for x in others if kept[x[2]][2] != label and -percent * s <= -100 * x[0] <= -100 * s][:5]
            out += [(i, kept[b][0], k, kept[n][0], -s, -t) for k, (t, _, n) in enumerate(window, 1)]
    return out


@pytest.mark.parametrize("huge", [False, True])
def test_negatives_equal_brute_force(spark, huge):
    rows = awkward(np.random.default_rng(2))
    if huge:  # products beyond what doubles hold exactly, in 64 bits all the same
        rows = [(i, v and [x if x is None or not math.isfinite(x) else float(np.float32(x * 3e5)) for x in v], label) for i, v, label in rows]
    table = vectors(spark, rows).repartition(5)
    found = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(brute_negatives(rows, 6, 50), key=key) and found
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert negatives.hard_negatives(table, F.col("vec_id") < 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (3000, 7))
    centres = negatives.fit_centres(x[:500])
    codes, left = negatives.encode(x, centres)
    for a in x[:20]:
        table = np.einsum("mcp,mp->mc", centres, negatives.parts(a[None])[:, 0])
        near = sum(table[m][codes[m]] for m in range(len(codes)))
        assert (np.abs(near - x @ a) <= np.sqrt((a**2).sum()) * left * (1 + 1e-9) + 1e-6).all()
    assert (negatives.widened(negatives.narrow(x * 1000).tobytes(), *x.shape) == x * 1000).all()


DOCS = "doc_id long, text string, lang string, phrase string, n long, score double"


def brute_collocations(rows, least, share=80, top=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= share * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]  # noqa: E741
    return sorted(out)


def awkward_texts(rng):
    words = ["Aa", "b", "c\x0b", "É", "漢", "don't", "e-f", "x\x1cy", "\x85", "g", "🙂"]
    text = lambda n: "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!"])) for _ in range(n))
    rows = [(i, text(int(rng.integers(0, 60))), [None, "en", "de", "und"][i % 4]) for i in range(80)]
    rows += [(90, None, "en"), (91, "", None), (92, " \t\n", "fr"), (93, "a b " * 4000, "en"), (94, "a b a b a", "en"), (94, "a b a b a", "en"), (None, "b a! b a", None), (95, "a", "es"), (96, "q r s t " * 30, "es")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    if small:  # many shards, long texts cut at the ends of pieces, and cells in which most runs meet
        monkeypatch.setattr(phrases, "shards", lambda batches, f=phrases.shards: f(batches, 700, 200))
        monkeypatch.setattr(phrases, "BITS", 1)
    rows = awkward_texts(np.random.default_rng(5))
    docs = spark.createDataFrame([(*r, "p", 3, 0.5) for r in rows], DOCS).repartition(4)
    for least, top in ((3, 2000), (12, 7)):
        found = phrases.collocations(docs, least=least, top=top).collect()
        assert sorted(map(tuple, found)) == brute_collocations(rows, least, top=top) and found
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_frequent_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(i, "a b c", "en") for i in range(700)], "doc_id long, text string, lang string")
    found = phrases.collocations(docs, least=600).collect()
    assert [tuple(r) for r in found] == [("en", 1, "a b c", 700, 700, 700, 2100, 1000000)]


def test_matches_overlap_and_stop_at_pieces():
    piece = np.array([0, 0, 0, 0, 1, 1, 1])
    symbol = np.array([1, 1, 1, 17, 1, 1, -1])
    pair, triple = np.array([[1, 1], [1, 17], [17, 1]]), np.array([[1, 1, 1]])
    assert [x.tolist() for x in phrases.matches(symbol, piece, [pair, triple])] == [[3, 1, 0], [1]]


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op12_collocations", "op13_hard_negatives"):
        found, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(found.columns)
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.fetchall())
