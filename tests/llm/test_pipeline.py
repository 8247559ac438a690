import collections
import re
import zlib

import numpy as np
import pytest
from test_operations import brute_components, brute_passages, fold

import corpus_pipeline
from concordat.llm import langid, packing, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, removed string, score string, _kept string"
WORDS = [f"wort{i}" for i in range(400)]


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert found.columns == given.columns
        assert 0 < found.count() <= docs.count()
        docs = found
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_near_copies_go_by_row(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (7, a + " end"), (3, c), (3, c + " end"), (3, c + " stop"), (None, d), (None, d + " end"), (9, b + " end"), (None, "alone"), (2, ""), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    found = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).collect()
    by = {x: [r.doc_id for r in found if (r.text or "").startswith(x)] for x in ("a0", "b0", "c0", "d0", "alone")}
    assert by == {"a0": [5], "b0": [5], "c0": [3], "d0": [None], "alone": [None]}
    assert len(found) == 7


def test_near_copies_do_not_depend_on_how_files_are_split(spark, tmp_path, monkeypatch):
    """The same rows stay when the number of cores changes between the search and the join, and from a table that is no file."""
    rows = [(k, " ".join(f"{'x' if k % 3 else 'y'}{k // 3}w{i}" for i in range(40)) + (" end" if k % 3 == 2 else "")) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(20).write.parquet(f"{tmp_path}/docs")
    docs, plain = spark.read.parquet(f"{tmp_path}/docs"), corpus_pipeline.jaccard.similar_documents
    want = sorted(k for k, _ in rows if k % 3 != 2)

    def search(*args):
        found = plain(*args)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        return found

    monkeypatch.setattr(corpus_pipeline.jaccard, "similar_documents", search)
    try:
        for table in (docs, docs.coalesce(1).union(docs.limit(0))):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
            assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, table, SF).collect()) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def a_table(spark, seed=0):
    """Awkward documents: null, empty, blank, very long, repeated rows and ids, near copies, shared lines."""
    rng = np.random.default_rng(seed)
    prose = lambda n: " ".join(rng.choice(WORDS, n)) + "."
    line, base = prose(9), prose(60)
    texts = [prose(int(n)) for n in rng.integers(5, 80, 12)]
    texts += [base, base + " tail", base.upper(), base + " other tail", line + "\n" + prose(30), prose(30) + "\n" + line + "\n" + prose(4)]
    texts += [None, "", " \n\t", "12 ?!", prose(20000), "<|endoftext|> " + prose(3)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, prose(40)), (None, texts[4]), (None, prose(20)), (2, texts[7])]
    table = spark.createDataFrame([(k, t, "de" if k and k % 2 else None, "s", len(t or ""), 5, "r", "x", "y") for k, t in rows], SCHEMA)
    return rows, corpus_pipeline.materialise(table.repartition(3), "awkward")


def of(frame):
    assert frame.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    found = frame.collect()
    assert all((r["row"], r["removed"], r["score"], r["_kept"]) == (5, "r", "x", "y") for r in found)
    return sorted(((r["doc_id"], r["text"]) for r in found), key=repr)


def test_language_stage(spark):
    rows, docs = a_table(spark)
    net = langid.fit(docs)
    want = []
    for k, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        p = langid.document_probabilities(net, data, np.array([0, len(data)]))[0]
        if re.search(r"[^\W\d_]", t or "") and p.max() >= corpus_pipeline.LEAST_SCORE:
            want.append((k, t))
    assert of(corpus_pipeline.language(spark, docs, SF)) == sorted(want, key=repr) and len(want) < len(rows)
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null")
    assert corpus_pipeline.language(spark, unlabelled, SF).count() == unlabelled.count()


def test_exact_stage(spark):
    rows, docs = a_table(spark)
    best = collections.defaultdict(list)
    for k, t in rows:
        best[fold(t)].append(k)
    want = {key: max((k for k in ks if k is not None), default=None) for key, ks in best.items()}
    found = of(corpus_pipeline.exact_copies(spark, docs, SF))
    assert sorted(((k, fold(t)) for k, t in found), key=repr) == sorted(((k, key) for key, k in want.items()), key=repr)


def test_near_stage(spark):
    rows, docs = a_table(spark)
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    groups = collections.defaultdict(list)
    for i, n, component in brute_components(numbered):
        groups[component].append(i)
    found = of(corpus_pipeline.near_copies(spark, docs, SF))
    assert len(found) == len(groups)
    least = lambda ids: min(ids, key=lambda k: (k is None, k))
    assert collections.Counter(k for k, _ in found) == collections.Counter(least([rows[i][0] for i in g]) for g in groups.values())


def test_passage_stage(spark):
    rows, docs = a_table(spark)
    unlike = [x for i, x in enumerate(rows) if x[0] not in {k for k, _ in rows[:i]}]
    texts = dict(unlike)
    want = {}
    for k, t in unlike:
        at, left = 0, ""
        for _, a, b, *_ in sorted((x for x in brute_passages(unlike) if x[0] == k), key=lambda x: x[1]):
            left, at = left + t[at:a], b
        want[k] = None if t is None else left + t[at:]
    table = spark.createDataFrame([(k, t, None, "s", len(t or ""), 5, "r", "x", "y") for k, t in unlike], SCHEMA)
    out = corpus_pipeline.repeated_passages(spark, table, SF)
    assert of(out) == sorted(want.items(), key=repr) and any(want[k] != t for k, t in texts.items())
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def test_packing_stage(spark):
    from tokenizers import Tokenizer

    rows, docs = a_table(spark)
    plain = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    want = collections.Counter()
    for k, t in rows:
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [2], 0
        for n in packing.decompose(len(ids)):
            want[k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
    found = corpus_pipeline.packed(spark, docs, SF).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_the_shared_folder_has_to_be_named_on_a_cluster():
    from concordat.llm import stage

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        stage.shared_dir(Session)
