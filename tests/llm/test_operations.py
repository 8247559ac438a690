"""Each operation against brute force, an exact round trip or held-out accuracy, and on awkward tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import bpe, exact, jaccard, langid, lines, lm, packing, telephony, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, _row long, score string, digest string, _keep string"
LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(30000))
PASSAGE = " ".join(f"unusual{i} passage{i}" for i in range(40))
ROWS = [
    (1, "The cat sat on the mat and looked at the very old dog that slept near the warm fire", "en", "a"),
    (2, "the CAT sat on the mat and looked at the very old dog that slept near the warm fire", "en", "a"),
    (3, None, None, "a"),
    (4, "", "en", None),
    (4, "", "en", None),
    (5, " \t\n ", "en", "b"),
    (6, LONG, "en", "b"),
    (7, LONG + " tail", "en", "b"),
    (8, "some words before " + PASSAGE + " and after it", "en", "b"),
    (9, "Ganz andere Wörter vorher " + PASSAGE + " und später noch mehr", "de", "b"),
    (10, "?!? 12 ... ###", None, "c"),
    (11, "É́ñ漢字 🙂 don't 'll x\x1cy\x85z  two  blanks ", "fr", "c"),
    (12, "one two", "en", "c"),
    (12, "One two", "en", "c"),
    (None, "a row without an id has text all the same", "en", "c"),
    (13, "a" * 3000, "en", "c"),
]
FOLD = {i: i + 32 for i in range(65, 91)}


def fold(text):
    return (text or "").translate(FOLD)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "s", "d", "k") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs, empty):
    assert exact.exact_duplicates(empty).count() == 0
    found = exact.exact_duplicates(docs).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[fold(r[1])].append(r[0])
    assert len(found) == len(ROWS)
    for r in found:
        ids = groups[fold(r["text"])]
        assert (r["_group_size"], r["_keep_id"]) == (len(ids), max((i for i in ids if i is not None), default=None))
        assert bytes(r["_digest"]) == hashlib.sha256(fold(r["text"]).encode()).digest()
    assert sum(r["_kept"] for r in found) == len(groups)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and {r["_row"] for r in kept.collect()} == {7}


def test_exact_duplicates_with_clashing_columns(spark):
    names = ["doc_id", "text", "_salt", "_keep", "_maybe", "_row"]
    table = spark.createDataFrame([(1, "a", 1, 2, 3, 4), (2, "A", 5, 6, 7, 8)], "a long, b string, c int, d int, e int, f int").toDF(*names)
    found = sorted(exact.exact_duplicates(table).collect())
    assert [tuple(r)[:6] for r in found] == [(1, "a", 1, 2, 3, 4), (2, "A", 5, 6, 7, 8)] and [r["_kept"] for r in found] == [False, True]


def test_bloom_filter_that_is_full_changes_nothing(docs):
    a, b = ({(r["text"], r["_keep_id"], r["_group_size"]) for r in exact.exact_duplicates(docs, max_bits=bits).collect()} for bits in (64, 1 << 26))
    assert a == b


def brute_components(rows):
    sets = []
    for r in rows:
        w = word_list(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    out = [(r[0], len(s), min((x for x in least[find(i)] if x is not None), default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]
    return sorted(out, key=repr)


def test_similar_documents(docs, empty):
    assert jaccard.similar_documents(empty).count() == 0
    assert sorted((tuple(r) for r in jaccard.similar_documents(docs).collect()), key=repr) == brute_components(ROWS)


def test_similar_documents_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            words[at] = f"n{k}_{at}"
        rows.append((k, " ".join(words)))
    found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_components(rows)


def a_block(rng, n=150, major=True):
    points = rng.poisson(1.5, (n, 16))
    points[n // 2 :] = points[: n // 2] + (rng.random((n // 2, 16)) < 0.1)
    comp = rng.integers(0, 40, n)
    columns = {"set": np.arange(n), "size": points.sum(axis=1), "pos": rng.integers(0, 3, n), "comp": comp, "major": comp == 3, "role": np.full(n, 3)}
    return jaccard.Block(columns), points


def bound_pairs(b, points):
    want = set()
    for y in range(len(b.name)):
        for x in range(y):
            n, m = b.size[x], b.size[y]
            fits = 100 * min(n, m) >= 75 * max(n, m) and 175 * min(n - b.pos[x], m - b.pos[y]) >= 75 * (n + m)
            if b.comp[x] != b.comp[y] and fits and 175 * np.minimum(points[x], points[y]).sum() >= 75 * (n + m):
                want.add((x, y))
    return want


def test_tree_finds_all_pairs_of_the_bound():
    b, points = a_block(np.random.default_rng(2))
    got = list(zip(*(v.tolist() for v in jaccard.all_pairs(b, points, np.arange(150)))))
    assert len(got) == len(set(got)) and set(got) == bound_pairs(b, points)


def test_tree_with_roles():
    b, points = a_block(np.random.default_rng(3))
    b.role = np.random.default_rng(4).integers(1, 4, 150)
    b.major &= b.role == 1
    got = list(zip(*(v.tolist() for v in jaccard.all_pairs(b, points, np.arange(150)))))
    met = lambda x, y: bool((b.role[x] & 1 and b.role[y] & 2) or (b.role[y] & 1 and b.role[x] & 2 and b.major[y]))
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x, y in bound_pairs(b, points) if met(x, y)}


def test_each_row_with_a_partner_gets_one():
    b, points = a_block(np.random.default_rng(5))
    want = bound_pairs(b, points)
    got = list(zip(*(v.tolist() for v in jaccard.least_partners(b, points, np.arange(150)))))
    assert set(got) <= want and {y for _, y in got} | {x for x, _ in got} == {z for p in want for z in p}
    got = set(zip(*(v.tolist() for v in jaccard.best_partners(b, points, np.arange(150)))))
    share = lambda x, y: np.minimum(points[x], points[y]).sum() / (b.size[x] + b.size[y])
    for z in {z for p in want for z in p if not b.major[z]}:
        assert max((share(*p) for p in got if z in p)) == max(share(*p) for p in want if z in p)
    assert got <= want


def test_finer_points_bound_the_overlap():
    rng = np.random.default_rng(6)
    for n, m, k in ((3, 4, 2), (300, 280, 250), (200, 900, 100), (3000, 2900, 2500)):
        tokens = rng.integers(0, 1 << 63, n + m - k).astype(np.uint64)
        a, b = tokens[:n], tokens[n - k :]
        bound = jaccard.fine_bound(jaccard.fine_point(a), jaccard.fine_point(b))
        assert k <= bound <= min(n, m)
    assert jaccard.fine_point(np.zeros(300, np.uint64))[0] == 1


@pytest.mark.parametrize("hot", [3, 40])
def test_large_blocks_go_to_several_trees(spark, monkeypatch, hot):
    """Small limits, so that parts, pivots, lines and columns all occur."""
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(80)]
        for k in range(60):
            words = list(base)
            for at in rng.choice(80, rng.integers(0, 6), replace=False):
                words[at] = f"n{g}_{k}_{at}"
            rows.append((100 * g + k, " ".join(words)))
    found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_components(rows)


def test_repeated_passages(docs, empty):
    assert lines.repeated_passages(empty).count() == 0
    found = [r for r in lines.repeated_passages(docs).collect() if r["doc_id"] == 9]
    text = dict((r[0], r[1]) for r in ROWS)[9]
    assert len(found) == 1 and found[0]["keep_doc_id"] == 8
    assert len(text[found[0]["start"] : found[0]["end"]].split()) == found[0]["n_words"] >= 60
    assert text[found[0]["start"] : found[0]["end"]] in PASSAGE
    cut = {r["doc_id"]: r for r in lines.remove_passages(docs).collect() if r["doc_id"] in (1, 8, 9, 12)}
    assert cut[8]["text"] == ROWS[8][1] and cut[8]["removed"] is None
    assert cut[9]["text"] == text[: found[0]["start"]] + text[found[0]["end"] :]
    assert lines.remove_passages(docs).count() == len(ROWS)


def brute_passages(rows, size=25):
    """(doc_id, start, end, n_words, keep_doc_id, copies) of rows with unlike ids, window by window and line by line."""
    spots = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    where, units = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0])):
        for at in range(len(spots[r]) - size + 1):
            where[tuple(fold(rows[r][1][a:b]) for a, b in spots[r][at : at + size])].append((r, at))
        done = 0
        for line in (rows[r][1] or "").split("\n"):
            if ws := word_list(line):
                units[tuple(ws)].append((r, done, done + len(ws)))
                done += len(ws)
    gone = collections.defaultdict(list)
    for places in where.values():
        for r, at in places[1:]:
            first, begin = places[0]
            gone[r].append((max(at, begin + size) if r == first else at, at + size, rows[first][0], len(places)))
    for places in units.values():
        for r, at, end in places[1:]:
            gone[r].append((at, end, rows[places[0][0]][0], len(places)))
    out = []
    for r, parts in gone.items():
        runs = []
        for a, b, keep, n in sorted(parts, key=lambda x: x[:2]):
            if runs and a <= runs[-1][1]:
                a, b, keep, n = runs[-1][0], max(b, runs[-1][1]), min((k for k in (keep, runs[-1][2]) if k is not None), default=None), max(n, runs[-1][3])
                runs.pop()
            runs.append((a, b, keep, n))
        out += [(rows[r][0], spots[r][a][0], spots[r][b - 1][1], b - a, keep, n) for a, b, keep, n in runs]
    return sorted(out, key=repr)


def test_lines_and_paragraphs(spark):
    text = ["One  two\nThree.\n \nfour five\nsix", "zero\none\ttwo\nFour\nfive six\n\none two", "\n\nfour five six\n\nOne two three.", "four\nfive\nsix\n\n\nx", None, "", "\n \n"]
    table = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    gone = lambda gap: sorted((r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]]) for r in lines.repeated_passages(table, gap=gap).collect())
    assert gone(lines.LINE) == [(1, "one\ttwo"), (1, "one two"), (3, "four"), (3, "six")]
    assert gone(lines.PARAGRAPH) == [(2, "four five six\n\nOne two three."), (3, "four\nfive\nsix")]  # neighbours are one


def test_passages_with_clashing_columns(spark):
    rows = [(k, "a line that is there twice\nand one of its own " + str(k), k, "r", "p", "m", None) for k in range(3)] + [(1, None, 1, "r", "p", "m", None)]
    names = ["doc_id", "text", "row", "_row", "_passages", "the `odd`  name", "removed"]
    table = spark.createDataFrame(rows, "doc_id long, text string, a long, b string, c string, d string, e string").toDF(*names)
    found = lines.remove_passages(table)
    assert sorted(found.columns) == sorted(names)
    assert sorted((r["doc_id"], r["text"], r["row"], r["_row"]) for r in found.filter("text is not null").collect()) == [(k, ("a line that is there twice" if k == 0 else "") + f"\nand one of its own {k}", k, "r") for k in range(3)]
    assert found.filter("text is null").count() == 1


def test_whole_passages_go(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"z{x}" for x in rng.integers(0, 1 << 40, n)]
    wrapped = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    rows, want = [], {}
    for k in range(160):
        passage = fresh(51 + k % 10)
        rows.append((k, wrapped(fresh(k % 13) + passage + fresh(9), 12)))
        text = " ".join(fresh(k % 17)) + "\n\n" * (k % 2) + " é "
        copy = (" ".join(passage), wrapped(passage, 7).upper())[k % 3 == 0]
        rows.append((1000 + k, text + copy + " " + " ".join(fresh(5))))
        want[1000 + k] = (len(text), len(text) + len(copy), len(passage), k, 2)
    found = {r["doc_id"]: (r["start"], r["end"], r["n_words"], r["keep_doc_id"], r["copies"]) for r in lines.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    few, many = [f"Wört{i}" for i in range(3)], [f"u{i}" for i in range(5000)]
    parts = [list(rng.choice(many, n)) for n in (24, 25, 26, 40, 70)] + [["again"] * 70, list(rng.choice(few, 30)), few * 20]
    rows = []
    for k in [*range(50), None]:
        words = sum((list(rng.choice(many, rng.integers(0, 12))) + parts[rng.integers(0, len(parts))][rng.integers(0, 9) :] for _ in range(rng.integers(0, 7))), [])
        rows.append((k, "".join(w + " \n"[int(rng.random() < 0.1)] for w in words)))
    table = spark.createDataFrame(rows + [(90, None), (91, "")], "doc_id long, text string")
    want = brute_passages(rows)
    assert len(want) > 60
    for cut, bits in ((lines.CUT, lines.MAX_BITS), (1, 64)):  # a full filter changes nothing
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lines, "MAX_BITS", bits)
            assert sorted((tuple(r)[1:] for r in lines.repeated_passages(table, cut=cut).collect()), key=repr) == want
    texts = dict(rows)
    assert any(n < 5 for _, _, _, n, _, _ in want)  # short lines go as well
    for r in lines.remove_passages(table).filter("removed is not null").collect():
        at, left = 0, ""
        for _, a, b, *_ in sorted((x for x in want if x[0] == r["doc_id"]), key=lambda x: x[1]):
            left, at = left + texts[r["doc_id"]][at:a], b
        assert r["text"] == left + texts[r["doc_id"]][at:]


def test_packing(docs, empty, spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    assert packing.pack(empty, path).count() == 0
    odd = [(50, "a<|endoftext|>B <|ENDOFTEXT|> c."), (51, "<|StartOfText|>"), (52, "no <| special |>"), (53, "<|startoftext|>")]
    for r in packing.pack(spark.createDataFrame(odd, "doc_id long, text string"), path).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p")).collect():
        assert [i for p in r["p"] for i in p["ids"]] == plain.encode(dict(odd)[r["doc_id"]], add_special_tokens=False).ids + [2]
    repeated = collections.Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in packing.pack(docs.filter("doc_id in (4, 12)"), path).collect())
    assert repeated[4, 0, (2,)] == 2 and sum(n for (i, start, _), n in repeated.items() if i == 12 and start == 0) == 2
    found = packing.pack(docs.filter("doc_id is null or doc_id not in (4, 12)"), path).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    for doc_id, text, *_ in ROWS:
        if doc_id in (4, 12):
            continue
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[doc_id], key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == ids
        assert all(r["length"] == len(r["ids"]) <= 4096 and r["length"] & (r["length"] - 1) == 0 and r["doc_tokens"] == len(ids) for r in pieces)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces)
    assert len({r["sequence_id"] for r in found}) == len(found)


def test_packing_after_every_letter():
    """A letter whose lower case or composed form ends in a mark joins the punctuation after it."""
    from tokenizers import Tokenizer

    path = packing.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(128, 0x20000) if chr(c).isalpha() and not 0x4E00 <= c < 0xD7A4]
    texts = [f"{a}{c}{b} x" for c in letters for a, b in (("x", "."), ("", "!?"))] + ["A\u0130. x", "e\u0301. x", "\u0927\u093c, \u0928"]
    for at in range(0, len(texts), 4096):
        part = texts[at : at + 4096]
        want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(part, add_special_tokens=False)]
        assert [t for t, a, b in zip(part, packing.encode_texts([t.encode() for t in part], path), want) if a != b] == []


def test_buckets_hold_one_length(docs, spark, tmp_path):
    pieces = packing.pack(docs, packing.vocabulary("word_bpe_49k.json"))
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    for length in (1, 16, 4096):
        found = packing.read_bucket(spark, f"{tmp_path}/buckets", length)
        assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()
        assert sorted(r["ids_crc32"] for r in found.collect()) == sorted(r["ids_crc32"] for r in pieces.collect() if r["length"] == length)


def test_byte_bpe(docs, empty):
    import tiktoken

    path, pattern = packing.vocabulary("byte_bpe_multi_50k.tiktoken"), packing.split_pattern()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    assert bpe.encode_decode(empty, path, pattern).count() == 0
    found = sorted((repr(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs, path, pattern).collect())
    assert found == sorted((repr(r[0]), own.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in ROWS)


def test_decoding_starts_from_ids(monkeypatch):
    path, pattern = packing.vocabulary("byte_bpe_multi_50k.tiktoken"), packing.split_pattern()
    codec = bpe.Codec(path, pattern)
    (ids, _), = codec.encode_decode(["hello there"])
    codec._units.now["hello"] = [np.array([1], "<u4").tobytes()]
    assert codec.encode_decode(["hello there"])[0][1] == [k for k, v in codec.ranks.items() if v == 1][0] + b" there"
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    long = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 900))), "ab" * 900, "x" * 1025, "".join(map(chr, rng.integers(97, 123, 1200)))]
    for longest in (8, 64, 1024):
        monkeypatch.setattr(bpe, "LONGEST", longest)
        for text, (ids, back) in zip(long, bpe.Codec(path, pattern).encode_decode(long)):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text) and back == text.encode()


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path, pattern = packing.vocabulary("byte_bpe_50k.tiktoken"), packing.split_pattern()
    plain = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    assert token_counts.section_tokens(empty, path, pattern).count() == 0
    text = "Première ligne\ndeux\n\n漢字 🙂\nlast"
    df = docs.limit(1).withColumn("text", F.lit(text))
    for rule in token_counts.RULES:
        found = sorted(token_counts.section_tokens(df, path, pattern, rule=rule).collect(), key=lambda r: r["section"])
        assert "".join(text[r["start"] : r["end"]] for r in found) == text
        assert sum(r["n_tokens"] for r in found) == len(plain.encode(text, add_special_tokens=False).ids)
    total = token_counts.section_tokens(docs, path, pattern).agg(F.sum("n_tokens")).first()[0]
    assert total == sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS)
    first, last = np.array([0, 3]), np.array([4, 3])
    assert token_counts.allocate(first, last, np.array([0, 1]), "most")[0].tolist() == [1, 1]


def brute_sections(text, encoding, rule):
    """(section, start, end, n_tokens, n_crossing), token by token: the characters of its bytes, and the lines they are in."""
    bounds = [i + 1 for i, c in enumerate(text[:-1]) if c == "\n"]
    starts, ends = [0, *bounds], [*bounds, len(text)]
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    line = [sum(b <= i for b in bounds) for i in range(len(text))]
    tokens, crossing, at = [0] * len(starts), [0] * len(starts), 0
    for i in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(i))
        chars = sorted(set(owner[at : at + size]))
        at += size
        lines = [line[c] for c in chars]
        most = max(sorted(set(lines)), key=lines.count)
        own = {"first": lines[0], "last": lines[-1], "most": most}[rule]
        tokens[own] += 1
        crossing[own] += len(set(lines)) > 1
    return [(k, a, b, n, c) for k, (a, b, n, c) in enumerate(zip(starts, ends, tokens, crossing))]


def test_token_counts_equal_brute_force(spark, docs):
    path, pattern = packing.vocabulary("byte_bpe_50k.tiktoken"), packing.split_pattern()
    encoding, _ = token_counts.encoder(path, pattern)
    rng = np.random.default_rng(6)
    bits = ["a", " ", "\n", "\n\n", "\n \n", "é", "漢", "🙂", "word", "\r\n", "\t", "3", "?!"]
    texts = ["".join(rng.choice(bits, int(n))) for n in rng.integers(1, 60, 60)] + ["\n", "\n\n\n\n", "x\n\n\n\ny", "\n" * 50 + "🙂"]
    rows = [(k % 50, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3])] + [(r[0], r[1]) for r in ROWS]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    crossed = 0
    for rule in token_counts.RULES:
        want = collections.Counter((k, *x) for k, t in rows for x in (brute_sections(t, encoding, rule) if t else [(0, 0, 0, 0, 0)]))
        assert collections.Counter(map(tuple, token_counts.section_tokens(table, path, pattern, rule=rule).collect())) == want
        crossed += sum(x[-1] * n for x, n in want.items())
    assert crossed


def plain_adpcm(data):
    """One block after another, one code at a time."""
    out = []
    for at in range(0, len(data), 48):
        block = data[at : at + 48]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + telephony.INDEX_CHANGE[code & 7]))
                out.append(value)
    return out


def plain_description(pcm):
    data = np.array(pcm, "<i2").tobytes()
    turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    return f"{math.isqrt(sum(x * x for x in pcm) // len(pcm))}:{max(map(abs, pcm))}:{turns}:{zlib.crc32(data):08x}"


def plain_double(pcm):
    taps, out = telephony.TAPS.tolist(), []
    for i, x in enumerate(pcm):
        around = [pcm[i + j - 3] if 0 <= i + j - 3 < len(pcm) else 0 for j in range(8)]
        out += [x, max(-32768, min(32767, ((1 << 14) + sum(t * a for t, a in zip(taps, around))) >> 15))]
    return out


def test_media(docs, empty, spark, tmp_path):
    assert telephony.media_digest(empty).count() == 0
    texts = collections.Counter((r[1] or "").encode() for r in ROWS)
    found = telephony.decode_media(telephony.store_text(docs)).collect()
    assert len(found) == len(ROWS)
    for text in texts:
        data = text + b"\xff" * (-len(text) % 576 or (576 if not text else 0))
        mine = [r for r in found if r["payload_sha256"] == hashlib.sha256(data).hexdigest()]
        assert len(mine) == texts[text]
        r = mine[0]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(data), zlib.crc32(data[-32:]))
        if len(data) < 4000:
            pcm = telephony.MU[list(data)].tolist()
            assert r["feature"] == "|".join(map(plain_description, (pcm, telephony.A[list(data)].tolist(), plain_adpcm(data), plain_double(pcm))))
            assert bytes(r["pcm16k"]) == np.array(plain_double(pcm), "<i2").tobytes()
    telephony.write_pcm(telephony.store_text(docs), f"{tmp_path}/pcm")
    stored = sorted(bytes(r["pcm16k"]) for r in spark.read.parquet(f"{tmp_path}/pcm").collect())
    assert stored == sorted(bytes(r["pcm16k"]) for r in found)
    digest = sorted(tuple(r) for r in telephony.media_digest(docs.filter("doc_id is not null")).collect())
    assert digest == sorted(tuple(r)[:-1] for r in found if r["doc_id"] is not None)


def test_codecs():
    assert telephony.MU[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    wave = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    data = telephony.adpcm_encode(wave)
    back = telephony.samples(*telephony.read_wav(telephony.wav(data.tobytes(), telephony.IMA_ADPCM, block=telephony.BLOCK)))
    assert np.abs(back[:2000].astype(int) - wave).mean() < 400
    assert telephony.resample_double(wave)[::2].tolist() == wave.tolist()


def test_language_id(docs, empty, spark):
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    rng = np.random.default_rng(3)
    sounds = {"en": ["the", "ing", "wh", "and"], "de": ["sch", "ung", "über", "ein"], "fr": ["eau", "ché", "oui", "que"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[x], 2)) for _ in range(30)), x) for i in range(240) for x in [list(sounds)[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", langid.held_out("doc_id"))
    assert {r.doc_id: r.held for r in table.collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    net = langid.fit(table)
    found = langid.identify(table, net).filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    odd = {r["doc_id"]: r for r in langid.identify(docs, net).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (3, 4, 5, 10))
    assert langid.identify(docs, net).count() == len(ROWS)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], hidden=3)
    codes, target = rng.integers(0, 5, (6, 4)), np.array([0, 1, 1, 0])

    def loss():
        f, b = langid._states(net.w[0], net.u[0], codes), langid._states(net.w[1], net.u[1], codes[::-1])[::-1]
        return -np.log(langid._posteriors(net, f, b)[:, target, np.arange(4)]).sum()

    kept = []
    f, b = langid._states(net.w[0], net.u[0], codes, kept), langid._states(net.w[1], net.u[1], codes[::-1])[::-1]
    error = langid._posteriors(net, f, b)
    error[:, target, np.arange(4)] -= 1
    _, du = langid._back(net.w[0], net.u[0], codes, kept, np.matmul(net.v.T, error)[:, :3])
    for i, j in ((0, 0), (4, 1), (8, 2)):
        step = 1e-2
        net.u[0, i, j] += step
        up = loss()
        net.u[0, i, j] -= 2 * step
        down = loss()
        net.u[0, i, j] += step
        assert abs((up - down) / (2 * step) - du[i, j]) < 0.05 * max(1, abs(du[i, j]))


def test_lm_scores(docs, empty):
    assert lm.score_documents(empty).count() == 0
    found = lm.score_documents(docs).collect()
    counts = collections.Counter()
    for doc_id, text, *_ in ROWS:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10:
            counts.update([*word_list(text), "\0"])
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*word_list(r[1]), "\0"]), 4) for r in ROWS)
    assert np.allclose(sorted(r["base_score"] for r in found), want, atol=1e-3)
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) for r in found)


def test_lm_is_normalised():
    model = lm.Model(np.full(lm.UNITS, 1 / lm.UNITS))
    first, other, log_z = model.tables()
    for one, two in ((0, 0), (3, 7), (200, 1)):
        assert abs(np.exp(first[one] + other[two] - log_z[one, two]).sum() - 1) < 1e-4


def brute_lm_scores(rows, v, model):
    """log10 probabilities of texts, word by word, each normalised over all units by itself."""
    counts = {int(h): n for h, n in zip(v.words.tolist(), v.n.tolist())}
    unit_of = {int(h): int(u) for h, u in zip(v.words.tolist(), v.unit.tolist()) if u}
    out = []
    for text in rows:
        w = lm.words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        kinds, score, before = lm._classes(w), 0.0, (0, 0)
        for h, kind in [*zip(w.hash.tolist(), kinds.tolist()), (None, None)]:
            unit = 1 if h is None else unit_of.get(h, 2 + lm.FREQUENT + kind)
            x = (model.r[before[0]] @ model.c1 + model.r[before[1]] @ model.c2).astype(float) @ model.q.T.astype(float) + np.where(model.possible, model.b, -np.inf)
            score += (x[unit] - np.log(np.exp(x).sum())) / np.log(10)
            if unit >= 2 + lm.FREQUENT:
                score += np.log10((counts.get(h, 0) + 0.1) / v.class_scale[kind])
            before = (unit, before[0])
        out.append(score)
    return out


def test_lm_scores_equal_brute_force_however_the_table_is_stored(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(vocabulary[int(x)] for x in np.minimum(59, rng.exponential(12, rng.integers(0, 90))))) for k in range(120)]
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1000)
    monkeypatch.setattr(lm, "START_TOKENS", 700)
    kept = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda t, c, v: kept.append((v, fit(t, c, v))) or kept[-1][1])
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append({r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()})
    assert all(abs(found[0][k] - found[1][k]) < 1e-6 for k, _ in rows)
    want = brute_lm_scores([t for _, t in rows], *kept[0])
    assert np.allclose([found[0][k] for k, _ in rows], want, rtol=1e-4, atol=1e-3)


def test_lm_learns_what_follows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{(s + i * i) % 40}" for i in range(60))) for k, s in enumerate(rng.integers(0, 40, 400).tolist())]
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    assert sum(r["score"] - r["base_score"] for r in found) > 0.1 * sum(r["n_tokens"] for r in found)


def test_warc(spark):
    schema = "page_id long, url string, html string, text string, row long"
    assert warc.read_records(warc.write_bundles(spark.createDataFrame([], schema))).count() == 0
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x" * 700000), (None, "http://f", "alone"), (6, "u", "<P>é</p>"), (7, "u", "r\r\n\r\nWARC/1.1"), (7, "u", "r\r\n\r\nWARC/1.1")]
    bundles = warc.write_bundles(spark.createDataFrame([(*p, "t", 1) for p in pages], schema), bundle_bytes=1 << 19).cache()
    found = warc.read_records(bundles).collect()
    groups = collections.defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    want = sorted((repr(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in pages)
    assert sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in found) == want
    assert sum(r["record_type"] == "response" for r in found) == len(groups)
    assert {(r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"} == {(1, 2), (3, 4), (7, 7)}
    index = {r["page_id"]: r for r in warc.record_index(bundles).collect()}
    at = index[5]
    bundle = bytes(bundles.filter(F.col("bundle_id") == at["bundle_id"]).first()["bundle"])
    frame = warc.read_frame(bundle, warc.seek_table(bundle)[at["frame"]])
    assert warc.parse_record(frame[at["offset"] : at["offset"] + at["length"]])[1] == b"x" * 700000
    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bundle)
    assert whole.startswith(b"WARC/1.1") and frame in whole
