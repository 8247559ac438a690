"""Phrase collocations: candidates from the upper bounds of a sketch, counted by automata, then thresholds.

Every run of one to four words of a piece is hashed to one of many cells, about as many as there are runs; each task
hands on the cells of its texts with their counts, and executors add them up. A cell's count is an upper bound of the
count of each of its runs, so that no frequent run is lost where runs meet in a cell. The frequent cells go into a bit
filter. In a second pass each shard of text compiles the runs that pass the filter, with all their parts, into one
automaton, guarded at the ends of words and of pieces, and counts its overlapping matches. The sums over shards are
exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.bits import bit_filter
from concordat.llm.stage import discard, materialise, small_batches
from concordat.llm.text import BASE, Words, buffers, mix, words

LONGEST, LEAST, TOP = 4, 30, 2000
#: A part of a longer candidate goes where the longer one has so many hundredths of its count.
SHARE = 80
#: Bytes of text in a shard; a text of more than PART bytes is cut where a piece ends; bytes hashed at once.
SHARD, PART, AT_ONCE = 1 << 21, 1 << 19, 1 << 18
#: Cells of one row of the sketch's table.
CHUNK = 1 << 20
#: Bits of the filter for each frequent cell, and at most.
BITS, MOST_BITS = 64, 1 << 29
UNKNOWN = "und"
#: The bytes that end a piece, all read as a line end; blanks and tabs end a word.
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_END)] = True
_PLAIN = np.where(_ENDS, 10, np.arange(256)).astype(np.uint8)
#: Characters of an automaton's text: between pieces, for words that no candidate has, and 0 of a code's digits.
GUARD, OTHER, FIRST, NEXT = 1, 2, 65, 97


def shards(batches: Iterator[pa.RecordBatch], limit: int = SHARD, part: int = PART) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(languages, bytes, starts): about limit bytes of texts, each with a line end after it, and where each begins."""
    langs: list[str] = []
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        raw, off = buffers(batch.column(1))
        raw = _PLAIN[raw]
        for lang, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            while a < b:
                end = b
                if b - a > part:
                    ends = np.flatnonzero(raw[a + part : b] == 10)
                    end = a + part + int(ends[0]) if len(ends) else b
                langs.append(UNKNOWN if lang is None else lang)
                held.append(raw[a:end])
                size += end - a + 1
                a = end
                if size >= limit:
                    yield _joined(langs, held)
                    langs, held, size = [], [], 0
    if held:
        yield _joined(langs, held)


def _joined(langs: list[str], held: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(h) + 1 for h in held)])
    data = np.full(starts[-1], 10, np.uint8)
    for a, h in zip(starts.tolist(), held):
        data[a : a + len(h)] = h
    return langs, data, starts[:-1]


class Shard:
    """The words of a shard, and the hashes of the runs of 1 to LONGEST words of a piece that begin at each."""

    def __init__(self, langs: list[str], data: np.ndarray, starts: np.ndarray):
        self.names = sorted(set(langs))
        index = {x: i for i, x in enumerate(self.names)}
        cuts = [0, *starts[np.flatnonzero(np.diff(starts // AT_ONCE)) + 1].tolist(), len(data)]
        some = [words(data[a:b], np.array([0, b - a])) for a, b in zip(cuts, cuts[1:])]
        begin, end = (np.concatenate([getattr(x, side) + a for x, a in zip(some, cuts)]) for side in ("start", "end"))
        self.words = w = Words(np.concatenate([x.data for x in some]), begin, end, np.concatenate([x.hash for x in some]), np.array([0, len(begin)]))
        self.lang = np.array([index[x] for x in langs], np.int64)[np.searchsorted(starts, w.start, side="right") - 1]
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=ends[1:])
        self.piece = ends[w.start]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
        one = mix(w.hash + seeds[self.lang]) if len(w.hash) else w.hash
        self.runs: list[np.ndarray] = [one]
        self.inside: list[np.ndarray] = [np.ones(len(one), bool)]
        for k in range(1, LONGEST):
            long = len(one) - k
            self.runs.append(mix(self.runs[-1][: max(long, 0)] * np.uint64(BASE) + one[k:]) if long > 0 else one[:0])
            self.inside.append(self.piece[k:] == self.piece[: max(long, 0)])


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def sketch(docs: DataFrame, cells: int, least: int) -> DataFrame:
    """cell: those of cells, a power of two, into which at least least runs have fallen.

    A task hands on, for each chunk of cells, the steps from one cell to the next and their counts; each chunk is added
    up by one task, in an array of CHUNK counts whatever the corpus.
    """
    chunk = min(CHUNK, cells)
    top = min(255, least)
    add_type = np.uint8 if least <= 255 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, data, starts in shards(batches):
            s = Shard(langs, data, starts)
            at = np.sort(np.concatenate([cells_of(h[i], cells) for h, i in zip(s.runs, s.inside)]).astype(np.uint32 if cells <= 1 << 32 else np.uint64))
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            times, at = np.diff(np.append(new, len(at))), at[new].astype(np.int64)
            where, place = at // chunk, (at % chunk).astype("<u4")
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            cuts = np.append(first, len(at)).tolist()
            if least > 255:
                times = np.minimum(times, (1 << 31) - 1).astype("<u4")
            else:
                times = np.minimum(times, top).astype("u1")
            steps = place.copy()
            steps[1:] -= place[:-1]
            steps[first] = place[first]
            low, high = (steps & 0xFFFF).astype("<u2"), (steps >> 16).astype("u1")
            bytes_of = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(where[first], pa.int64()), *(pa.array(bytes_of(x), pa.binary()) for x in (low, high, times))], ["chunk", "low", "high", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, np.zeros(chunk, add_type)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums >= least) + now * chunk, pa.int64())], ["cell"])

        for batch in batches:
            for k, low, high, times in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if now >= 0:
                        yield full()
                    now, sums = k, np.zeros(chunk, add_type)
                place = np.cumsum(np.frombuffer(low, "<u2").astype(np.int64) + (np.frombuffer(high, "u1").astype(np.int64) << 16))
                got = np.frombuffer(times, "u1" if least <= 255 else "<u4").astype(np.int64) + sums[place]
                sums[place] = np.minimum(got, least).astype(add_type)
        if now >= 0:
            yield full()

    counted = docs.mapInArrow(count, "chunk long, low binary, high binary, times binary")
    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "cell long")


def passing(filled: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Which runs may be in a frequent cell, by two probes."""
    at = cells_of(hashes, cells).astype(np.uint64)
    mask = np.uint64(len(filled) * 64 - 1)
    out = np.ones(len(hashes), bool)
    for probe in (mix(at + np.uint64(1)), mix(at ^ np.uint64(BASE))):
        bit = (probe & mask).astype(np.int64)
        out &= (filled[bit >> 6] >> (bit & 63) & 1).astype(bool)
    return out


def count_shard(s: Shard, filled: np.ndarray, cells: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(languages, phrases, counts) of the candidates of a shard, their words, and under an empty phrase all words.

    A run is a candidate if it and all runs inside it pass the filter; that depends on the run alone, so every shard
    that has it counts it.
    """
    w = s.words
    n_words = np.bincount(s.lang, minlength=len(s.names))
    out = [(np.arange(len(s.names)), pa.array([""] * len(s.names), pa.large_binary()), n_words)]
    frequent = passing(filled, s.runs[0], cells)
    at = np.flatnonzero(frequent)
    if len(at):
        # the words that pass, numbered by language and bytes
        cuts = np.zeros(len(at) + 1, np.int64)
        np.cumsum(w.end[at] - w.start[at], out=cuts[1:])
        place = np.repeat(w.start[at] - cuts[:-1], np.diff(cuts)) + np.arange(cuts[-1])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(w.data[place])]).dictionary_encode()
        spelt = coded.dictionary
        pairs, code = np.unique(coded.indices.to_numpy().astype(np.int64) * len(s.names) + s.lang[at], return_inverse=True)
        own = spelt.take(pa.array(pairs // len(s.names)))
        lang = pairs % len(s.names)
        out.append((lang, own, np.bincount(code)))
        symbol = np.full(len(w.start), -1, np.int64)
        symbol[at] = code
        # candidates: runs of words, the longer ones only where both shorter ones inside pass
        ok, number, found = frequent, symbol, []
        for k in range(1, LONGEST):
            long = len(w.start) - k
            if long <= 0:
                break
            ok = ok[:long] & ok[1 : long + 1] & s.inside[k]
            ok[ok] = passing(filled, s.runs[k][ok], cells)
            here = np.flatnonzero(ok)
            if not len(here):
                break
            distinct, first, which = np.unique(number[here] * (len(pairs) + 1) + symbol[here + k], return_index=True, return_inverse=True)
            number = np.full(long, -1, np.int64)
            number[here] = which
            found.append(symbol[here[first][:, None] + np.arange(k + 1)])
        counts = matches(symbol, s.piece, found)
        for codes, times in zip(found, counts):
            phrase = pc.binary_join_element_wise(*(own.take(pa.array(c)) for c in codes.T), pa.scalar(b" ", pa.large_binary()))
            out.append((lang[codes[:, 0]], phrase, times))
    names = pa.array(s.names, pa.string()).take(pa.array(np.concatenate([x for x, _, _ in out])))
    phrases = pa.concat_arrays([x for _, x, _ in out]).cast(pa.large_string())
    return names, phrases, np.concatenate([x for _, _, x in out]).astype(np.int64)


def spelt(codes: np.ndarray, digits: int) -> np.ndarray:
    """Rows of digits to the base 16, the first of an alphabet of its own, so that a match begins where a word does."""
    return ((codes[:, None] >> (4 * np.arange(digits)[::-1])) & 15).astype(np.uint8) + np.array([FIRST] + [NEXT] * (digits - 1), np.uint8)


def matches(symbol: np.ndarray, piece: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
    """How often each run of codes occurs in the words of a shard, overlaps included, never across a piece's end.

    A word is spelt in a few digits, as automata are slow at nodes with many edges; words without a code are OTHER, and
    GUARD stands between pieces.
    """
    if not found:
        return []
    digits = max(1, -(-int(symbol.max(initial=0)).bit_length() // 4))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    base = 0
    for codes in found:
        k, text = codes.shape[1] * digits, spelt(codes.ravel(), digits).tobytes().decode("ascii")
        for i in range(len(codes)):
            automaton.add_word(text[i * k : i * k + k], base + i)
        base += len(codes)
    automaton.make_automaton()
    text = spelt(np.maximum(symbol, 0), digits)
    text[symbol < 0] = 0
    text[symbol < 0, 0] = OTHER
    guards = np.zeros((1, digits), np.uint8)
    guards[0, 0] = GUARD
    text = np.insert(text, np.flatnonzero(np.diff(piece)) + 1, guards, axis=0).ravel()
    hits = np.fromiter(map(itemgetter(1), automaton.iter(text[text > 0].tobytes().decode("ascii"))), np.int64)
    counts = np.bincount(hits, minlength=base)
    cuts = np.cumsum([0, *map(len, found)])
    return [counts[a:b] for a, b in zip(cuts, cuts[1:])]


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """lang, phrase, n: exact counts of every word and run of up to LONGEST words with a count of least or more, of some
    others, and under an empty phrase of all words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << max(16, min(40, (LONGEST * size // 6).bit_length()))
    frequent = materialise(sketch(plain, cells, least), "frequent-cells")
    bits = min(MOST_BITS, 1 << max(16, (BITS * frequent.count()).bit_length() - 1))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mix(at + np.uint64(1)), mix(at ^ np.uint64(BASE))]).view(np.int64))], ["probe"])

    filled = bit_filter(frequent.mapInArrow(probes, "probe long"), "probe", bits)
    discard(frequent)
    shared = spark.sparkContext.broadcast(filled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, data, starts in shards(batches):
            names, phrases, counts = count_shard(Shard(langs, data, starts), shared.value, cells)
            for a in range(0, len(counts), 1 << 15):
                part = slice(a, a + (1 << 15))
                yield pa.RecordBatch.from_arrays([names[part], phrases[part].cast(pa.string()), pa.array(counts[part])], ["lang", "phrase", "n"])

    counted = plain.mapInArrow(scan, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return materialise(counted.filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrase-counts")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, share: int = SHARE, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    Texts are lower-cased in A-Z, cut at PIECE_END into pieces, and those at blanks and tabs into words. A candidate is
    a run of 2 to LONGEST words of a piece with a count a of least or more; of its cuts into a first part and the rest,
    with counts l and r, the one with the least floor(2000000 * a / (l + r)) gives the score, the earliest of equals.
    Candidates inside a longer candidate with at least share hundredths of their count are dropped. Order: score and a
    descending, phrase by its UTF-8 bytes. n counts the words of the language. A null language is UNKNOWN; null, empty
    and blank texts have no words; repeated rows count as often as they are there. An empty table gives an empty table;
    other columns are not read.
    """
    counts = phrase_counts(docs, lang_col, text_col, least)
    whole = counts.filter("phrase <> ''")
    split = F.split("phrase", " ")
    cand = materialise(whole.withColumn("words", split).filter(F.size("words") >= 2).withColumnRenamed("n", "a"), "candidates")
    joined = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = cand.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words")).alias("right"))
    of = lambda part, name: whole.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    met = met.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the parts of longer candidates, with the largest count of those
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    inside = cand.filter(F.size("words") > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"))
    some = flat.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("phrase = ''").select("lang", "n")
    out = materialise(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts, cand)
    return out
