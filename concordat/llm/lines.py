"""Removal of text that repeats across a corpus: lines (or paragraphs), and runs of MIN_WORDS words.

Units are lines, or paragraphs if asked for: their words, lower-cased in A-Z and with any white space between, are
hashed, digests are grouped globally, the earliest ranked occurrence stays and every later one goes, however short. A
second pass finds what is wrapped otherwise: a passage repeats where a run of MIN_WORDS words (a window, beginning at
any word, line ends being white space like any other) occurs in an earlier document or earlier in its own; overlapping
windows and lines add up to one passage. Not all windows are shuffled: a window holds shorter runs of words, and the
one of the least hash (its seed) depends on the window's words only, so windows can be equal only where their seeds
are. First seeds and units are counted, one seed in CUT words on average, then the windows whose seed occurs more than
once are compared by 64-bit hashes. A passage's place is kept as character offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.bits import bit_filter, filter_bits, hits
from concordat.llm.stage import discard, materialise, small_batches
from concordat.llm.text import Words, mix, pieces, powers, words

#: There is a seed in so many words on average.
CUT = 5
#: Shorter repeats stay: a few words repeat by chance.
MIN_WORDS = 25
MAX_BITS = 1 << 27


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Windows:
    """The runs of size words of some texts. at: number of the first word; text: the text's number; digest: of all
    words; seed: the least hash of the shorter runs inside; seeds: the seeds at all their places, each place once."""

    def __init__(self, w: Words, size: int, cut: int):
        n, inner = len(w.start), min(2 * cut - 1, size)  # of inner consecutive runs a window has one seed
        k = size - inner + 1
        text = np.repeat(np.arange(len(w.first) - 1), w.counts())
        if n < size:
            self.at = self.text = np.zeros(0, np.int64)
            self.digest = self.seed = self.seeds = np.zeros(0, np.uint64)
            return
        up, down = powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w.hash * up[:n], out=total[1:])
        runs = mix((total[k:] - total[:-k]) * down[: n - k + 1])
        least = _least(runs, inner)
        fits = text[size - 1 :] == text[: n - size + 1]
        self.at = np.flatnonzero(fits)
        self.text = text[self.at]
        self.digest = mix((total[self.at + size] - total[self.at]) * down[self.at])
        self.seed = least[self.at]
        around = np.zeros(len(least) + 2 * (inner - 1), dtype=np.uint64)
        around[inner - 1 : inner - 1 + len(least)] = np.where(fits, least, np.uint64(0))
        self.seeds = runs[runs == ~_least(~around, inner)]

    def first(self) -> np.ndarray:
        """The index of the first window of the same text with the same words."""
        order = np.lexsort((self.digest, self.text))  # stable: the first of equals comes first
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.digest[order][1:] != self.digest[order][:-1]) | (self.text[order][1:] != self.text[order][:-1])
        out = np.zeros(len(order), dtype=np.int64)
        out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        return out

    def only(self, keep: np.ndarray) -> Windows:
        self.at, self.text, self.digest, self.seed = self.at[keep], self.text[keep], self.digest[keep], self.seed[keep]
        return self


#: Line ends between two units, white space apart.
LINE, PARAGRAPH = 1, 2


class Units:
    """The lines or paragraphs of some texts that have words. at, end: numbers of the first word and the one after the
    last; text: the text's number; digest: of all words."""

    def __init__(self, w: Words, gap: int):
        n = len(w.start)
        text = np.repeat(np.arange(len(w.first) - 1), w.counts())
        line = np.cumsum(w.data == 10)[w.start] if n else np.zeros(0, np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (np.diff(line) >= gap)
        self.at = np.flatnonzero(new)
        self.end = np.append(self.at[1:], n) if n else self.at
        self.text = text[self.at]
        up, down = powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w.hash * up[:n], out=total[1:])
        self.digest = mix((total[self.end] - total[self.at]) * down[self.at] + (self.end - self.at).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def only(self, keep: np.ndarray) -> Units:
        self.at, self.end, self.text, self.digest = self.at[keep], self.end[keep], self.text[keep], self.digest[keep]
        return self

    def new(self) -> np.ndarray:
        """Whether each unit is the first of its words in its text."""
        order = np.lexsort((self.digest, self.text))
        out = np.ones(len(order), dtype=bool)
        d, t = self.digest[order], self.text[order]
        out[order[1:]] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        return out


def _scan(column: pa.Array, size: int, cut: int) -> Iterator[tuple[int, np.ndarray, Words, Windows]]:
    for a, _, raw, off in pieces(column):
        w = words(raw, off)
        yield a, off, w, Windows(w, size, cut)


def repeated_seeds(docs: DataFrame, text_col: str, cut: int, min_words: int, gap: int) -> DataFrame:
    """seed: the seeds and digests of units with two occurrences or more; from the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w, u in _scan(batch.column(0), min_words, cut):
                seeds, times = np.unique(np.concatenate([u.seeds, Units(w, gap).digest]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(times)], ["seed", "times"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(scan, "seed long, times long")
    return materialise(found.groupBy("seed").agg(F.sum("times").alias("times")).filter("times > 1").select("seed"), "seeds")


def _marked(docs: DataFrame, text_col: str, cut: int, min_words: int, gap: int):
    """docs with _row and _maybe (a window or unit may be repeated), and the broadcast filter of what repeats."""
    small_batches(docs.sparkSession)
    seeds = repeated_seeds(docs, text_col, cut, min_words, gap)
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(seeds, "seed", filter_bits(seeds.count(), MAX_BITS)))
    discard(seeds)
    at = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + [T.StructField("_row", T.LongType()), T.StructField("_maybe", T.BooleanType())])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = np.zeros(batch.num_rows, dtype=bool)
            for a, _, w, u in _scan(batch.column(at), min_words, cut):
                units = Units(w, gap)
                maybe[a + u.text[hits(shared.value, u.seed)]] = True
                maybe[a + units.text[hits(shared.value, units.digest)]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], schema.fieldNames())

    return docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(flag, schema), shared


def _later_units(texts: DataFrame, shared, kind: str, gap: int) -> DataFrame:
    """row, first_doc, copies, word, end_word of each unit that occurs earlier; from the shared folder."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, off in pieces(batch.column(2)):
                w = words(raw, off)
                u = Units(w, gap)
                u.only(hits(shared.value, u.digest))
                rows, first = pa.array(a + u.text), w.first[:-1][u.text]
                values = (u.digest.view(np.int64), u.at - first, u.end - first, u.new())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, values)], ["row", "doc_id", "digest", "word", "end_word", "new"])

    found = materialise(texts.mapInArrow(place, f"row long, doc_id {kind}, digest long, word long, end_word long, new boolean"), "units")
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    earlier = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.col("doc_id").isNull() & F.col("first_doc").isNotNull())
    out = materialise(found.join(firsts, "digest").filter(earlier | ~F.col("new")).select("row", "first_doc", "copies", "word", "end_word"), "later-units")
    discard(found)
    return out


def _passages(maybe: DataFrame, shared, id_col: str, text_col: str, cut: int, min_words: int, gap: int) -> DataFrame:
    """The passages to remove from the marked documents, in words: row, word, end_word (first after it), keep_doc_id,
    copies; from the shared folder. Windows are many, so no more of them is shuffled than has to be."""
    kind = maybe.schema[id_col].dataType.simpleString()
    texts = maybe.select("_row", F.col(id_col), F.col(text_col).cast("string"))
    base = min_words + 1
    units = _later_units(texts, shared, kind, gap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, _, u in _scan(batch.column(2), min_words, cut):
                u.only(hits(shared.value, u.seed))
                rows, times = np.unique(u.first(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.digest[rows].view(np.int64)), batch.column(1).take(pa.array(a + u.text[rows])), pa.array(times)], ["digest", "doc", "times"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, w, u in _scan(batch.column(2), min_words, cut):
                u.only(hits(shared.value, u.seed))
                rows, first = pa.array(a + u.text), u.first()
                # 0: new in this text; else 1 and the number of words that the first of its kind here also holds
                again = np.where(first == np.arange(len(first)), 0, 1 + np.maximum(u.at[first] + min_words - u.at, 0))
                values = (u.digest.view(np.int64), (u.at - w.first[:-1][u.text]) * base + again)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, values)], ["row", "doc_id", "digest", "at"])

    groups = texts.mapInArrow(count, f"digest long, doc {kind}, times long").groupBy("digest").agg(F.min("doc").alias("first_doc"), F.sum("times").alias("copies"))
    firsts = materialise(groups.filter("copies > 1"), "windows")
    found = texts.mapInArrow(place, f"row long, doc_id {kind}, digest long, at long").join(firsts, "digest")
    earlier = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.col("doc_id").isNull() & F.col("first_doc").isNotNull())
    again = F.col("at") % base
    at = F.when(earlier, F.col("at") - again).otherwise(F.col("at") - 1)  # of an earlier document's window all words go
    later = materialise(found.filter(earlier | (again > 0)).select("row", at.alias("at"), "first_doc", "copies"), "later-windows")
    discard(firsts)
    start = F.floor(F.col("at") / base)
    cover = later.select("row", "first_doc", "copies", (start + F.col("at") % base).alias("word"), (start + min_words).alias("end_word")).unionByName(units)
    order = Window.partitionBy("row").orderBy("word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        cover.repartition("row")
        .withColumn("new", F.coalesce(F.col("word") > reach, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "island")
        .agg(F.min("word").alias("word"), F.max("end_word").alias("end_word"), F.min("first_doc").alias("keep_doc_id"), F.max("copies").alias("copies"))
        .drop("island")
    )
    out = materialise(islands, "passages")
    discard(later, units)
    return out


def _with_passages(docs: DataFrame, id_col: str, text_col: str, cut: int, min_words: int, gap: int) -> tuple[DataFrame, DataFrame]:
    """The documents that surely have no passage to remove, and the others with an array column _passages in the order
    of the text, of structs (start, end, n_words, keep_doc_id, copies), null where there are none; both with _row."""
    flagged, shared = _marked(docs, text_col, cut, min_words, gap)
    maybe = materialise(flagged.filter("_maybe"), "maybe-passages")
    names = ["start", "end", "n_words", "keep_doc_id", "copies"]
    found = _passages(maybe, shared, id_col, text_col, cut, min_words, gap)
    lists = found.groupBy(F.col("row").alias("_at")).agg(F.sort_array(F.collect_list(F.struct("word", "end_word", "keep_doc_id", "copies"))).alias("_passages"))
    met = maybe.join(lists, F.col("_row") == F.col("_at"), "left").drop("_at", "_maybe").withColumn("_text", F.col(text_col).cast("string"))
    others = [f for f in met.schema.fields if f.name not in ("_passages", "_text")]
    kinds = [T.LongType(), T.LongType(), T.LongType(), docs.schema[id_col].dataType, T.LongType()]
    schema = T.StructType([*others, T.StructField("_passages", T.ArrayType(T.StructType([*map(T.StructField, names, kinds)])))])

    def to_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 2)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lengths)
            word, end_word, keep, copies = flat.flatten()
            word, end_word = word.to_numpy(), end_word.to_numpy()
            start, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for a, b, raw, off in pieces(batch.column(batch.num_columns - 1)):
                here = slice(*np.searchsorted(row, [a, b]))
                w, text = words(raw, off), row[here] - a
                chars = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum((w.data & 0xC0) != 0x80, out=chars[1:])
                start[here] = chars[w.start[w.first[text] + word[here]]] - chars[off[text]]
                end[here] = chars[w.end[w.first[text] + end_word[here] - 1]] - chars[off[text]]
            structs = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(end_word - word), keep, copies], names)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(lengths == 0, False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(offsets, structs)], schema.fieldNames())

    return flagged.filter("not _maybe").drop("_maybe"), met.select(*(f.name for f in others), "_passages", "_text").mapInArrow(to_chars, schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, min_words: int = MIN_WORDS, gap: int = LINE) -> DataFrame:
    """The passages to remove, a row each: row, doc_id, start, end (characters of the original text), n_words,
    keep_doc_id, copies.

    The earliest occurrence of a unit or window is its first in the document with the least doc_id and stays, but for
    words that are also in another one with an earlier occurrence; a null id ranks last. Rows that share a doc_id rank
    alike, so each of them keeps what first occurs under that id. Repeats inside one text count too; where windows
    overlap their first occurrence, only what is beyond it goes. Passages that touch are one; keep_doc_id is the least
    document with one of its units or windows, copies the most occurrences of one. gap is LINE or PARAGRAPH: the line
    ends between two units. Null, empty and blank texts have no passages, and an empty table gives an empty table;
    other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    _, met = _with_passages(docs, "doc_id", "text", cut, min_words, gap)
    return met.select(F.col("_row").alias("row"), "doc_id", F.inline("_passages"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, min_words: int = MIN_WORDS, gap: int = LINE) -> DataFrame:
    """docs without its repeated passages, and with an array column removed of their (start, end) in the original.

    Documents without a possibly repeated unit or window pass straight through; only the others are shuffled. What
    stays on both sides of a removed passage is joined as it is, and a text may become empty; rows stay. A column named
    removed is replaced, all others pass unchanged whatever their names.
    """
    docs = docs.drop("removed")
    names, plain = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(names, plain))
    text = at[text_col]
    alone, met = _with_passages(docs.toDF(*plain), at[id_col], text, cut, min_words, gap)
    kind = "array<struct<start:bigint,end:bigint>>"
    keep = F.expr(
        f"""array_join(transform(sequence(0, size(removed)), i -> substring({text},
            cast(if(i = 0, 0, removed[greatest(i - 1, 0)].end) as int) + 1,
            cast(if(i = size(removed), length({text}), removed[least(i, size(removed) - 1)].start)
                 - if(i = 0, 0, removed[greatest(i - 1, 0)].end) as int))), '')"""
    )
    met = met.withColumn("removed", F.expr("transform(_passages, p -> struct(p.start as start, p.end as end))")).withColumn(text, F.when(F.col("removed").isNull(), F.col(text)).otherwise(keep))
    return alone.select(*plain, F.lit(None).cast(kind).alias("removed")).unionByName(met.select(*plain, F.col("removed").cast(kind))).toDF(*names, "removed")
