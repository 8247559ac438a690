"""Language-model scores of documents by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words and one end. The model's units are the end, the most frequent words, and classes of all other words
by their last two bytes. A unit's probability depends on the two units before it: their feature vectors, each turned by
a matrix for its place, add up to the vector expected next, whose products with the target vectors, plus biases, are
normalised over all units. A word outside the frequent ones has its class's probability times its smoothed share of the
class, so probabilities add up to one over all words and an unknown one for each class.

Counts are taken over all training documents. Documents are dealt to shards by a hash, as many as their tokens ask for,
and read in its order. The network starts from a fit to one small shard of whole documents, is then trained on every
shard, and the shards' weights are averaged by their numbers of tokens; so the scores do not depend on how the table is
stored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.bits import CHUNK, chunk_rows, summed_chunks
from concordat.llm.langid import held_out
from concordat.llm.stage import materialise, small_batches
from concordat.llm.text import Words, mix, pieces, words

#: Units: begin (context only), end, frequent words, classes; and the length of vectors.
FREQUENT, CLASSES, SIZE = 1536, 510, 24
UNITS = 2 + FREQUENT + CLASSES
#: Words at most whose counts every task holds; the counts of all others are joined.
HELD = 1 << 16
#: Noise units and tokens in a step of training, and the step size.
NOISE, STEP_TOKENS, RATE = 64, 8192, 0.08
#: Tokens of a shard on average, of the shard that the network starts from, and of what is shuffled at once.
SHARD_TOKENS, START_TOKENS, BLOCK_TOKENS = 1 << 22, 1 << 18, 1 << 17
START_EPOCHS = 6
ADD = 0.1
#: The end as a word.
END = np.uint64(0x656E64)
HELD_OUT = (10, 0)


def _classes(w: Words) -> np.ndarray:
    """A class for each word, by its last two bytes (one, if it has no more)."""
    last = w.data[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, w.data[w.end - 2], 0).astype(np.uint64)
    return (mix(last << np.uint64(8) | before) % np.uint64(CLASSES)).astype(np.int64)


def count_words(training: DataFrame, text_col: str) -> DataFrame:
    """word, n, class over all tokens of the training documents, from the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in pieces(batch.column(0)):
                w = words(raw, off)
                found, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                found, n, kinds = np.append(found, END), np.append(n, b - a), np.append(_classes(w)[first], 0)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(kinds)], ["word", "n", "class"])

    found = training.select(F.col(text_col).cast("string")).mapInArrow(scan, "word long, n long, class long")
    return materialise(found.groupBy("word").agg(F.sum("n").alias("n"), F.max("class").alias("class")), "counts")


@dataclass
class Vocabulary:
    """Counts that every task holds. words: the most frequent, sorted; n: their counts; unit: of the frequent, else 0."""

    words: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    end_count: int
    total: int
    distinct: int
    class_scale: np.ndarray
    unit_counts: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is held, and its place."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        return (self.words[at] == hashes) if len(self.words) else np.zeros(len(hashes), bool), at

    def units(self, w: Words, held: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = np.where(held, self.unit[at], 0) if len(self.words) else np.zeros(len(at), np.int64)
        return np.where(own > 0, own, 2 + FREQUENT + _classes(w))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all counts, and the most frequent words: bounded numbers, whatever the corpus.

    Words are ranked in sixteenths of a power of two; those of the first ranks that hold HELD words together go to the
    driver, so no task sends more than it has of them.
    """
    end = F.lit(int(END))
    rank = F.floor(F.log2("n") * 16)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("word") == end, F.col("n"))), F.lit(0)).alias("e")).first()
    others = counts.filter(F.col("word") != end)
    room, least = HELD, None
    for r in others.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["rank"]
    rows = [] if least is None else others.filter(rank >= least).collect()
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    unit, unit_counts = np.zeros(len(rows), np.int64), np.zeros(UNITS)
    for k, r in enumerate(rows[:FREQUENT]):
        unit[k], unit_counts[2 + k] = 2 + k, r["n"]
        n[r["class"]] -= r["n"]
        v[r["class"]] -= 1
    hashes = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    unit_counts[1], unit_counts[2 + FREQUENT :] = totals["e"], n
    return Vocabulary(hashes[order], np.array([r["n"] for r in rows], np.float64)[order], unit[order], totals["e"], totals["n"], totals["v"], n + ADD * (v + 1), unit_counts)


class Model:
    """Weights of the log-bilinear model: features r, place matrices c1 and c2, targets q and biases b."""

    NAMES = ("r", "c1", "c2", "q", "b")
    SHAPES = {"r": (UNITS, SIZE), "c1": (SIZE, SIZE), "c2": (SIZE, SIZE), "q": (UNITS, SIZE), "b": (UNITS,)}

    def __init__(self, noise: np.ndarray, seed: int = 5):
        """noise: the distribution of noise units, which is also where the biases start."""
        rng = np.random.default_rng(seed)
        for name in self.NAMES[:-1]:
            setattr(self, name, rng.normal(0, 0.1, self.SHAPES[name]).astype(np.float32))
        self.c1 += np.eye(SIZE, dtype=np.float32)
        self.c2 += 0.5 * np.eye(SIZE, dtype=np.float32)
        self.noise, self.possible = noise, np.ones(UNITS, bool)
        self.possible[0] = False  # the begin is never predicted
        self.b = np.log(noise).astype(np.float32)
        self.sums = {name: np.full(shape, 1e-3, np.float32) for name, shape in self.SHAPES.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            size = int(np.prod(self.SHAPES[name]))
            setattr(self, name, values[at : at + size].reshape(self.SHAPES[name]).astype(np.float32))
            at += size

    def _step(self, name: str, grad: np.ndarray) -> None:
        self.sums[name] += grad * grad
        weights = getattr(self, name)
        weights -= RATE * grad / np.sqrt(self.sums[name])

    @staticmethod
    def _gather(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of rows by index, over all units."""
        out = np.zeros((UNITS, *rows.shape[1:]), np.float32)
        order = np.argsort(index.astype(np.int16), kind="stable")
        index = index[order]
        first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
        return out

    def learn(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation; all tokens of the step meet the same noise units."""
        others = rng.choice(UNITS, NOISE, p=self.noise)
        x1, x2, q, z = self.r[one], self.r[two], self.q[unit], self.q[others]
        expected = x1 @ self.c1 + x2 @ self.c2
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        true = np.einsum("ij,ij->i", expected, q) + self.b[unit] - log_noise[unit]
        false = expected @ z.T + (self.b[others] - log_noise[others])
        scale = np.float32(1 / len(unit))
        d_true = (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1) * scale
        d_false = 1 / (1 + np.exp(-np.clip(false, -30, 30))) * scale
        d_expected = d_true[:, None] * q + d_false @ z
        d_q = self._gather(unit, d_true[:, None] * expected) + self._gather(others, d_false.T @ expected)
        d_b = self._gather(unit, d_true) + self._gather(others, d_false.sum(axis=0))
        d_r = self._gather(one, d_expected) @ self.c1.T + self._gather(two, d_expected) @ self.c2.T
        d_c1, d_c2 = x1.T @ d_expected, x2.T @ d_expected
        for name, grad in zip(self.NAMES, (d_r, d_c1, d_c2, d_q, d_b)):
            self._step(name, grad)

    def learn_all(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator, epochs: int = 1) -> None:
        for _ in range(epochs):
            order = rng.permutation(len(unit))
            for at in range(0, len(order), STEP_TOKENS):
                rows = order[at : at + STEP_TOKENS]
                self.learn(unit[rows], one[rows], two[rows], rng)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By (unit before, unit): its part of the score; by (second before, unit) with biases; by both contexts the
        logarithm of the normaliser, which as a sum of products is one matrix product of exponentials."""
        bias = np.where(self.possible, self.b, -np.inf)
        first, other = (self.r @ self.c1 @ self.q.T).astype(np.float64), (self.r @ self.c2 @ self.q.T + bias).astype(np.float64)
        top_first, top_other = first.max(axis=1, keepdims=True), other.max(axis=1, keepdims=True)
        log_z = np.log(np.exp(first - top_first) @ np.exp(other - top_other).T) + top_first + top_other.T
        return first.astype(np.float32), other.astype(np.float32), log_z.astype(np.float32)


def _sequences(v: Vocabulary, raw: np.ndarray, off: np.ndarray) -> tuple:
    """Words, their look-up, and for every token of the texts, ends included: text, unit, and the two units before."""
    w = words(raw, off)
    held, at = v.look_up(w.hash)
    n = w.counts()
    text = np.repeat(np.arange(len(n)), n + 1)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(len(text), dtype=bool)
    is_word[ends] = False
    unit = np.ones(len(text), np.int64)
    unit[is_word] = v.units(w, held, at)
    place = np.arange(len(text)) - (ends - n)[text]
    one = np.where(place > 0, np.roll(unit, 1), 0)
    two = np.where(place > 1, np.roll(unit, 2), 0)
    return w, held, at, is_word, text, unit, one, two


def _contexts(unit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of texts of such sizes, and the two units before each, 0 where the text begins."""
    place = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return unit, np.where(place > 0, np.roll(unit, 1), 0), np.where(place > 1, np.roll(unit, 2), 0)


def _unit_rows(training: DataFrame, text_col: str, shared, shard) -> DataFrame:
    """shard, h and units (16-bit integers) of each training document; h orders the documents of a shard."""
    names = ["shard", "h", "units"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for a, b, raw, off in pieces(batch.column(0)):
                _, _, _, _, text, unit, _, _ = _sequences(v, raw, off)
                cuts = 2 * np.searchsorted(text, np.arange(b - a + 1))
                data = unit.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([data[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())], names)

    h = F.xxhash64("doc_id", text_col)
    return training.select(F.col(text_col).cast("string"), shard(h).alias("shard"), h.alias("h")).mapInArrow(scan, "shard long, h long, units binary")


def _train(units: DataFrame, model: Model, epochs: int) -> np.ndarray:
    """The weights of model after training on each shard on its own, averaged over shards by tokens.

    A shard's tokens are taken in the order of h, in blocks of BLOCK_TOKENS, whatever batches they come in.
    """
    shared = units.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard, mine, rng = None, None, None, None
        held: list[np.ndarray] = []
        waiting = tokens = 0

        def flush() -> None:
            nonlocal waiting
            if held:
                sizes = np.array([len(x) for x in held])
                mine.learn_all(*_contexts(np.concatenate(held).astype(np.int64), sizes), rng, epochs)
            held.clear()
            waiting = 0

        def close() -> None:
            nonlocal total
            if mine is not None:
                flush()
                sums = np.append(mine.flat().astype(np.float64), 1.0) * tokens
                total = sums if total is None else total + sums

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != shard or mine is None:
                    close()
                    shard, mine, rng, tokens = k, copy.deepcopy(shared.value), np.random.default_rng([13, k]), 0
                held.append(np.frombuffer(data, "<u2"))
                waiting, tokens = waiting + len(held[-1]), tokens + len(held[-1])
                if waiting >= BLOCK_TOKENS:
                    flush()
        close()
        if total is not None:
            yield from chunk_rows(np.append(total, np.zeros(-len(total) % CHUNK)).view(np.int64), CHUNK)

    size = len(model.flat()) + 1
    add = lambda a, b: (a.view(np.float64) + b.view(np.float64)).view(np.int64)
    found = units.repartition("shard").sortWithinPartitions("shard", "h", "units").mapInArrow(learn, "chunk int, counts binary")
    sums = summed_chunks(found, size + -size % CHUNK, CHUNK, add).view(np.float64)[:size]
    return sums[:-1] / sums[-1] if sums[-1] else model.flat()


def fit(training: DataFrame, text_col: str, v: Vocabulary) -> Model | None:
    """A model of the training documents; None if there are none."""
    if not v.total:
        return None
    model = Model((v.unit_counts + 1) / (v.unit_counts + 1).sum())
    model.possible[2 + np.flatnonzero(v.unit_counts[2 : 2 + FREQUENT] == 0)] = False  # places without a word
    shared = training.sparkSession.sparkContext.broadcast(v)
    many, shards = max(1, v.total // START_TOKENS), max(1, -(-v.total // SHARD_TOKENS))
    start = _unit_rows(training.filter(F.pmod(F.xxhash64("doc_id", text_col, F.lit(1)), F.lit(many)) == 0), text_col, shared, lambda h: F.lit(0).cast("long"))
    model.load(_train(start, model, START_EPOCHS))
    model.load(_train(_unit_rows(training, text_col, shared, lambda h: F.pmod(h, F.lit(shards))), model, 1))
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Documents whose id has a CRC-32 divisible by 10 are held out; all others are learned from. A null or empty text is
    one token, the end; a null id counts as empty text. Rows that share an id are handled one by one. Without training
    documents both scores are the base's. Words are told apart by 64-bit hashes; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, *HELD_OUT).alias("held_out"))
    training = rows.filter("not held_out")
    counts = count_words(training, "text")
    v = vocabulary(counts)
    model = fit(training, "text", v)
    shared = docs.sparkSession.sparkContext.broadcast((v, model.tables() if model else None))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tables = shared.value
        logs = np.log10(v.n + ADD)
        for batch in batches:
            for a, b, raw, off in pieces(batch.column(1)):
                w, held, at, is_word, text, unit, one, two = _sequences(v, raw, off)
                k = b - a
                owner = text[is_word]
                known = np.bincount(owner[held], minlength=k) + (v.end_count > 0)
                base = np.bincount(owner[held], weights=logs[at[held]], minlength=k) + np.log10(v.end_count + ADD)
                score = base.copy()
                if tables:
                    first, other, log_z = tables
                    log_p = first[one, unit] + other[two, unit] - log_z[one, two]
                    score = np.bincount(text, weights=log_p, minlength=k) / np.log(10)
                    rare = unit[is_word] >= 2 + FREQUENT
                    score -= np.bincount(owner[rare], weights=np.log10(v.class_scale)[unit[is_word][rare] - 2 - FREQUENT], minlength=k)
                    both = rare & held
                    score += np.bincount(owner[both], weights=logs[at[both]], minlength=k)
                n = w.counts() + 1
                part = pa.array(np.arange(a, b))
                ids = [batch.column(c).take(part) for c in (3, 0, 2)]
                nothing = [pa.nulls(k, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), pa.array(known), pa.array(base), pa.array(score), *nothing], names)
                rare_owner, rare_word = owner[~held], w.hash[~held]
                order = np.lexsort((rare_word, rare_owner))
                rare_owner, rare_word = rare_owner[order], rare_word[order]
                if len(order):
                    start = np.flatnonzero(np.append(True, (rare_word[1:] != rare_word[:-1]) | (rare_owner[1:] != rare_owner[:-1])))
                    times = np.diff(np.append(start, len(order)))
                    m, own = len(start), pa.array(a + rare_owner[start])
                    empty = [pa.nulls(m, t) for t in (batch.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([batch.column(3).take(own), *empty, pa.array(rare_word[start].view(np.int64)), pa.array(times)], names)

    fields = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word long, times long"
    found = materialise(rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text", "held_out", "row").mapInArrow(scan, fields), "scored")
    rare = (
        found.filter("word is not null")
        .select("row", "word", "times")
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    per_token = float(np.log10(v.total + ADD * (v.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("base") + more - F.col("n_tokens") * per_token
    return (
        found.filter("word is null")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(int(v.total)).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("score") + more if model else base).alias("score"),
        )
    )
