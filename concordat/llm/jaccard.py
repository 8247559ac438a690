"""Similarity join of documents on word shingles: count-vector R-trees over lossless blocks.

Two sets link when 100 |A & B| >= 75 |A | B|, which forces |A & B| >= 3/7 (|A| + |B|). The tokens of a set are hashed
into groups and the group counts taken as a point: |A & B| is at most the sum over groups of the smaller count. Every
candidate pair comes from an R-tree over such points, whose nodes hold each coordinate's maximum and the range of
sizes, so that whole boxes are excluded by the bound; what stays meets finer points, then the sets themselves.

A tree over a whole corpus cannot prune in so many dimensions, so each block has its own: a set whose tokens stand in
one global order shares one of its first |A| - ceil(0.75 |A|) + 1 tokens with each set that it links to. The order puts
tokens of frequent hash buckets last, so blocks stay small, and blocks of the same members are one. A block of more
than HOT_ROWS rows is dealt to several trees.

Only connection is asked for. In the first turn each set takes the least partner that its block's tree finds, and what
proves to be linked is contracted. Then only blocks that still hold several components count, and pairs across
components: in the second turn each set outside a block's largest component takes its best partner by the bound, in
the last turn the trees give all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.bits import bit_filter, filter_bits, hits, summed_chunks
from concordat.llm.stage import discard, materialise, small_batches
from concordat.llm.text import mix, pieces, shingles, words

WORDS = 5
#: The threshold in hundredths.
PERCENT = 75
#: Hash buckets of the order of tokens, counted in chunks; groups of a tree's point.
BUCKETS, CHUNK = 1 << 20, 1 << 14
GROUPS = 128
#: Rows of one block that one tree takes.
HOT_ROWS = 4096
MAX_BITS = 1 << 27
LEAF = 32
#: Pivots that a large block tries before its tree, at least, and the share of rows that lets it try one more.
PIVOTS, PIVOT_SHARE = 4, 16


def token_sets(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, tokens, offsets, set hashes): the sorted distinct shingles of each text; an empty set's hash is 0."""
    for a, _, raw, off in pieces(column):
        all_, cuts = shingles(words(raw, off), k)
        sets = [np.unique(all_[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        total = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
        value = mix(total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64) * np.uint64(0x14057B7EF767814F))
        yield a, flat, offsets, np.where(sizes > 0, value, np.uint64(0))


def packed(counts: np.ndarray) -> bytes:
    """Group counts as bytes, in 32 bits each if one of them needs it."""
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def fine_groups(n: int) -> int:
    """Groups of a set's finer point: two for each token, in a power of two."""
    return max(GROUPS, 1 << max(0, 2 * n - 1).bit_length())


def fine_point(tokens: np.ndarray) -> bytes:
    """The set's counts by a power of two of groups that grows with its size, compressed."""
    groups = fine_groups(len(tokens))
    counts = np.bincount((tokens >> np.uint64(24)).astype(np.int64) & (groups - 1), minlength=groups)
    wide = counts.max(initial=0) > 255
    return bytes([int(wide)]) + zlib.compress(counts.astype("<u4" if wide else "u1").tobytes(), 1)


def fine_bound(a: bytes, b: bytes) -> int:
    """At least as large as the intersection of the sets of two finer points. The groups of the smaller point are
    sums of those of the larger one, as groups are the low bits of one hash."""
    one, two = (np.frombuffer(zlib.decompress(x[1:]), "<u4" if x[0] else "u1").astype(np.int64) for x in (a, b))
    if len(one) > len(two):
        one, two = two, one
    return int(np.minimum(one, two.reshape(-1, len(one)).sum(axis=0)).sum())


def describe_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (doc_id, n_shingles, set, point, fine), and for each task and chunk of buckets one with
    counts: how many tokens fell into each bucket. Written once; everything later that needs no tokens reads it."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_shingles", "set", "point", "fine", "chunk", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            ids = batch.column(0)
            sizes, sets, points, fine = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64), [], []
            for a, flat, offsets, value in token_sets(batch.column(1)):
                sizes[a : a + len(value)], sets[a : a + len(value)] = np.diff(offsets), value
                total += np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                group = (flat >> np.uint64(40)).astype(np.int64) & (GROUPS - 1)
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    points.append(packed(np.bincount(group[x:y], minlength=GROUPS)))
                    fine.append(fine_point(flat[x:y]))
            nothing = [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sets.view(np.int64)), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), *nothing], names)
        if ids is not None:
            parts = [(k, zlib.compress(x.astype("<i8").tobytes(), 1)) for k, x in enumerate(total.reshape(-1, CHUNK)) if x.any()]
            if parts:
                m = len(parts)
                nothing = [pa.nulls(m, t) for t in (ids.type, pa.int64(), pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names)

    fields = f"doc_id {kind}, n_shingles long, set long, point binary, fine binary, chunk int, counts binary"
    return materialise(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scan, fields), "sets")


def bucket_counts(described: DataFrame) -> np.ndarray:
    """The tasks' counts added up: BUCKETS numbers whatever the input."""
    return summed_chunks(described.filter("chunk is not null").select("chunk", "counts"), BUCKETS, CHUNK, np.add)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def emit_prefixes(docs: DataFrame, text_col: str, counts: np.ndarray) -> DataFrame:
    """token, salt, salts, set, size, pos for the prefix of each set.

    The order of tokens is (count of the hash bucket, token), and pos a token's place in it among its set's. A token
    whose bucket stands out is dealt to several salts by the set that has it, so that no task gets all its rows.
    """
    spread = 1 + np.maximum(0, counts - 2 * int(counts.mean())) // HOT_ROWS
    shared = docs.sparkSession.sparkContext.broadcast((counts, np.minimum(spread, 1 << 20)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, salts = shared.value
        for batch in batches:
            for _, flat, offsets, names in token_sets(batch.column(0)):
                buckets = (flat & np.uint64(BUCKETS - 1)).astype(np.int64)
                rank, sizes = order[buckets], np.diff(offsets)
                new = np.zeros(len(names), dtype=bool)
                new[np.unique(names, return_index=True)[1]] = True
                rows = np.flatnonzero((sizes > 0) & new)
                if not len(rows):
                    continue
                # tokens are sorted, so a stable sort by rank orders by (rank, token)
                parts = [x + np.argsort(rank[x : x + n], kind="stable")[: prefix_length(n)] for x, n in zip(offsets[rows].tolist(), sizes[rows].tolist())]
                at, each = np.concatenate(parts), np.array([len(p) for p in parts])
                pos = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                name, size, many = np.repeat(names[rows], each), np.repeat(sizes[rows], each), salts[buckets[at]]
                salt = mix(name) % many.astype(np.uint64)
                columns = (flat[at].view(np.int64), salt.astype(np.int32), many.astype(np.int32), name.view(np.int64), size.astype(np.int32), pos.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "salts", "set", "size", "pos"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(scan, "token long, salt int, salts int, set long, size int, pos int")


def make_blocks(emitted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """block, part, parts, set, size, pos: what shares a token, if two sets or more do.

    Of two sets that link the smaller has its first common token among its first |A| (1 - 2t / (1 + t)) + 1 tokens, so
    a block without such a row has no pair. Tokens with the same members make one block, in which a set has its least
    pos. A token with several salts is one block in as many parts; a block beyond HOT_ROWS rows has more parts.
    """
    block = Window.partitionBy("token", "salt")
    h = F.xxhash64("set")
    # dealt before the window, which would else compute its inputs before the shuffle and send them along
    found = emitted.repartition("token", "salt").select(
        "*",
        F.count(F.lit(1)).over(block).alias("rows"),
        F.min("set").over(block).alias("lo"),
        F.max("set").over(block).alias("hi"),
        F.sum(F.shiftright(h, 32)).over(block).alias("s1"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).over(block).alias("s2"),
        F.min((100 + percent) * F.col("pos") - (100 - percent) * F.col("size")).over(block).alias("first"),
    )
    found = found.filter("(lo <> hi and first <= 0) or salts > 1")
    name = F.when(F.col("salts") > 1, F.xxhash64("token", F.lit("hot"))).otherwise(F.xxhash64("rows", "s1", "s2", "lo", "hi"))
    more = F.ceil(F.col("rows") / HOT_ROWS)
    part = (F.col("salt") * more + F.pmod(F.xxhash64("set", F.lit(1)), more)).cast("int")
    rows = found.select(name.alias("block"), part.alias("part"), (F.col("salts") * more).cast("int").alias("parts"), "set", "size", "pos")
    return materialise(rows.groupBy("block", "set").agg(F.first("part").alias("part"), F.max("parts").alias("parts"), F.first("size").alias("size"), F.min("pos").alias("pos")), "blocks")


def unpacked_points(column: pa.Array) -> np.ndarray:
    """A row of group counts for each packed point."""
    values = column.to_pylist()
    narrow = [len(x) == GROUPS for x in values]
    if all(narrow):
        return np.frombuffer(b"".join(values), "u1").reshape(-1, GROUPS)
    return np.stack([np.frombuffer(x, "u1" if k else "<u4").astype(np.int64) for x, k in zip(values, narrow)])


def _common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.minimum(one, two).sum(axis=1, dtype=np.int64)


class Block:
    """Rows that one tree takes, in the order of set: name, size, pos, comp, whether a row is of the block's largest
    component, and its role (1: searched, 2: asked, 3: both)."""

    FIELDS = ("set", "size", "pos", "comp", "major", "role")

    def __init__(self, columns: dict[str, np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.name, self.size, self.pos, self.comp, self.major, self.role = (columns[f] for f in self.FIELDS)

    def wanted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows, x before y, may link by components, roles, sizes and places in the order."""
        a, b, p = self.size[x], self.size[y], self.percent
        ok = (self.comp[x] != self.comp[y]) & (100 * np.minimum(a, b) >= p * np.maximum(a, b))
        ok &= (100 + p) * np.minimum(a - self.pos[x], b - self.pos[y]) >= p * (a + b)
        lx, rx, ly, ry = self.role[x] & 1, self.role[x] & 2, self.role[y] & 1, self.role[y] & 2
        return ok & (((lx > 0) & (ry > 0)) | ((ly > 0) & (rx > 0) & self.major[y]))

    def reaches(self, common: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * common >= self.percent * (self.size[x] + self.size[y])


def small_pairs(b: Block, points: pa.Array, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that the bound cannot exclude, and their bounds as shares, in many blocks whose tree is one leaf;
    block k has the rows from cuts[k, 0] to cuts[k, 1]. Blocks of equal length are compared together."""
    lengths, xs, ys = cuts[:, 1] - cuts[:, 0], [], []
    for m in np.unique(lengths[lengths > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        at = cuts[lengths == m, 0]
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(at), step):
            x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            ok = b.wanted(x, y)
            xs.append(x[ok])
            ys.append(y[ok])
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, y = np.concatenate(xs), np.concatenate(ys)
    common = np.zeros(len(x), np.int64)
    if len(x):
        rows, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        counts = unpacked_points(points.take(pa.array(rows)))
        for k in range(0, len(x), 1 << 16):
            s = slice(k, k + (1 << 16))
            common[s] = _common(counts[back[: len(x)][s]], counts[back[len(x) :][s]])
    ok = b.reaches(common, x, y)
    x, y = x[ok], y[ok]
    return x, y, common[ok] / (b.size[x] + b.size[y])


def tree_pairs(b: Block, points: np.ndarray, rows: np.ndarray, take) -> None:
    """Calls take(row, others, shares) with the pairs of rows that the bound cannot exclude, and the bound's shares.

    The tree is built from the top by halves along the coordinate that varies most, total size first; a node holds
    each coordinate's maximum, the range of sizes and its component if it has only one.
    """
    p = b.percent

    def visit(rows: np.ndarray, asked: np.ndarray) -> None:
        top, least, most = points[rows].max(axis=0), b.size[rows].min(), b.size[rows].max()
        q = b.size[asked]
        live = (100 * most >= p * q) & (100 * q >= p * least)
        if (b.comp[rows] == b.comp[rows[0]]).all():
            live &= b.comp[asked] != b.comp[rows[0]]
        asked = asked[live]
        asked = asked[(100 + p) * _common(points[asked], top) >= p * (b.size[asked] + least)]
        if not len(asked):
            return
        if len(rows) > LEAF:
            spans = np.append(np.ptp(points[rows], axis=0), most - least)
            key = b.size[rows] if spans[-1] >= spans[:-1].max() else points[rows, int(spans[:-1].argmax())]
            order = rows[np.argsort(key, kind="stable")]
            visit(order[: len(order) // 2], asked)
            visit(order[len(order) // 2 :], asked)
            return
        for row in rows.tolist():
            # asked rows are asked about searched rows, each pair once: unordered pairs count from the earlier row
            x, y = np.minimum(asked, row), np.maximum(asked, row)
            ok = (x != y) & b.wanted(x, y)
            if (b.role[row] & 2) > 0:
                ok &= (asked < row) | ((b.role[asked] & 1) == 0)
            x, y, other = x[ok], y[ok], asked[ok]
            if len(x):
                common = _common(points[other], points[row])
                ok = b.reaches(common, x, y)
                if ok.any():
                    take(row, other[ok], common[ok] / (b.size[x] + b.size[y])[ok])

    searched, asked = rows[(b.role[rows] & 1) > 0], rows[(b.role[rows] & 2) > 0]
    if len(searched) and len(asked):
        visit(searched, asked)


def least_partners(b: Block, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of one large block a partner each, if the bound leaves one, so that groups of copies give as many
    pairs as rows: first of some pivots, then the least that the tree finds."""
    xs, ys, tried = [], [], 0
    while len(rows) > LEAF:
        pivot, rest = rows[0], rows[1:]
        x = np.full(len(rest), pivot)
        ok = b.wanted(x, rest)
        ok[ok] = b.reaches(_common(points[rest[ok]], points[pivot]), x[ok], rest[ok])
        xs.append(x[ok])
        ys.append(rest[ok])
        tried, rows = tried + 1, rest[~ok]
        if tried >= PIVOTS and PIVOT_SHARE * int(ok.sum()) < len(rest):
            break
    least = np.full(len(b.name), len(b.name))
    tree_pairs(b, points, rows, lambda row, others, _: np.minimum.at(least, np.maximum(others, row), np.minimum(others, row)))
    y = np.flatnonzero(least < len(least))
    return np.concatenate([*xs, least[y]]), np.concatenate([*ys, y])


def best_partners(b: Block, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The partner of the largest share for each row outside the block's largest component that has one."""
    best, partner = np.zeros(len(b.name)), np.full(len(b.name), -1)

    def take(row: int, others: np.ndarray, shares: np.ndarray) -> None:
        better = (shares > best[others]) & ~b.major[others]
        best[others[better]], partner[others[better]] = shares[better], row
        k = int(shares.argmax())
        if not b.major[row] and shares[k] > best[row]:
            best[row], partner[row] = shares[k], others[k]

    tree_pairs(b, points, rows, take)
    y = np.flatnonzero(partner >= 0)
    return np.minimum(y, partner[y]), np.maximum(y, partner[y])


def all_pairs(b: Block, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [(rows[:0], rows[:0])]
    tree_pairs(b, points, rows, lambda row, others, _: found.append((np.minimum(others, row), np.maximum(others, row))))
    return tuple(np.concatenate(z) for z in zip(*found))


def _one_each(of: np.ndarray, order: tuple, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first pair in an order of each row of."""
    by = np.lexsort((*order, of))
    new = np.ones(len(by), bool)
    new[1:] = of[by][1:] != of[by][:-1]
    return x[by[new]], y[by[new]]


#: What a turn asks of a large block's tree.
LEAST, BEST, ALL = "least", "best", "all"


def search(gathered: DataFrame, turn: str) -> DataFrame:
    """Pairs (a, b), a < b, of sets that the trees of gathered blocks find: all of them, or one for each row."""
    ask = {LEAST: least_partners, BEST: best_partners, ALL: all_pairs}[turn]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            rows = lists.flatten()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            columns = {f: rows.field(f).to_numpy(zero_copy_only=False).astype(bool if f == "major" else np.int64) for f in Block.FIELDS}
            order = np.lexsort((columns["set"], np.repeat(np.arange(len(ends)), ends - starts)))
            b, points = Block({f: x[order] for f, x in columns.items()}), rows.field("point").take(pa.array(order))
            cuts = np.stack([starts, ends], axis=1)
            small = ends - starts <= LEAF
            x, y, share = small_pairs(b, points, cuts[small])
            if turn == LEAST:
                x, y = _one_each(y, (x,), x, y)
            elif turn == BEST:
                minor = ~b.major[np.concatenate([x, y])]
                x, y = _one_each(np.concatenate([x, y])[minor], (-np.tile(share, 2)[minor],), np.tile(x, 2)[minor], np.tile(y, 2)[minor])
            xs, ys = [x], [y]
            for k in np.flatnonzero(~small).tolist():
                here = np.arange(starts[k], ends[k])
                own = Block({f: x[here] for f, x in zip(Block.FIELDS, (b.name, b.size, b.pos, b.comp, b.major, b.role))})
                x, y = ask(own, unpacked_points(points.slice(starts[k], len(here))), np.arange(len(here)))
                xs.append(starts[k] + x)
                ys.append(starts[k] + y)
            pairs = np.unique(np.stack([b.name[np.concatenate(xs)], b.name[np.concatenate(ys)]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return gathered.select("rows").mapInArrow(run, "a long, b long")


def _gathered(rows: DataFrame, least: DataFrame, *keys: str) -> DataFrame:
    """A list of rows with their points for each tree; at most some HOT_ROWS rows each."""
    met = rows.join(least.select("set", "point"), "set")
    return met.groupBy(*keys).agg(F.collect_list(F.struct(*Block.FIELDS, "point")).alias("rows"))


def first_pairs(blocks: DataFrame, least: DataFrame) -> DataFrame:
    """Candidates of the first turn: a partner for each row from its tree, and the least sets of a block's parts."""
    rows = blocks.select("block", "part", "set", "size", "pos", F.col("set").alias("comp"), F.lit(False).alias("major"), F.lit(3).alias("role"))
    parts = blocks.filter("parts > 1").groupBy("block", "part").agg(F.min("set").alias("b"))
    over = parts.join(parts.groupBy("block").agg(F.min("b").alias("a")), "block").filter("a <> b").select("a", "b")
    return search(_gathered(rows, least, "block", "part"), LEAST).unionByName(over)


def cross_pairs(blocks: DataFrame, labels: DataFrame, least: DataFrame, turn: str) -> DataFrame:
    """Candidates of a later turn: what the trees of blocks with several components leave, across components.

    Up to HOT_ROWS rows one tree takes a block. Beyond that its rows are dealt to columns, those outside its largest
    component once more to lines, and a tree takes the column searched and the line asked for each crossing.
    """
    rows = blocks.join(labels, blocks["set"] == labels["node"], "left").select("block", "set", "size", "pos", F.coalesce("label", "set").alias("comp"))
    per = rows.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("n"))
    tops = per.groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.sum("n").alias("rows"), F.max("n").alias("most")).filter("rows > most")
    several = lambda n: F.ceil(n / HOT_ROWS).cast("int")
    tops = tops.select("block", "top", several(F.col("rows")).alias("columns"), several(F.col("rows") - F.col("most")).alias("lines"))
    mixed = rows.join(tops, "block").withColumn("major", F.col("comp") == F.col("top"))
    deal = lambda seed, n: F.pmod(F.xxhash64("set", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda c, line, role: F.struct(c.cast("int").alias("c"), line.cast("int").alias("l"), F.lit(role).alias("role"))
    searched = F.transform(upto("lines"), lambda i: cell(deal(2, "columns"), i, 1))
    asked = F.when(F.col("major"), F.array().cast("array<struct<c:int,l:int,role:int>>")).otherwise(F.transform(upto("columns"), lambda i: cell(i, deal(3, "lines"), 2)))
    cells = F.when(F.col("columns") == 1, F.array(cell(F.lit(0), F.lit(0), 3))).otherwise(F.concat(searched, asked))
    dealt = mixed.withColumn("cell", F.explode(cells)).select("block", "cell.c", "cell.l", "set", "size", "pos", "comp", "major", "cell.role")
    return search(_gathered(dealt, least, "block", "c", "l"), turn)


def _among(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of sets that occur in pairs (and a few more), picked by a Bloom filter before any shuffle."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set"))
    shared = sets.sparkSession.sparkContext.broadcast(bit_filter(ends, "set", filter_bits(2 * pairs.count(), MAX_BITS)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return sets.mapInArrow(pick, sets.schema)


def bounded(pairs: DataFrame, least: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (a, b) that the finer points cannot exclude."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    sets = _among(least.select("set", "n", "fine"), pairs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            common = np.array([fine_bound(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], dtype=np.int64)
            ok = ((100 + percent) * common >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    one = sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a"))
    two = sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b"))
    met = pairs.join(one, "a").join(two, "b")
    out = materialise(met.select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(keep, "a long, b long"), "bounded")
    discard(pairs)
    return out


def set_table(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, least: DataFrame) -> DataFrame:
    """set and tokens for the sets of wanted, each from the document with its least id.

    Those documents are found by a Bloom filter over ids, before any text is cut into tokens. A few others come along,
    some of them copies; what reads the table takes pairs as a set.
    """
    chosen = materialise(wanted.distinct().join(least.select("set", "doc"), "set").select(F.xxhash64("doc").alias("key")), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen, "key", filter_bits(chosen.count(), MAX_BITS)))
    discard(chosen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = hits(shared.value, batch.column(1).to_numpy(zero_copy_only=False))
            if not asked.any():
                continue
            for _, flat, offsets, names in token_sets(batch.column(0).filter(pa.array(asked))):
                rows = np.flatnonzero(names != 0)
                if not len(rows):
                    continue
                parts = [flat[x:y] for x, y in zip(offsets[rows].tolist(), offsets[rows + 1].tolist())]
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names[rows].view(np.int64)), tokens], ["set", "tokens"])

    return docs.select(F.col(text_col).cast("string"), F.xxhash64(id_col).alias("key")).mapInArrow(scan, "set long, tokens array<long>")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link, by the size of the intersection of their sets.

    Only the tokens of sets that occur in pairs are taken from the documents again and shuffled.
    """
    some = set_table(docs, id_col, text_col, pairs.select(F.explode(F.array("a", "b")).alias("set")), least)
    one = some.select(F.col("set").alias("a"), F.col("tokens").alias("tokens_a"))
    two = some.select(F.col("set").alias("b"), F.col("tokens").alias("tokens_b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    met = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    links = met.filter(100 * F.col("both") >= percent * (F.size("tokens_a") + F.size("tokens_b") - F.col("both")))
    return materialise(links.select("a", "b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of links; nodes are connected if and only if their labels are equal.

    Each round every node moves to its least neighbour and the links are contracted, until none is left. Rounds are
    written to the shared folder; nothing but the number of links left reaches the driver.
    """
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "edges")
    labels = materialise(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = materialise(ways.groupBy("u").agg(F.min("v").alias("to")).select("u", F.least("u", "to").alias("to")), "moves")
        step = lambda df, key: df.join(moved.withColumnRenamed("u", key), key, "left").withColumn(key, F.coalesce("to", key)).drop("to")
        old = labels, edges, moved
        labels = materialise(step(labels, "label").select("node", "label"), "labels")
        edges = materialise(step(step(edges, "u"), "v").filter("u <> v").select("u", "v").distinct(), "edges")
        discard(*old)
    discard(edges)
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: what they join gets one label."""

    def to(df: DataFrame, key: str) -> DataFrame:
        moves = labels.select(F.col("node").alias(key), F.col("label").alias("_to"))
        return df.join(moves, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")

    again = components(to(to(links, "a"), "b"))
    # a label that moves is a node of its own, so nodes that were in no component before come in as well
    known = labels.unionByName(again.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min_by("label", F.when(F.col("label") == F.col("node"), 1).otherwise(0)).alias("label"))
    moves = again.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    out = materialise(known.join(moves, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
    discard(again, labels)
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: the connected components of the Jaccard links.

    Words are runs of bytes other than white space (0x20, 0x09 to 0x0D) of the text lower-cased in A-Z only. A set is a
    text's distinct 5-word shingles (all its words if it has fewer); a null, empty or blank text has none and links
    with nothing. Rows with equal sets link, whatever their ids. component_id is the least id in the component; a null
    id counts only where no row of the component has another. Tokens and sets are told apart by 64-bit hashes. An empty
    table gives an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    described = describe_sets(docs, id_col, text_col)
    rows = described.filter("chunk is null").select("doc_id", "n_shingles", "set", "point", "fine")
    blocks = make_blocks(emit_prefixes(docs, text_col, bucket_counts(described)))
    linked = rows.filter("set <> 0").groupBy("set")
    least = materialise(linked.agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("point").alias("point"), F.first("fine").alias("fine")), "least")

    def check(pairs: DataFrame) -> DataFrame:
        near = bounded(pairs, least)
        out = verified(near, docs, id_col, text_col, least)
        discard(near)
        return out

    links = check(first_pairs(blocks, least))
    labels = components(links)
    discard(links)
    for turn in (BEST, ALL):
        links = check(cross_pairs(blocks, labels, least, turn))
        if not links.isEmpty():
            labels = merged(labels, links)
        discard(links)
    discard(blocks)
    placed = least.join(labels, least["set"] == labels["node"], "left").select("set", "doc", F.coalesce("label", "set").alias("label"))
    placed = materialise(placed, "placed")
    roots = placed.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_set = materialise(placed.join(roots, "label").select("set", "component_id"), "of-set")
    discard(placed, least, labels)
    linked = rows.filter("set <> 0").join(of_set, "set", "left").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.filter("set = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
