"""Byte-level BPE by DuckDB recursive queries, one database in each Python worker.

A batch of texts is cut into units at single blanks between other characters, where a match of the split pattern
always begins; units and matches seen before are taken from a bounded memory. The other matches become rows of token
positions. Each step of the recursive query joins neighbouring tokens with the merge table and contracts every word's
leftmost pair of minimum rank, until no word has a pair left; an aggregation ordered by position gives the ids.

Decoding starts from ids alone: rows of id positions join the vocabulary, and an aggregation ordered by position puts
the bytes together. Runs of ids that were decoded before come from a bounded memory whose keys are the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.memory import Memory
from concordat.llm.stage import small_batches
from concordat.llm.text import buffers

#: Stretches of more bytes that some token could cross everywhere are contracted with a heap, to the same result: a
#: step of the query contracts one pair of a word, so a word of n bytes costs it n * n row visits.
LONGEST = 1024
#: Units and matches that a worker remembers, twice over, and matches that go into one query.
UNITS, MATCHES, QUERY_WORDS = 500_000, 800_000, 150_000

ENCODE = """
CREATE OR REPLACE TEMP TABLE tokens AS
WITH RECURSIVE t(step, w, pos, id, np, nid, key) AS (
    SELECT 0, w, pos, id, np, nid, c * 65536 + pos
    FROM start LEFT JOIN merges ON ab = id::BIGINT * 65536 + nid
  UNION ALL
    SELECT step, w, pos, id, np, nid, CASE WHEN changed THEN c * 65536 + pos ELSE key END
    FROM (SELECT t.step + 1 AS step, t.w, t.pos,
                 CASE WHEN t.pos = p THEN merged ELSE id END AS id,
                 CASE WHEN t.pos = p THEN after_np ELSE np END AS np,
                 CASE WHEN t.pos = p THEN after_nid WHEN np = p THEN merged ELSE nid END AS nid,
                 t.pos = p OR np = p AS changed, key
          FROM t JOIN (SELECT m.w, m.best % 65536 AS p, m.best // 65536 AS merged, a.np AS q, b.np AS after_np, b.nid AS after_nid
                       FROM (SELECT w, min(key) AS best FROM t GROUP BY w HAVING min(key) IS NOT NULL) m
                       JOIN t a ON a.w = m.w AND a.pos = m.best % 65536
                       JOIN t b ON b.w = m.w AND b.pos = a.np) x ON x.w = t.w
          WHERE t.pos <> q) n
    LEFT JOIN merges ON changed AND ab = id::BIGINT * 65536 + nid)
SELECT w, pos, id FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step)
"""
#: A token's bytes stand in the vocabulary as characters of the same numbers.
DECODE = "SELECT w, string_agg(bytes, '' ORDER BY pos) AS bytes FROM given_ids JOIN vocabulary USING (id) GROUP BY w"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file; a token's rank is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one vocabulary, with a DuckDB database in memory."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self._matches = regex.compile(pattern).findall
        self._touching = regex.compile(r" \s|\s ").search
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = [(a * 65536 + b, c) for piece, c in self.ranks.items() for k in range(1, len(piece)) if (a := self.ranks.get(piece[:k])) is not None and (b := self.ranks.get(piece[k:])) is not None]
        tables = {
            "merges": {"ab": pa.array([x for x, _ in merges], pa.int64()), "c": pa.array([y for _, y in merges], pa.int64())},
            "vocabulary": {"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array([x.decode("latin-1") for x in self.ranks])},
        }
        for name, columns in tables.items():
            self._db.register("given", pa.table(columns))
            self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self._db.unregister("given")
        self._bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self._known, self._runs = Memory(MATCHES), Memory(MATCHES)  # ids of matches, bytes of runs of ids
        self._units = Memory(UNITS)  # runs of ids of units, one for each match
        self._inner = {piece[i : i + 2] for piece in self.ranks for i in range(len(piece) - 1)}

    def _positions(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(x) for x in words])
        ends = np.cumsum(n)
        ids = self._bytes[np.frombuffer(b"".join(words), np.uint8)]
        at = np.arange(len(ids)) - np.repeat(ends - n, n)
        last = np.zeros(len(ids), dtype=bool)
        last[ends - 1] = True
        columns = {"w": np.repeat(np.arange(len(words)), n), "pos": at, "id": ids, "np": np.where(last, -1, at + 1), "nid": np.where(last, -1, np.append(ids[1:], -1))}
        return pa.table({k: pa.array(v.astype(np.int32)) for k, v in columns.items()})

    def _query(self, words: list[bytes]) -> None:
        self._db.register("start", self._positions(words))
        self._db.execute(ENCODE)
        self._db.unregister("start")
        found = self._db.execute("SELECT w, id FROM tokens ORDER BY w, pos").fetchnumpy()
        data = found["id"].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(found["w"], np.arange(len(words) + 1))).tolist()
        self._known.now.update(zip(words, (data[a:b] for a, b in zip(cuts, cuts[1:]))))

    def _decode(self, runs: set[bytes]) -> None:
        """Remember what runs of ids, as little-endian 32-bit integers, decode to."""
        todo = list(self._runs.missing(runs))
        for first in range(0, len(todo), QUERY_WORDS):
            part = todo[first : first + QUERY_WORDS]
            n = np.array([len(x) // 4 for x in part])
            ids = np.frombuffer(b"".join(part), "<i4")
            at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            self._db.register("given_ids", pa.table({"w": pa.array(np.repeat(np.arange(len(part)), n)), "pos": pa.array(at), "id": pa.array(ids)}))
            self._runs.now.update(dict.fromkeys(part, b""))
            self._runs.now.update((part[w], x.encode("latin-1")) for w, x in self._db.execute(DECODE).fetchall())
            self._db.unregister("given_ids")

    def _stretches(self, word: bytes) -> list[bytes]:
        """word cut wherever no token has both neighbouring bytes inside: nothing is ever contracted across."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self._inner), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _heap(self, word: bytes) -> bytes:
        """The same contraction for a long match, in time n log n: the pairs lie in a heap by rank and position."""
        parts, n = [word[i : i + 1] for i in range(len(word))], len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = lambda i: self.ranks.get(parts[i] + parts[after[i]]) if after[i] < n else None
        heap = [(r, i, 2) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or len(parts[i]) + len(parts[after[i]]) != size or rank(i) != r:
                continue
            j = after[i]
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[after[k]])))
        kept = [p for p, a in zip(parts, alive) if a]
        return np.array([self.ranks[p] for p in kept], "<u4").tobytes()

    def _cut(self, text: str) -> list[str]:
        if self._touching(text):
            return self._matches(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _encode(self, matches: set[bytes]) -> None:
        """Remember the ids of matches."""
        todo, long = [], {}
        for m in matches:
            if m in self.ranks:
                self._known.now[m] = np.array([self.ranks[m]], "<u4").tobytes()
            elif len(m) > LONGEST:
                long[m] = self._stretches(m)
            else:
                todo.append(m)
        if long:
            parts = set().union(*long.values()).difference(long)
            self._encode(parts.difference(self._known.now, todo))
        for at in range(0, len(todo), QUERY_WORDS):
            self._query(todo[at : at + QUERY_WORDS])
        for m, parts in long.items():
            self._known.now[m] = self._heap(m) if len(parts) == 1 else b"".join(self._known.now[x] for x in parts)

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, as little-endian 32-bit integers, and the bytes that these ids decode to."""
        cuts = [self._cut(t) for t in texts]
        split = {u: [m.encode() for m in self._matches(u)] for u in self._units.missing(set().union(*cuts))}
        self._encode(self._known.missing(set().union(*split.values())))
        known, now, get = self._known.now, self._units.now, self._units.now.__getitem__
        for u, ms in split.items():
            now[u] = [known[m] for m in ms]
        self._decode(set(chain.from_iterable(map(get, split))))
        out = []
        for units in cuts:
            runs = list(chain.from_iterable(map(get, units)))
            try:
                text = b"".join(map(self._runs.now.__getitem__, runs))
            except KeyError:  # runs of ids that were decoded long ago, or never
                self._decode(set(runs))
                text = b"".join(map(self._runs.now.__getitem__, runs))
            out.append((b"".join(runs), text))
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, texts_at_once: int = 1 << 22) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (binary) of every text; with digests SHA-256 values instead.

    Each match of the pattern is encoded on its own, without special tokens. A null or empty text has no ids. Rows are
    handled one by one; other columns are not read. A batch is encoded in parts of about texts_at_once bytes.
    """
    small_batches(docs.sparkSession, 1024)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(path, pattern)
        for batch in batches:
            raw, off = buffers(batch.column(1))
            data, first, n = raw.tobytes(), 0, batch.num_rows
            while first < n:
                last = max(first + 1, int(np.searchsorted(off, off[first] + texts_at_once, side="right")) - 1)
                both = worker.encode_decode([data[off[i] : off[i + 1]].decode() for i in range(first, last)])
                count = pa.array([len(x) // 4 for x, _ in both], pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in zip(*both)]
                else:
                    cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x, _ in both])]).astype(np.int32))
                    rest = [pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(b"".join(x for x, _ in both), "<i4"))), pa.array([y for _, y in both], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), count, *rest], ["doc_id", "n_tokens", "ids", "decoded"])
                first = last

    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, " + ("ids string, decoded string" if digests else "ids array<int>, decoded binary"))
    return found.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digests else found
