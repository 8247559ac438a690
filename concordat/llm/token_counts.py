"""Tokens of whole documents attributed to the sections that they lie in.

A document is encoded once. Token character spans come from the byte lengths of the tokens; spans and sections are
both ordered, so the interval join is a binary search of token places among section starts. A token that crosses a
boundary is allocated by a rule: to the section of its first character, of its last, or of most of its characters
(of equal parts the earlier).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.bpe import load_ranks
from concordat.llm.stage import small_batches
from concordat.llm.text import buffers

RULES = ("first", "last", "most")

_encoders: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str) -> tuple:
    """A tiktoken encoding of a rank file and the byte length of each id."""
    if (path, pattern) not in _encoders:
        import tiktoken

        ranks = load_ranks(path)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            sizes[i] = len(piece)
        _encoders[path, pattern] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[path, pattern]


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (included) of each token; a token that holds part of a character counts it."""
    encoding, sizes = encoder(path, pattern)
    ids = np.asarray(encoding.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(sizes[ids])
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1 if len(data) > len(text) else np.arange(len(data))
    return char[ends - sizes[ids]], char[ends - 1]


def line_sections(text: str) -> np.ndarray:
    """Starts of a text's lines; a line has its line end, and sections fill the text."""
    data = np.frombuffer(text.encode("utf-32-le"), "<u4")
    after = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], after[after < len(data)]])


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a section's boundary."""
    a, b = (np.searchsorted(starts, x, side="right") - 1 for x in (first, last))
    crossing = a != b
    if rule == "last":
        return b, crossing
    if rule == "most" and crossing.any():
        a = a.copy()
        for i in np.flatnonzero(crossing).tolist():
            bounds = np.append(starts[a[i] : b[i] + 1].clip(min=first[i]), last[i] + 1)
            a[i] += int(np.diff(bounds).argmax())
    return a, crossing


def section_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """A row for each line of each text: doc_id, section, start, end, n_tokens, n_crossing.

    start and end are character offsets and a line's end belongs to it; n_crossing counts the section's tokens that
    reach into another one. The n_tokens of a document's rows add up to the tokens of the whole text. A null or empty
    text has one section, from 0 to 0, without tokens. Rows that share a doc_id are handled one by one; other columns
    are not read.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            data, parts = raw.tobytes(), []
            for i in range(batch.num_rows):
                text = data[off[i] : off[i + 1]].decode()
                starts = line_sections(text)
                k = len(starts)
                if text:
                    section, crossing = allocate(*token_spans(text, path, pattern), starts, rule)
                    tokens, crossed = np.bincount(section, minlength=k), np.bincount(section[crossing], minlength=k)
                else:
                    tokens = crossed = np.zeros(1, np.int64)
                parts.append((np.full(k, i), np.arange(k), starts, np.append(starts[1:], len(text)), tokens, crossed))
            rows, *values = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, values)], names)

    fields = f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, fields)
