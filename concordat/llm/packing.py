"""Packing of documents into training sequences by power-of-two decomposition.

The token ids of a document are cut into the powers of two that its length is the sum of, the longest first, with
pieces of the largest sequence length as often as they fit. Every piece is a sequence of its own: no sequence crosses
documents and none is padded. Pieces of one length share a bucket, from which batches of equal shape are drawn.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.memory import Memory
from concordat.llm.stage import small_batches
from concordat.llm.text import LOWER_BYTES, buffers

MAX_LENGTH = 4096
END_ID = 2
#: Words, and words without punctuation at their end, whose ids a Python worker remembers, twice over.
WORDS, CORES = 500_000, 700_000
#: Punctuation that is cut from a word's end; a run of it is a token run of its own after a letter or digit.
TAIL = b".,!?;:$%&*#|"

_tokenizers: dict[str, tuple] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The public pattern that splits text before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(path: str) -> tuple:
    """The tokenizer of a file, the ids of words that this worker has met, and its special tokens in lower case."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        special = [x.content.lower().encode() for x in found.get_added_tokens_decoder().values()]
        _tokenizers[path] = (found, Memory(WORDS), Memory(CORES), special)
    return _tokenizers[path]


def _core(word: bytes) -> bytes:
    """word without the punctuation at its end, if a letter or digit stands before that, in the form that the tokenizer
    gives it: the lower case or composed form of some letters ends in a mark, which punctuation joins."""
    core = word.rstrip(TAIL)
    if not core or len(core) == len(word) or (core[-1] < 128 and not core[-1:].isalnum()):
        return word
    return core if core[-1] < 128 or unicodedata.normalize("NFC", core.decode().lower())[-1].isalpha() else word


def _encode_words(tokenizer, words: list[bytes]) -> list[bytes]:
    """Ids of words, encoded as one text with blanks between; a token is its word's by the place where it begins."""
    joined = b" ".join(words).decode()
    starts = np.cumsum([0, *(len(w.decode()) + 1 for w in words[:-1])])
    found = tokenizer.encode(joined, add_special_tokens=False)
    ids, places = np.array(found.ids, dtype="<u4"), np.array([a for a, _ in found.offsets], dtype=np.int64)
    cuts = np.searchsorted(places, np.append(starts, len(joined) + 1), side="left") * 4
    data = ids.tobytes()
    return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of UTF-8 texts by the tokenizers library, without special tokens, as little-endian 32-bit integers.

    The tokenizer lower-cases, drops white space and never joins what it separates, so a text's ids are those of its
    words one after another. Words, cut at ASCII white space, are encoded once and remembered. A-Z is lower-cased
    before, where no combining mark can change what that does. A text with a special token's characters, which the
    library takes as that token before it lower-cases, is encoded as it is.
    """
    tokenizer, known, cores, special = _encoder(path)
    low = [t.translate(LOWER_BYTES) for t in texts]
    whole = {i: np.array(tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4").tobytes() for i, t in enumerate(low) if any(x in t for x in special)}
    split = [[] if i in whole else (t if b"\xcc" in t or b"\xcd" in t else low[i]).split() for i, t in enumerate(texts)]
    fresh = {w: _core(w) for w in known.missing(set().union(*split))}
    tails = {w: w[len(c) :] for w, c in fresh.items()}
    todo = list(cores.missing({*fresh.values(), *filter(None, tails.values())}))
    for at in range(0, len(todo), 4096):
        part = todo[at : at + 4096]
        cores.now.update(zip(part, _encode_words(tokenizer, part)))
    for w, c in fresh.items():
        known.now[w] = cores.now[c] + cores.now[tails[w]] if tails[w] else cores.now[c]
    get = known.now.__getitem__
    return [whole[i] if i in whole else b"".join(map(get, words)) for i, words in enumerate(split)]


def decompose(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """The lengths of the pieces of n tokens: longest as often as it fits, then the binary digits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (array of int), doc_tokens, sequence_id, offset, bucket.

    start counts the document's ids before the piece, doc_tokens all with the end id. sequence_id is distinct over
    all pieces (a partition's number and a row's); offset is 0, as a piece is a whole sequence; bucket is the base-2
    logarithm of length. A null or empty text is the end id alone. Rows with the same doc_id, or the same text, are
    packed one by one. Other columns are not read. An empty table gives an empty table.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            data, off = raw.tobytes(), off.tolist()
            ends, keys = np.array([end_id], "<u4").tobytes(), batch.column(0)
            for first in range(0, len(keys), 256):
                bounds = off[first : first + 257]
                ids = [x + ends for x in encode_texts([data[a:b] for a, b in zip(bounds, bounds[1:])], path)]
                rows, start, length, total, crc = [], [], [], [], []
                for i, x in enumerate(ids):
                    n, at = len(x) // 4, 0
                    for k in decompose(n, longest):
                        rows.append(first + i)
                        start.append(at)
                        length.append(k)
                        total.append(n)
                        crc.append(zlib.crc32(x[4 * at : 4 * (at + k)]))
                        at += k
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                cuts = np.zeros(len(length) + 1, np.int32)
                np.cumsum(length, out=cuts[1:])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), flat), pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long")
    return pieces.select(
        "doc_id",
        "start",
        "length",
        "ids",
        "ids_crc32",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces as Parquet, one folder a length, so that a reader of one folder gets batches of one shape."""
    pieces.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The pieces of one length that write_buckets has put into its folder; only that folder is read."""
    return spark.read.parquet(path).filter(F.col("bucket") == length.bit_length() - 1)


def pack_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() with the CRC-32 of each piece's ids in place of the ids."""
    return pack(docs, path, id_col, text_col).drop("ids")
