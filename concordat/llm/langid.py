"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction is a GRU whose input weights are a table by byte; gates are hard sigmoids and candidates softsigns, so
that a step costs no transcendental function. At every byte the two states give a distribution over languages; a
document's probabilities are the mean over its bytes. The network is trained by backpropagation through time on a
bounded sample of labelled windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.stage import small_batches
from concordat.llm.text import buffers

#: The bound of the training sample in documents, whose whole texts are learned from, and the bytes of a window.
FIT_DOCUMENTS, FIT_BYTES = 480, 80
HIDDEN = 8
#: Texts are labelled in stretches of so many bytes, each from a zero state; so many stretches go through a step at once.
STRETCH, WIDTH = 128, 1024
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights: by direction byte tables w (3H, 256) and recurrent u (3H, H); output v (classes, 2H) and c."""

    languages: list[str]
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray
    fields: tuple[str, ...] = field(default=("w", "u", "v", "c"), repr=False)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, draw(2, 3 * hidden, 256), draw(2, 3 * hidden, hidden), draw(len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32))


def _states(w: np.ndarray, u: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, H, width) of one direction over codes (steps, width), in the order given."""
    steps, width = codes.shape
    hidden = u.shape[1]
    two = 2 * hidden
    scale = np.ones((3 * hidden, 1), np.float32)
    scale[:two] = 0.25
    table, u = np.ascontiguousarray((w * scale).T), u * scale  # a gate is a quarter of its input and a half, cut to 0..1
    table[:, :two] += 0.5
    out = np.empty((steps, hidden, width), np.float32)
    h = np.zeros((hidden, width), np.float32)
    rows = np.empty((width, 3 * hidden), np.float32)
    a, b, n, d = (np.empty((k, width), np.float32) for k in (3 * hidden, 3 * hidden, hidden, hidden))
    gates, reset, update, fresh, back = a[:two], a[:hidden], a[hidden:two], a[two:], b[two:]
    for t in range(steps):
        np.take(table, codes[t], axis=0, out=rows, mode="clip")
        a[...] = rows.T
        np.matmul(u, h, out=b)
        gates += b[:two]
        np.clip(gates, 0, 1, out=gates)
        np.multiply(reset, back, out=n)
        n += fresh
        np.abs(n, out=d)
        d += 1
        n /= d
        if keep is not None:
            keep.append((h.copy(), reset.copy(), update.copy(), n.copy(), back.copy()))
        np.subtract(n, h, out=d)
        d *= update
        h = np.add(h, d, out=out[t])
    return out


def _posteriors(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Distributions (steps, classes, width) over languages at every position."""
    hidden = forward.shape[1]
    x = np.matmul(net.v[:, :hidden], forward)
    x += np.matmul(net.v[:, hidden:], backward)
    x += net.c
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _back(w: np.ndarray, u: np.ndarray, codes: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u of one direction by backpropagation through time; grad: of the states."""
    steps, hidden = len(kept), u.shape[1]
    du, das, dh = np.zeros_like(u), np.empty((steps, w.shape[0], codes.shape[1]), np.float32), np.zeros_like(kept[0][0])
    for t in range(steps - 1, -1, -1):
        h, r, z, n, un = kept[t]
        dh = dh + grad[t]
        dn = dh * z * (1 - np.abs(n)) ** 2
        dz = dh * (n - h) * (0.25 * ((z > 0) & (z < 1)))
        dr = dn * un * (0.25 * ((r > 0) & (r < 1)))
        da = das[t]
        da[:hidden], da[hidden : 2 * hidden], da[2 * hidden :] = dr, dz, dn
        db = np.concatenate([dr, dz, dn * r])
        du += db @ h.T
        dh = dh * (1 - z) + u.T @ db
    flat, rows = codes.ravel(), das.transpose(1, 0, 2).reshape(w.shape[0], -1)
    return np.stack([np.bincount(flat, weights=x, minlength=256) for x in rows]).astype(np.float32), du


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = 4, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network to labelled windows by Adam; every position of a window is an example of its label."""
    net = Network.fresh(sorted(set(labels)), hidden, seed)
    number = {x: i for i, x in enumerate(net.languages)}
    longest = max(map(len, windows))
    codes = np.zeros((len(windows), longest), np.intp)
    for row, x in zip(codes, windows):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    real = np.arange(longest) < np.array([len(x) for x in windows])[:, None]
    target = np.array([number[x] for x in labels])
    rng, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(getattr(net, k)) for _ in range(2)] for k in net.fields}, 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, mask = codes[rows].T, real[rows].T
            kept: tuple[list, list] = ([], [])
            forward, backward = _states(net.w[0], net.u[0], x, kept[0]), _states(net.w[1], net.u[1], x[::-1], kept[1])
            error = _posteriors(net, forward, backward[::-1])
            error[:, target[rows], np.arange(len(rows))] -= 1
            error *= mask[:, None, :] / mask.sum()
            grads = {"c": error.sum(axis=(0, 2))[:, None], "v": np.concatenate([np.einsum("tkb,thb->kh", error, s) for s in (forward, backward[::-1])], axis=1)}
            into = np.matmul(net.v.T, error)
            parts = (_back(net.w[0], net.u[0], x, kept[0], into[:, :hidden]), _back(net.w[1], net.u[1], x[::-1], kept[1], into[::-1, hidden:]))
            grads["w"], grads["u"] = (np.stack(p) for p in zip(*parts))
            step += 1
            scale = min(1.0, 1.0 / max(1e-6, float(np.sqrt(sum((g * g).sum() for g in grads.values())))))
            pace = rate * (1 - (step - 1) / total)
            for k, g in grads.items():
                m, s = moments[k]
                m += 0.1 * (g * scale - m)
                s += 0.01 * ((g * scale) ** 2 - s)
                getattr(net, k).__isub__(pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8))
    return net


def document_probabilities(net: Network, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean distribution over the bytes of each text; zeros for an empty text. Every byte of every text is labelled.

    A text is read in stretches of STRETCH bytes, both directions of each from a zero state, so a byte's label depends
    on its stretch only, as in training on windows.
    """
    sizes = np.diff(off)
    each = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = off[owner] + place * STRETCH
    length = np.minimum(STRETCH, off[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate([raw, np.zeros(STRETCH, np.uint8)])
    for at in range(0, len(order), WIDTH):
        rows = order[at : at + WIDTH]
        n = length[rows]
        steps = int(n[0])
        real = np.arange(steps)[:, None] < n
        codes = np.where(real, padded[start[rows] + np.arange(steps)[:, None]], 0).astype(np.intp)
        # the backward direction meets a short stretch's end first, so its filling comes last there too
        last = np.where(real, padded[start[rows] + np.maximum(n - 1 - np.arange(steps)[:, None], 0)], 0).astype(np.intp)
        forward, back = _states(net.w[0], net.u[0], codes), _states(net.w[1], net.u[1], last)
        if steps and n[-1] < steps:
            turned = np.maximum(n - 1 - np.arange(steps)[:, None], 0)
            backward = np.take_along_axis(back, turned[:, None, :], axis=0)
        else:
            backward = back[::-1]
        p = _posteriors(net, forward, backward)
        p *= real[:, None, :]
        np.add.at(out, owner[rows], p.sum(axis=0).T)
    return out / np.maximum(sizes, 1)[:, None]


ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray) -> bool:
    return bool(ASCII_LETTER[data].any()) or bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def held_out(id_col: str, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether the CRC-32 of an id as text has the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = FIT_DOCUMENTS) -> Network | None:
    """A network trained on the whole texts of so many labelled documents that are not held out; None if there are
    none with a letter.

    The documents are those with the least hashes of id and text, so the choice does not depend on how the table is
    stored. A hash threshold from their number leaves about twice as many for the driver to choose from.
    """
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1).alias("order")
    )
    n, parts = rows.count(), 1 << 20
    least = lambda some: some.orderBy("order", "lang", "text").limit(documents).collect()
    found = least(rows.filter(F.shiftright("order", 43) < min(parts, -(-2 * documents * parts // max(n, 1)))))
    if len(found) < min(n, documents):  # many rows that are alike
        found = least(rows)
    pairs = sorted({(x, r["lang"]) for r in found for x in _windows(r["text"])})
    return train([x for x, _ in pairs], [y for _, y in pairs]) if pairs else None


def _windows(text: str) -> list[bytes]:
    """The whole text in windows of FIT_BYTES bytes, without those that have no letter."""
    data = text.encode()
    cut = [data[i : i + FIT_BYTES] for i in range(0, len(data), FIT_BYTES)]
    return [x for x in cut if has_letter(np.frombuffer(x, np.uint8))]


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: a learned language and its mean probability over all bytes of the text.

    A null or empty text and one without letters are und with score 0, as is every text where nothing could be
    learned. Only the text decides. Columns named lang_pred or score are replaced, all others pass unchanged; an empty
    table gives an empty table.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)
    names = [*docs.columns, "lang_pred", "score"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            raw, off = buffers(batch.column(at))
            known = np.array([has_letter(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], dtype=bool) & (net is not None)
            langs, scores = np.full(len(known), UNDETERMINED, dtype=object), np.zeros(len(known))
            if known.any():
                p = document_probabilities(net, raw, off)
                langs[known] = np.array(net.languages, dtype=object)[p.argmax(axis=1)][known]
                scores[known] = np.clip(p.max(axis=1)[known], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names)

    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
