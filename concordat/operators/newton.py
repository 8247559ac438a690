"""Maximum likelihood by Newton's method, where every round is one pass over a stored table.

A model is a function from the columns of a batch and the parameters to sums: log-likelihood, gradient and second
derivatives. Tasks add them up over their batches, executors over tasks, and the driver gets a fixed number of
figures a round, whatever the number of rows. Several fits of one model, such as the replicates of a bootstrap, share
each pass as the rows of one matrix of parameters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.sources.files import workspace

#: Figures of one row that tasks hand on.
CHUNK = 1 << 14
#: Rows that are computed at once.
ROWS = 1024
#: Levels of a factor at most: each is a parameter.
LEVELS = 500


@dataclass
class Fit:
    """params: a row a fit; information: minus the second derivatives there; converged: a flag a fit; bounded: whether
    the likelihood has one maximum, which separated outcomes and regressors that follow from others take from it."""

    names: list[str]
    params: np.ndarray
    loglik: np.ndarray
    information: np.ndarray
    converged: np.ndarray
    bounded: np.ndarray

    @property
    def estimates(self) -> np.ndarray:
        """params, not a number where there is no single maximum."""
        return np.where(self.bounded[:, None], self.params, np.nan)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, so that each round scans a table instead of its making."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def factor(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level but the least, and the names of those."""
    levels = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(LEVELS + 1).collect()]
    if len(levels) > LEVELS:
        raise ValueError(f"{column} has more than {LEVELS} levels")
    names = [f"{column}_{x}" for x in levels[1:]]
    return df.withColumns({n: (F.col(column) == x).cast("double") for n, x in zip(names, levels[1:])}), names


def added_up(table: DataFrame, columns: list[str], sums: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of size figures; sums gets a matrix of at most ROWS rows of the columns, as doubles."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            for at in range(0, len(x), ROWS):
                total += sums(x[at : at + ROWS])
        for k in range(0, size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k : k + CHUNK]])], ["place", "figures"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, figures in zip(batch.column(0).to_pylist(), batch.column(1)):
                met[k] = met.get(k, 0) + figures.values.to_numpy()
        for k, figures in met.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([figures])], ["place", "figures"])

    kind = "place long, figures array<double>"
    rows = table.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(part, kind).repartition("place").mapInArrow(add, kind).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["place"] : r["place"] + len(r["figures"])] = r["figures"]
    return out


def curved(first: np.ndarray, last: np.ndarray, least: float = 1e-11) -> bool:
    """Whether no direction has lost all of the information that it had at the start, and each had some.

    Where a maximum lies at infinity, rounds go on until a direction's weights m (1 - m) are some 1e-15; a finite one
    with weights below least would need more rows than its inverse.
    """
    size = np.sqrt(np.maximum(np.diag(first), 0))
    if not (size > 0).all() or not np.isfinite(last).all():
        return False
    values, vectors = np.linalg.eigh(first / np.outer(size, size))
    if values[0] < 1e-13 * len(size):
        return False
    unit = vectors / np.sqrt(values) / size[:, None]
    return bool(np.linalg.eigvalsh(unit.T @ last @ unit)[0] > least)


def newton(names: list[str], start: np.ndarray, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 60, close: float = 1e-18) -> Fit:
    """Rounds from start, a row a fit; sums gives (log-likelihoods, gradients, information) of such rows.

    A step that lowers a fit's likelihood is halved. A fit has converged when its step would gain less than close.
    """
    at = np.array(start, float)
    value, gradient, information = sums(at)
    first = information.copy()
    done = np.zeros(len(at), bool)
    step = np.zeros_like(at)
    halved = np.zeros(len(at), int)
    fresh = np.ones(len(at), bool)
    for _ in range(rounds):
        for r in np.flatnonzero(fresh & ~done):
            step[r] = np.linalg.lstsq(information[r], gradient[r], rcond=None)[0]
            done[r] = abs(gradient[r] @ step[r]) < close * max(1.0, abs(value[r]))
        if done.all():
            break
        tried = np.where(done[:, None], at, at + step)
        got = sums(tried)
        better = ~done & np.isfinite(got[0]) & (got[0] >= value - 1e-12 * np.abs(value))
        for old, new in zip((at, value, gradient, information), (tried, *got)):
            old[better] = new[better]
        worse = ~done & ~better
        step[worse] /= 2
        halved = np.where(worse, halved + 1, 0)
        fresh = better
        done |= halved > 30
    bounded = np.array([curved(a, b) for a, b in zip(first, information)])
    return Fit(names, at, value, information, done & (halved <= 30), bounded)


def logistic(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def upper(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def square(flat: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from rows of their upper halves."""
    out = np.zeros((*flat.shape[:-1], p, p))
    i, j = upper(p)
    out[..., i, j] = flat
    out[..., j, i] = flat
    return out


def logit(table: DataFrame, outcome: str, terms: list[str], weights: np.ndarray | None = None, period: str | None = None, start: np.ndarray | None = None) -> Fit:
    """Binary logistic regression on terms and an intercept; rows with a null in any of the columns are left out.

    With weights, a matrix of fits by periods, and period, a column of whole numbers from 0, every row counts in each
    fit as often as the weight of its period says.
    """
    names = ["intercept", *terms]
    p, fits = len(names), 1 if weights is None else len(weights)
    half = p * (p + 1) // 2
    i, j = upper(p)

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def sums(rows: np.ndarray) -> np.ndarray:
            y, x = rows[:, :1], np.column_stack([np.ones(len(rows)), rows[:, 1 : p]])
            w = 1.0 if weights is None else weights[:, rows[:, p].astype(int)].T
            eta = x @ beta.T
            m = logistic(eta)
            gain = (w * (y * eta - np.logaddexp(0, eta))).sum(axis=0)
            return np.concatenate([gain, ((w * (y - m)).T @ x).ravel(), ((w * m * (1 - m)).T @ (x[:, i] * x[:, j])).ravel()])

        columns = [outcome, *terms] + ([period] if weights is not None else [])
        got = added_up(known, columns, sums, fits * (1 + p + half))
        return got[:fits], got[fits : fits * (1 + p)].reshape(fits, p), square(got[fits * (1 + p) :].reshape(fits, half), p)

    known = table.dropna(subset=[outcome, *terms])
    return newton(names, np.zeros((fits, p)) if start is None else start, at)


def cluster_covariance(fit: Fit, table: DataFrame, outcome: str, terms: list[str], cluster: str) -> np.ndarray:
    """The sandwich of a logit's information and the scores added up by cluster, times g / (g - 1) for g clusters.

    Scores are added up by one aggregation, partly before the shuffle, so that a cluster of any size is fine; their
    outer products by another pass over the clusters. A null cluster is one of its own. Without a single maximum
    nothing is known of any of it.
    """
    if not fit.bounded[0]:
        return np.full_like(fit.information[0], np.nan)
    beta, known = fit.params[0], table.dropna(subset=[outcome, *terms])
    eta = F.lit(float(beta[0]))
    for b, t in zip(beta[1:], terms):
        eta = eta + F.lit(float(b)) * F.col(t).cast("double")
    left = known.withColumn("_left", F.col(outcome).cast("double") - 1 / (1 + F.exp(-eta)))
    scores = left.groupBy(cluster).agg(F.sum("_left").alias("_s0"), *(F.sum(F.col("_left") * F.col(t)).alias(f"_s{k}") for k, t in enumerate(terms, 1)))
    p = len(beta)
    got = added_up(scores, [f"_s{k}" for k in range(p)], lambda s: np.append(s.T @ s, len(s)), p * p + 1)
    bread, g = np.linalg.inv(fit.information[0]), got[-1]
    return g / max(g - 1, 1) * bread @ got[:-1].reshape(p, p) @ bread


def bootstrap_periods(table: DataFrame, outcome: str, terms: list[str], period: str, replicates: int = 1000, seed: int = 0) -> tuple[Fit, Fit, list]:
    """(the fit over all periods, the fits over periods drawn with replacement, the periods).

    Each replicate draws as many periods as there are, so that a row weighs as often as its period was drawn; all
    replicates go through the rows together. The draws depend on the seed alone.
    """
    known = table.dropna(subset=[outcome, *terms, period])
    periods = [r[0] for r in known.select(period).distinct().orderBy(period).limit(LEVELS + 1).collect()]
    if len(periods) > LEVELS:
        raise ValueError(f"{period} has more than {LEVELS} values")
    place = F.array_position(F.array(*map(F.lit, periods)), F.col(period)) - 1 if periods else F.lit(0)
    rows = stored(known.select(outcome, *terms, place.cast("int").alias("_period")), "periods")
    whole = logit(rows, outcome, terms)
    drawn = np.random.default_rng(seed).integers(0, max(1, len(periods)), (replicates, len(periods)))
    weights = np.stack([np.bincount(d, minlength=len(periods)) for d in drawn]).astype(float) if len(periods) else np.zeros((replicates, 0))
    again = logit(rows, outcome, terms, weights, "_period", np.repeat(whole.params, replicates, axis=0))
    return whole, again, periods


def ordered_logit(table: DataFrame, outcome: str, terms: list[str], levels: int) -> Fit:
    """P(y <= k) = logistic(threshold k - x b) for outcomes 0 to levels - 1; the parameters are b, then the thresholds.

    Rows with a null in any of the columns are left out. Thresholds start from the shares of the levels.
    """
    p, m = len(terms), levels - 1
    names = [*terms, *(f"{k}|{k + 1}" for k in range(m))]
    known = table.dropna(subset=[outcome, *terms])
    n = added_up(known, [outcome], lambda rows: np.bincount(rows[:, 0].astype(int), minlength=levels).astype(float), levels)
    share = np.clip(np.cumsum(n)[:-1] / max(n.sum(), 1), 1e-6, 1 - 1e-6)
    half = (p + m) * (p + m + 1) // 2
    i, j = upper(p + m)

    def at(params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, cuts = params[0, :p], params[0, p:]
        if (np.diff(cuts) <= 0).any():
            return np.array([-math.inf]), np.zeros((1, p + m)), np.zeros((1, p + m, p + m))

        def sums(rows: np.ndarray) -> np.ndarray:
            y, x = rows[:, 0].astype(int), rows[:, 1:]
            ends = np.concatenate([[-math.inf], cuts, [math.inf]])
            eta = x @ b
            high, low = logistic(ends[y + 1] - eta), logistic(ends[y] - eta)
            high[y == m], low[y == 0] = 1, 0
            both = np.maximum(high - low, 1e-300)
            rise, fall = high * (1 - high) / both, low * (1 - low) / both
            ways = np.zeros((2, len(y), p + m))  # what the upper and the lower end are moved by
            ways[:, :, :p] = -x
            rows_of = np.arange(len(y))
            ways[0, rows_of[y < m], p + y[y < m]] = 1
            ways[1, rows_of[y > 0], p + y[y > 0] - 1] = 1
            a, c, d = rise * (1 - 2 * high) - rise**2, rise * fall, -fall * (1 - 2 * low) - fall**2
            gradient = rise @ ways[0] - fall @ ways[1]
            second = (ways[0] * a[:, None]).T @ ways[0] + (ways[1] * d[:, None]).T @ ways[1]
            cross = (ways[0] * c[:, None]).T @ ways[1]
            return np.concatenate([[np.log(both).sum()], gradient, -(second + cross + cross.T)[i, j]])

        got = added_up(known, [outcome, *terms], sums, 1 + p + m + half)
        return got[:1], got[None, 1 : 1 + p + m], square(got[None, 1 + p + m :], p + m)

    return newton(names, np.concatenate([np.zeros(p), np.log(share / (1 - share))])[None], at)


def chi_square_tail(x: float, df: int) -> float:
    """The probability that a chi-square variable of df degrees of freedom exceeds x."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        for k in range(df // 2):
            total, term = total + term, term * half / (1.5 + k)
    else:
        total, term = 0.0, math.exp(-half)
        for k in range(df // 2):
            total, term = total + term, term * half / (k + 1)
    return min(1.0, total)


def brant_test(table: DataFrame, outcome: str, terms: list[str], levels: int) -> list[tuple[str, float, int, float]]:
    """(term or omnibus, chi-square, degrees of freedom, p): whether the slopes of the binary logits of outcome > k are
    the same for all k, by Wald's test with the joint covariance of those fits."""
    p, m = len(terms), levels - 1
    known = table.dropna(subset=[outcome, *terms])
    fits = [logit(known.withColumn("_above", (F.col(outcome) > k).cast("double")), "_above", terms) for k in range(m)]
    beta = np.stack([f.params[0] for f in fits])

    def sums(rows: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(rows)), rows])
        above = logistic(x @ beta.T)
        return np.stack([(x * (above[:, max(k, l)] * (1 - above[:, min(k, l)]))[:, None]).T @ x for k in range(m) for l in range(m)]).ravel()  # noqa: E741

    q = p + 1
    middle = added_up(known, terms, sums, m * m * q * q).reshape(m, m, q, q)
    inverse = [np.linalg.inv(middle[k, k]) for k in range(m)]
    joint = np.block([[(inverse[k] @ middle[k, l] @ inverse[l])[1:, 1:] for l in range(m)] for k in range(m)])  # noqa: E741
    slopes = beta[:, 1:].ravel()

    def wald(which: list[int]) -> tuple[float, int, float]:
        contrast = np.zeros(((m - 1) * len(which), m * p))
        for k in range(1, m):
            for r, t in enumerate(which):
                contrast[(k - 1) * len(which) + r, t], contrast[(k - 1) * len(which) + r, k * p + t] = 1, -1
        gap = contrast @ slopes
        x = float(gap @ np.linalg.solve(contrast @ joint @ contrast.T, gap)) if len(gap) else 0.0
        return x, len(gap), chi_square_tail(x, len(gap)) if len(gap) else 1.0

    return [("omnibus", *wald(list(range(p)))), *((t, *wald([k])) for k, t in enumerate(terms))]


def choice_logit(table: DataFrame, chosen: str, names: list[str], features: list[list[str | None]]) -> Fit:
    """Multinomial logistic regression over alternatives with features of their own: alternative 0 has none, the k-th
    the columns features[k - 1], one for each parameter, None being 0. chosen holds the number of the alternative.

    Rows with a null in any of the columns are left out.
    """
    used = list(dict.fromkeys(c for f in features for c in f if c))
    place = {c: k + 1 for k, c in enumerate(used)}
    p = len(names)
    half = p * (p + 1) // 2
    i, j = upper(p)
    known = table.dropna(subset=[chosen, *used])

    def at(params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def sums(rows: np.ndarray) -> np.ndarray:
            y = rows[:, 0].astype(int)
            x = np.zeros((len(features) + 1, len(rows), p))
            for a, columns in enumerate(features, 1):
                for k, c in enumerate(columns):
                    if c:
                        x[a, :, k] = rows[:, place[c]]
            u = x @ params[0]
            top = u.max(axis=0)
            share = np.exp(u - top)
            total = share.sum(axis=0)
            share /= total
            mean = (share[:, :, None] * x).sum(axis=0)
            every = np.arange(len(rows))
            second = (share[:, :, None] * x[:, :, i] * x[:, :, j]).sum(axis=(0, 1)) - (mean[:, i] * mean[:, j]).sum(axis=0)
            return np.concatenate([[(u[y, every] - top - np.log(total)).sum()], (x[y, every] - mean).sum(axis=0), second])

        got = added_up(known, [chosen, *used], sums, 1 + p + half)
        return got[:1], got[None, 1 : 1 + p], square(got[None, 1 + p :], p)

    return newton(names, np.zeros((1, p)), at)


def correlation(table: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson's correlations of columns over the rows that lack none, from sums about rough means in two passes."""
    known, p = table.dropna(subset=columns), len(columns)
    first = added_up(known, columns, lambda x: np.append(x.sum(axis=0), len(x)), p + 1)
    centre = first[:-1] / max(first[-1], 1)
    got = added_up(known, columns, lambda x: np.concatenate([(x - centre).sum(axis=0), ((x - centre).T @ (x - centre)).ravel()]), p + p * p)
    n = max(first[-1], 1)
    spread = got[p:].reshape(p, p) / n - np.outer(got[:p], got[:p]) / n**2
    size = np.sqrt(np.diag(spread))
    return spread / np.outer(size, size)


def varimax(loadings: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Loadings turned so that the squares of each factor vary most, with rows at length 1 while it turns: two factors
    at a time by the angle that is best for them, until no angle is left."""
    length = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    z, (p, k) = loadings / np.where(length > 0, length, 1), loadings.shape
    for _ in range(rounds):
        largest = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                u, v = z[:, i] ** 2 - z[:, j] ** 2, 2 * z[:, i] * z[:, j]
                angle = math.atan2(2 * (u @ v - u.sum() * v.sum() / p), u @ u - v @ v - (u.sum() ** 2 - v.sum() ** 2) / p) / 4
                turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
                z[:, [i, j]] = z[:, [i, j]] @ turn
                largest = max(largest, abs(angle))
        if largest < 1e-12:
            break
    return z * length


def factor_analysis(r: np.ndarray, factors: int = 1, rounds: int = 20000, close: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(loadings turned by varimax, uniquenesses) of the most likely model of a correlation matrix, by steps of
    expectation and maximisation on that matrix alone; each factor points to where its loadings add up to more than 0."""
    p = len(r)
    psi = np.maximum(1 / np.diag(np.linalg.inv(r)), 0.005)
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors] - psi.mean(), 0.01))
    for _ in range(rounds):
        beta = np.linalg.solve(load @ load.T + np.diag(psi), load).T
        second = np.eye(factors) - beta @ load + beta @ r @ beta.T
        new = np.linalg.solve(second, beta @ r).T
        unique = np.maximum(np.diag(r - new @ beta @ r), 0.005)
        moved = max(np.abs(unique - psi).max(), np.abs(new - load).max())
        load, psi = new, unique
        if moved < close:
            break
    load = varimax(load)
    return load * np.where(load.sum(axis=0) < 0, -1, 1), psi
