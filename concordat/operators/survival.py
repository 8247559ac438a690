"""Proportional hazards by Newton rounds over risk sets, with strata, Efron's ties and errors clustered by a key.

A round adds up, for each stratum and time, the sums of all rows and of those with an event, partly before the
shuffle; running sums from the last time to the first are the risk sets, and tied events take their turns within a
time. What is windowed is one row for each distinct time of a stratum, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.newton import Fit, added_up, newton, square, upper

#: Turns of tied events that are computed at once.
TURNS = 4096


def _eta(terms: list[str], beta: np.ndarray):
    out = F.lit(0.0)
    for t, b in zip(terms, beta):
        out = out + F.lit(float(b)) * F.col(t).cast("double")
    return out


def risk_sets(rows: DataFrame, time: str, event: str, terms: list[str], stratum: str, beta: np.ndarray) -> DataFrame:
    """stratum, time, d (events), gain (their linear predictors), x0.. (their terms), r0.. and e0..: over the rows at
    risk and over those with an event, the sums of exp(eta), of its products with terms and with products of terms."""
    i, j = upper(len(terms))
    x = [F.col(t).cast("double") for t in terms]
    parts = [F.lit(1.0), *x, *(x[a] * x[b] for a, b in zip(i, j))]
    happened = F.col(event).cast("double")
    known = rows.withColumn("_eta", _eta(terms, beta))
    sums = [F.sum(F.exp("_eta") * p).alias(f"r{k}") for k, p in enumerate(parts)] + [F.sum(F.exp("_eta") * happened * p).alias(f"e{k}") for k, p in enumerate(parts)]
    ends = known.groupBy(stratum, time).agg(F.sum(happened).alias("d"), F.sum(happened * F.col("_eta")).alias("gain"), *(F.sum(happened * t).alias(f"x{k}") for k, t in enumerate(x)), *sums)
    later = Window.partitionBy(stratum).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumns({f"r{k}": F.sum(f"r{k}").over(later) for k in range(len(parts))})


def turns(d: np.ndarray, at_risk: np.ndarray, ended: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, share, sums) of each turn of tied events: the k-th of d leaves out k / d of the sums of the events."""
    last = np.cumsum(d.astype(int))
    for a in range(0, int(last[-1]) if len(last) else 0, TURNS):
        turn = np.arange(a, min(a + TURNS, last[-1]))
        place = np.searchsorted(last, turn, side="right")
        share = (turn - (last - d.astype(int))[place]) / d[place]
        yield place, share, at_risk[place] - share[:, None] * ended[place]


def cox(rows: DataFrame, time: str, event: str, terms: list[str], stratum: str) -> Fit:
    """Coefficients of terms; rows with a null in any of the columns are left out. event is 0 or 1."""
    known = rows.dropna(subset=[time, event, stratum, *terms])
    p = len(terms)
    i, j = upper(p)
    m = 1 + p + len(i)
    columns = ["d", "gain", *(f"x{k}" for k in range(p)), *(f"r{k}" for k in range(m)), *(f"e{k}" for k in range(m))]

    def sums(table: np.ndarray) -> np.ndarray:
        d, gain, x = table[:, 0], table[:, 1].sum(), table[:, 2 : 2 + p].sum(axis=0)
        second = np.zeros(len(i))
        for _, _, s in turns(d, table[:, 2 + p : 2 + p + m], table[:, 2 + p + m :]):
            mean = s[:, 1 : 1 + p] / s[:, :1]
            gain -= np.log(s[:, 0]).sum()
            x = x - mean.sum(axis=0)
            second += (s[:, 1 + p :] / s[:, :1] - mean[:, i] * mean[:, j]).sum(axis=0)
        return np.concatenate([[gain], x, second])

    def at(params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets = risk_sets(known, time, event, terms, stratum, params[0]).filter("d > 0")
        got = added_up(sets, columns, sums, m)
        return got[:1], got[None, 1 : 1 + p], square(got[None, 1 + p :], p)

    return newton(terms, np.zeros((1, p)), at)


def cox_cluster_covariance(fit: Fit, rows: DataFrame, time: str, event: str, terms: list[str], stratum: str, cluster: str) -> np.ndarray:
    """The sandwich of the information and the score residuals added up by cluster.

    A row's residual is what its event adds, less its share of the hazards of all times up to its own; those are
    running sums over the distinct times of a stratum, joined to the rows by stratum and time.
    """
    known = rows.dropna(subset=[time, event, stratum, *terms])
    beta, p = fit.params[0], len(terms)
    m = 1 + p + p * (p + 1) // 2
    sets = risk_sets(known, time, event, terms, stratum, beta)
    names = ["h", *(f"hx{k}" for k in range(p)), "g", *(f"gx{k}" for k in range(p)), *(f"mean{k}" for k in range(p))]

    def hazards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(float) if batch.num_rows else np.zeros((0, 1 + 2 * m))
            d, out = table[:, 0], np.zeros((len(table), 2 + 3 * p))
            for place, share, s in turns(d, table[:, 1 : 1 + m], table[:, 1 + m :]):
                one, mean = 1 / s[:, 0], s[:, 1 : 1 + p] / s[:, :1]
                own = np.column_stack([one, mean * one[:, None], (1 - share) * one, mean * ((1 - share) * one)[:, None], mean / d[place][:, None]])
                np.add.at(out, place, own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in out.T)], [stratum, time, *names])

    kinds = [f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in (stratum, time)]
    found = sets.select(stratum, time, "d", *(f"r{k}" for k in range(m)), *(f"e{k}" for k in range(m))).mapInArrow(hazards, ", ".join([*kinds, *(f"{n} double" for n in names)]))
    before = Window.partitionBy(stratum).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({f"b{n}": F.coalesce(F.sum(n).over(before), F.lit(0.0)) for n in names[: 1 + p]})
    met = known.join(found, [stratum, time])
    happened, risk = F.col(event).cast("double"), F.exp(_eta(terms, beta))
    own = lambda a, b: F.when(happened > 0, F.col(b)).otherwise(F.col(a))
    residuals = []
    for k, t in enumerate(terms):
        x = F.col(t).cast("double")
        share = x * (F.col("bh") + own("h", "g")) - F.col(f"bhx{k}") - own(f"hx{k}", f"gx{k}")
        residuals.append(F.sum(happened * (x - F.col(f"mean{k}")) - risk * share).alias(f"_s{k}"))
    scores = met.groupBy(cluster).agg(*residuals)
    meat = added_up(scores, [f"_s{k}" for k in range(p)], lambda s: (s.T @ s).ravel(), p * p).reshape(p, p)
    bread = np.linalg.inv(fit.information[0])
    return bread @ meat @ bread
