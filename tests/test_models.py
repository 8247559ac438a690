"""Fits against plain numpy versions of the same likelihoods."""

import numpy as np
import pytest

from concordat.operators import newton, survival


def climb(value, start, rounds=200):
    """The maximum of a smooth concave function by Newton's method with numerical derivatives of its exact gradient."""
    x = np.array(start, float)
    for _ in range(rounds):
        g = value(x)
        h = np.stack([(value(x + 1e-6 * e) - value(x - 1e-6 * e)) / 2e-6 for e in np.eye(len(x))])
        step = np.linalg.solve(h, -g)
        x += step
        if np.abs(step).max() < 1e-11:
            break
    return x, -h


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=(n, 2))
    period = rng.integers(2000, 2006, n)
    group = rng.integers(0, 60, n)
    eta = x @ [0.8, -0.5] + 0.2 * (period - 2002) + 0.5 * rng.normal(size=60)[group]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    level = np.digitize(eta + rng.logistic(size=n), [-1.5, 0.3, 1.8])
    time = np.ceil(rng.exponential(20 * np.exp(-0.5 * eta)) / 4)  # many ties
    event = (rng.random(n) < 0.7).astype(int)
    return x, period, group, y, level, time, event


@pytest.fixture(scope="module")
def table(spark, data):
    x, period, group, y, level, time, event = data
    rows = [(*map(float, x[i]), int(period[i]), int(group[i]), float(y[i]), int(level[i]), float(time[i]), int(event[i])) for i in range(len(y))]
    rows += [(None, 1.0, 2000, 1, 1.0, 1, 1.0, 1)]
    return newton.stored(spark.createDataFrame(rows, "a double, b double, period int, grp int, y double, level int, time double, event int").repartition(5), "models")


def test_logit_with_factor_and_clusters(table, data):
    x, period, group, y, *_ = data
    rows, names = newton.factor(table, "period")
    assert names == [f"period_{k}" for k in range(2001, 2006)]
    fit = newton.logit(rows, "y", ["a", "b", *names])
    z = np.column_stack([np.ones(len(y)), x, *(period == k for k in range(2001, 2006))]).astype(float)
    want, information = climb(lambda b: z.T @ (y - 1 / (1 + np.exp(-z @ b))), np.zeros(8))
    assert fit.converged.all() and np.allclose(fit.params[0], want, atol=1e-7) and np.allclose(fit.information[0], information, rtol=1e-4)
    scores = np.zeros((60, 8))
    np.add.at(scores, group, z * (y - 1 / (1 + np.exp(-z @ want)))[:, None])
    bread = np.linalg.inv((z * (lambda m: m * (1 - m))(1 / (1 + np.exp(-z @ want)))[:, None]).T @ z)
    assert np.allclose(newton.cluster_covariance(fit, rows, "y", ["a", "b", *names], "grp"), 60 / 59 * bread @ scores.T @ scores @ bread, atol=1e-8)


def test_bootstrap_of_periods(table, data):
    x, period, _, y, *_ = data
    whole, again, periods = newton.bootstrap_periods(table, "y", ["a", "b"], "period", replicates=40, seed=5)
    assert periods == list(range(2000, 2006)) and again.converged.all() and again.params.shape == (40, 3)
    z, drawn = np.column_stack([np.ones(len(y)), x]), np.random.default_rng(5).integers(0, 6, (40, 6))
    for r in (0, 7, 39):
        w = np.bincount(drawn[r], minlength=6)[period - 2000]
        want, _ = climb(lambda b: z.T @ (w * (y - 1 / (1 + np.exp(-z @ b)))), np.zeros(3))
        assert np.allclose(again.params[r], want, atol=1e-7)
    assert np.allclose(whole.params[0], climb(lambda b: z.T @ (y - 1 / (1 + np.exp(-z @ b))), np.zeros(3))[0], atol=1e-7)


def ordered_value(x, level, params, levels):
    cuts = np.concatenate([[-np.inf], params[2:], [np.inf]])
    f = lambda u: 1 / (1 + np.exp(-u))
    eta = x @ params[:2]
    return np.log(f(cuts[level + 1] - eta) - f(cuts[level] - eta)).sum()


def test_ordered_logit_and_brant(table, data):
    x, _, _, _, level, *_ = data
    fit = newton.ordered_logit(table, "level", ["a", "b"], 4)
    at = fit.params[0]
    best = ordered_value(x, level, at, 4)
    slope = [(ordered_value(x, level, at + 1e-5 * e, 4) - ordered_value(x, level, at - 1e-5 * e, 4)) / 2e-5 for e in np.eye(5)]
    curve = [(ordered_value(x, level, at + 1e-3 * e, 4) - 2 * best + ordered_value(x, level, at - 1e-3 * e, 4)) / 1e-6 for e in np.eye(5)]
    assert fit.converged.all() and np.allclose(slope, 0, atol=1e-4) and np.allclose(-np.diag(fit.information[0]), curve, rtol=1e-3)
    assert fit.names == ["a", "b", "0|1", "1|2", "2|3"]
    found = newton.brant_test(table, "level", ["a", "b"], 4)
    assert [(t, df) for t, _, df, _ in found] == [("omnibus", 4), ("a", 2), ("b", 2)]
    assert all(0 < p <= 1 and c >= 0 for _, c, _, p in found)
    z = np.column_stack([np.ones(len(x)), x])
    fits = [climb(lambda b, k=k: z.T @ ((level > k) - 1 / (1 + np.exp(-z @ b))), np.zeros(3))[0] for k in range(3)]
    m = [1 / (1 + np.exp(-z @ b)) for b in fits]
    inv = [np.linalg.inv((z * (q * (1 - q))[:, None]).T @ z) for q in m]
    joint = np.block([[(inv[k] @ (z * (m[max(k, q)] * (1 - m[min(k, q)]))[:, None]).T @ z @ inv[q])[1:, 1:] for q in range(3)] for k in range(3)])
    contrast = np.block([[np.eye(2), -np.eye(2), np.zeros((2, 2))], [np.eye(2), np.zeros((2, 2)), -np.eye(2)]])
    gap = contrast @ np.concatenate([b[1:] for b in fits])
    assert np.isclose(found[0][1], gap @ np.linalg.solve(contrast @ joint @ contrast.T, gap), rtol=1e-6)


def test_chi_square_tail():
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (24.995790, 15, 0.05)):
        assert abs(newton.chi_square_tail(x, df) - p) < 1e-6
    assert newton.chi_square_tail(0, 3) == 1


def cox_gradient(x, stratum, time, event, b):
    """Efron's score, written as a loop over event times."""
    out = np.zeros(x.shape[1])
    for s in np.unique(stratum):
        for t in np.unique(time[(stratum == s) & (event == 1)]):
            risk, died = (stratum == s) & (time >= t), (stratum == s) & (time == t) & (event == 1)
            e = np.exp(x @ b)
            for k in range(died.sum()):
                w = e * (risk - k / died.sum() * died)
                out -= (w[:, None] * x).sum(axis=0) / w.sum()
            out += x[died].sum(axis=0)
    return out


def test_cox_with_ties_strata_and_clusters(table, data):
    x, period, group, _, _, time, event = data
    stratum = period // 2
    rows = table.withColumn("stratum", (table["period"] / 2).cast("int"))
    fit = survival.cox(rows, "time", "event", ["a", "b"], "stratum")
    want, information = climb(lambda b: cox_gradient(x, stratum, time, event, b), np.zeros(2))
    assert fit.converged.all() and np.allclose(fit.params[0], want, atol=1e-7) and np.allclose(fit.information[0], information, rtol=1e-4)
    # residuals: what a row's weight adds to the score, by numerical derivative
    got = survival.cox_cluster_covariance(fit, rows, "time", "event", ["a", "b"], "stratum", "grp")
    residual = np.zeros_like(x)
    e = np.exp(x @ want)
    for s in np.unique(stratum):
        for t in np.unique(time[(stratum == s) & (event == 1)]):
            risk, died = (stratum == s) & (time >= t), (stratum == s) & (time == t) & (event == 1)
            d = died.sum()
            for k in range(d):
                w = e * (risk - k / d * died)
                mean = (w[:, None] * x).sum(axis=0) / w.sum()
                residual[died] += (x[died] - mean) / d
                residual -= (w / w.sum())[:, None] * (x - mean)
    scores = np.zeros((60, 2))
    np.add.at(scores, group, residual)
    bread = np.linalg.inv(information)
    assert np.allclose(residual.sum(axis=0), 0, atol=1e-6) and np.allclose(got, bread @ scores.T @ scores @ bread, rtol=1e-4)


def test_empty_and_separated(spark, table):
    fit = newton.logit(table.filter("a > 100"), "y", ["a"])
    assert fit.params.shape == (1, 2) and (fit.params == 0).all()
    apart = newton.stored(spark.createDataFrame([(float(k), float(k > 4)) for k in range(10)], "x double, y double"), "apart")
    assert newton.logit(apart, "y", ["x"]).loglik[0] > -1e-3
    with pytest.raises(ValueError):
        newton.factor(spark.range(600), "id")


def test_no_finite_maximum(spark, table):
    """A period of one outcome, all of one outcome, and a regressor that is always 0."""
    terms = ["a", "b", "period_2003"]
    rows = table.withColumn("period_2003", (table["period"] == 2003).cast("double"))
    assert newton.logit(rows, "y", terms).bounded.all()
    for y, more in (("CASE WHEN period = 2003 THEN 1.0 ELSE y END", terms), ("1.0", terms), ("y", ["a", "nil"])):
        apart = newton.stored(rows.selectExpr("*", f"{y} AS gone", "a * 0 AS nil"), "apart")
        fit = newton.logit(apart, "gone", more)
        assert not fit.bounded.any() and np.isnan(fit.estimates).all()
        assert np.isnan(newton.cluster_covariance(fit, apart, "gone", more, "grp")).all()


def test_choice_among_three(spark):
    rng = np.random.default_rng(8)
    n = 600
    x = rng.normal(size=(n, 3))
    f = np.zeros((3, n, 4))
    f[1, :, 0], f[1, :, 2], f[2, :, 1], f[2, :, 2], f[2, :, 3] = 1, x[:, 0], 1, x[:, 1], x[:, 2]
    u = f @ [0.3, -0.4, 0.8, 0.5]
    p = np.exp(u) / np.exp(u).sum(axis=0)
    y = (rng.random(n) > np.cumsum(p, axis=0)).sum(axis=0)
    rows = newton.stored(spark.createDataFrame([(int(a), *map(float, b), 1.0) for a, b in zip(y, x)], "y int, a double, b double, c double, one double"), "choices")
    fit = newton.choice_logit(rows, "y", ["e1", "e2", "shared", "own"], [["one", None, "a", None], [None, "one", "b", "c"]])

    def value(t):
        q = np.exp(f @ t) / np.exp(f @ t).sum(axis=0)
        return (f[y, np.arange(n)] - (q[:, :, None] * f).sum(axis=0)).sum(axis=0)

    want, information = climb(value, np.zeros(4))
    assert fit.converged.all() and np.allclose(fit.params[0], want, atol=1e-7) and np.allclose(fit.information[0], information, rtol=1e-4)


def test_choices_without_finite_maximum(spark):
    """An alternative that nobody chose, and a feature that is always 0."""
    rows = newton.stored(spark.createDataFrame([(k % 3, float(k % 7), 1.0, 0.0) for k in range(120)], "y int, a double, one double, nil double"), "choices")
    names, features = ["e1", "e2", "slope"], [["one", None, "a"], [None, "one", None]]
    assert newton.choice_logit(rows, "y", names, features).bounded.all()
    assert np.isnan(newton.choice_logit(rows.filter("y > 0"), "y", names, features).estimates).all()
    assert np.isnan(newton.choice_logit(rows, "y", names, [["one", None, "nil"], [None, "one", None]]).estimates).all()


def test_factors():
    rng = np.random.default_rng(2)
    load = np.array([[0.9, 0.0], [0.8, 0.0], [0.7, 0.0], [0.0, 0.8], [0.0, 0.7], [0.0, 0.6]])
    r = load @ load.T + np.diag(1 - (load**2).sum(axis=1))
    found, unique = newton.factor_analysis(r, 2)
    found = found[:, np.argsort(-np.abs(found[0]))]
    assert np.allclose(found, load, atol=1e-3) and np.allclose(unique, 1 - (load**2).sum(axis=1), atol=1e-3)
    turn = np.linalg.qr(rng.normal(size=(2, 2)))[0]
    spread = lambda x: ((x / np.sqrt((x**2).sum(axis=1, keepdims=True))) ** 2).var(axis=0).sum()
    assert spread(newton.varimax(load @ turn)) >= spread(load) - 1e-9


def test_correlation_far_from_zero(spark, data):
    x = data[0] + 1e7
    rows = newton.stored(spark.createDataFrame([(*map(float, r),) for r in x] + [(None, 5.0)], "a double, b double"), "far")
    assert np.allclose(newton.correlation(rows, ["a", "b"]), np.corrcoef(x.T), atol=1e-7)
