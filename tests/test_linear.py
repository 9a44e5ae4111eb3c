"""Covariance, components, inverse problems and decoders against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tidewave.operators import linear as L
from tidewave.plans import linear as P
from tidewave.plans.tables import epochs


def frame(spark, x, groups=None):
    rows = [(i, int(groups[i]) if groups is not None else 0, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "trial long, condition long, x array<double>").repartition(3)


def table_of(spark):
    rows = epochs(spark, SF).orderBy("trial").toPandas()
    return rows["condition"].to_numpy(), np.stack(rows["x"])


def test_moments_leave_out_odd_rows(spark):
    x = np.random.default_rng(0).normal(size=(50, 3))
    odd = spark.createDataFrame([(90, 0, None), (91, 0, [1.0, float("nan"), 0.0]), (92, 0, [float("inf")] * 3)], "trial long, condition long, x array<double>")
    s = L.moments(frame(spark, x).union(odd), ["condition"]).first()["s"]
    n, mean, scatter = L.split(s)
    assert n == 50 and np.allclose(mean, x.mean(axis=0)) and np.allclose(scatter / 49, np.cov(x.T))
    assert L.moments(frame(spark, x).limit(0), ["condition"]).count() == 0


def test_components_of_every_condition(spark):
    groups, x = table_of(spark)
    values = {}
    for r in P.eigen_spectrum(spark, SF).collect():
        values.setdefault(r["condition"], {})[r["k"]] = (r["eigenvalue"], r["explained"])
    summary = {r["condition"]: r for r in P.covariance_summary(spark, SF).collect()}
    scores = {(r["trial"], r["k"]): r["score"] for r in P.pca_scores(spark, SF).collect()}
    for c in np.unique(groups):
        cov = np.cov(x[groups == c].T)
        want = np.linalg.eigvalsh(cov)[::-1]
        got = np.array([values[c][k] for k in range(64)])
        assert np.allclose(got[:, 0], want, atol=2e-6) and np.allclose(got[:, 1], np.cumsum(want) / want.sum(), atol=2e-6)
        assert summary[c]["participation"] == pytest.approx(want.sum() ** 2 / (want**2).sum(), rel=1e-5)
        assert summary[c]["pc1"] == pytest.approx(want[0] / want.sum(), abs=2e-6)
        assert summary[c]["pc1_correlation"] == pytest.approx(np.linalg.eigvalsh(np.corrcoef(x[groups == c].T))[-1] / 64, abs=2e-6)
        for t in np.flatnonzero(groups == c)[:5]:
            first = np.array([scores[(t, k)] for k in range(3)])
            assert np.linalg.norm(first) <= np.linalg.norm(x[t] - x[groups == c].mean(axis=0)) + 1e-6
        own = np.array([scores[(t, 0)] for t in np.flatnonzero(groups == c)])
        assert own.var(ddof=1) == pytest.approx(want[0], rel=1e-4)


def test_generalised_directions_find_what_changes(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(6000, 4)) + r.normal(size=(6000, 1)) * 3
    groups = np.repeat([0, 1], 3000)
    x[:3000] += r.normal(size=(3000, 1)) * 2 * np.array([1.0, -1.0, 0, 0])
    found = L.against_rest(L.moments(frame(spark, x, groups), ["condition"]), "condition").where("condition = 0 and k = 0").first()
    a, b = np.cov(x[:3000].T), L.shrunk(np.cov(x[3000:].T), 0.01)
    w = np.array(found["filter"])
    assert found["ratio"] == pytest.approx(L.rayleigh(w, a, b), rel=1e-6) and found["ratio"] > 4
    pattern = b @ w
    assert abs(pattern @ np.array([1, -1, 0, 0])) / np.linalg.norm(pattern) / 2**0.5 > 0.95
    assert found["ratio"] >= max(L.rayleigh(v, a, b) for v in np.eye(4))


def test_small_matrices():
    m = np.array([[2.0, 0.0], [0.0, 0.5]])
    assert L.condition_number(m) == pytest.approx(4.0) and L.condition_number(np.ones((2, 2))) > 1e15
    assert L.common_mode(np.ones((3, 3))) == pytest.approx(1.0) and L.common_mode(np.eye(4)) == pytest.approx(0.25)
    field = np.random.default_rng(2).normal(size=(6, 3))
    source = np.array([1.0, -2.0, 0.5])
    assert np.allclose(L.inverse_operator(field, 0.0) @ (field @ source), source)
    ridge = L.inverse_operator(field, 2.0) @ (field @ source)
    assert np.allclose((field.T @ field + 2 * np.eye(3)) @ ridge, field.T @ field @ source) and np.linalg.norm(ridge) < np.linalg.norm(source)
    draws = np.random.default_rng(3).normal(size=(3, 100_000)) * np.array([[2.0], [1.0], [0.5]])
    measured = np.cov(field @ draws + 0.3 * np.random.default_rng(4).normal(size=(6, 100_000)))
    assert np.allclose(measured, L.mixed_covariance(field, np.array([4.0, 1.0, 0.25]), 0.09), atol=0.15)


def test_folds_are_predicted_by_the_others(spark):
    _, x = table_of(spark)
    found = L.cross_predictions(P._random(spark, SF), P.RIDGE).toPandas()
    for fold, part in found.groupby("fold"):
        out = part["trial"].to_numpy()
        inside = np.setdiff1d(np.arange(len(x)), out)
        a, y = x[inside, :-1], x[inside, -1]
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + P.RIDGE * np.eye(63), (a - a.mean(0)).T @ (y - y.mean()))
        assert np.allclose(part["predicted"], (x[out, :-1] - a.mean(0)) @ w + y.mean()), fold


def test_blocked_folds_keep_an_embargo(spark):
    rows = P._blocked(spark, SF, embargo=10).select("trial", "fold", "guard").toPandas()
    assert rows["fold"].nunique() == P.FOLDS
    bounds = rows.groupby("fold")["trial"].agg(["min", "max"])
    for trial, fold, guard in rows.itertuples(index=False):
        near = {f for f, b in bounds.iterrows() if b["min"] - 10 <= trial <= b["max"] + 10}
        assert set(guard) == near and fold in near


def test_bootstrap_spread_is_that_of_least_squares(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 2))
    y = x @ [1.0, -2.0] + r.normal(size=4000)
    rows = frame(spark, np.column_stack([x, y]))
    got = {g["j"]: g for g in L.bootstrap_spread(rows, 0.0, 200).collect()}
    assert got[0]["mean"] == pytest.approx(1.0, abs=0.05) and got[1]["mean"] == pytest.approx(-2.0, abs=0.05)
    assert got[0]["sd"] == pytest.approx(4000**-0.5, rel=0.25)
    again = {g["j"]: g["sd"] for g in L.bootstrap_spread(rows.repartition(7), 0.0, 200).collect()}
    assert again[1] == pytest.approx(got[1]["sd"], rel=1e-9)


def test_gradients_against_differences_and_training(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 3))
    y = np.tanh(x @ [1.0, -1.0, 0.5]) * 2
    p = L.start_network(3, 4, seed=1)
    _, grads = L.gradient_sums(p, x, y)
    plain, step = L.flat(p), 1e-6
    for i in range(len(plain)):
        up, down = plain.copy(), plain.copy()
        up[i] += step
        down[i] -= step
        slope = (L.gradient_sums(L.shaped(up, p), x, y)[0] - L.gradient_sums(L.shaped(down, p), x, y)[0]) / (2 * step)
        assert L.flat(grads)[i] == pytest.approx(slope, rel=1e-4, abs=1e-4)
    rows = frame(spark, np.column_stack([x, y]))
    q, history = L.train_network(rows, 4, 12, 0.1, seed=1)
    want = L.start_network(3, 4, seed=1)
    for seen in history:
        error, g = L.gradient_sums(want, x, y)
        assert seen == pytest.approx(error / 200)
        want = L.shaped(L.flat(want) - 0.1 * L.flat(g) / 200, want)
    assert np.allclose(L.flat(q), L.flat(want)) and history[-1] < history[0]
    out = L.network_predictions(rows, q).orderBy("trial").toPandas()
    assert np.allclose(out["predicted"], L.network_output(q, x)[1])


def test_decoding_queries_cover_all_epochs(spark):
    n = epochs(spark, SF).count()
    for query in (P.cross_val_random, P.cross_val_blocked, P.network_decoding):
        assert query(spark, SF).agg(F.sum("n")).first()[0] == n
    assert P.decoder_patterns(spark, SF).count() == 5 * 63 and P.bootstrap_weights(spark, SF).count() == 63
    assert P.mixing_misfit(spark, SF).where("misfit < 1.5").count() == epochs(spark, SF).select("condition").distinct().count()


def test_networks_never_see_the_fold_they_are_scored_on(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(120, 3))
    y = np.tanh(x @ [1.0, -2.0, 0.5])
    fold = np.arange(120) % 4
    rows = spark.createDataFrame([(i, int(f), [*map(float, r), float(t)]) for i, (f, r, t) in enumerate(zip(fold, x, y, strict=True))], "trial long, fold int, x array<double>")
    found, nets = L.cross_val_network(rows, 4, 5, 8, 0.1, seed=2)
    got = {r["trial"]: r["predicted"] for r in found.collect()}
    for k in range(4):
        p = L.start_network(3, 5, seed=2)
        for _ in range(8):
            own = fold != k
            p = L.shaped(L.flat(p) - 0.1 * L.flat(L.gradient_sums(p, x[own], y[own])[1]) / own.sum(), p)
        assert np.allclose(L.flat(p), L.flat(nets[k]))
        assert np.allclose([got[i] for i in np.flatnonzero(fold == k)], L.network_output(p, x[fold == k])[1])


def test_gradients_by_backpropagation_equal_differences():
    draw = np.random.default_rng(6)
    p, x, y = L.start_network(4, 3, seed=3), draw.normal(size=(20, 4)), draw.normal(size=20)
    assert np.allclose(L.flat(L.gradient_sums(p, x, y)[1]), L.flat(L.numerical_gradient(p, x, y)), atol=1e-5)
