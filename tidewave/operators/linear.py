"""Linear algebra over rows of features: second moments by partial sums, then small matrices.

Rows (key columns, x: array) are summed up in tasks to one matrix of moments each
(``moments``: count, sums and products), which Spark adds up by group. What follows works
on one matrix per group, of the number of features squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.storage import settled


def moments(rows: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """by, n and s: for each group the count and, flat, the sums of products of (1, x) with itself.

    Rows that are null, or hold a null or an infinite value, or differ in length from the
    first of their group in a task, take no part; groups of several lengths fail when merged.
    """
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("width", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in batches:
            for key, part in frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]:
                values = [np.asarray(v, float) for v in part[x] if v is not None]
                for width in {len(v) for v in values}:
                    m = np.stack([v for v in values if len(v) == width])
                    m = m[np.isfinite(m).all(axis=1)]
                    wide = np.column_stack([np.ones(len(m)), m])
                    at = (*key, width) if isinstance(key, tuple) else (key, width)
                    sums[at] = sums.get(at, 0) + wide.T @ wide
        out = [(*key, s.ravel()) for key, s in sums.items() if s[0, 0] > 0]
        yield pd.DataFrame(out, columns=[*by, "width", "s"])

    each = rows.select(*by, x).mapInPandas(run, schema)
    cells = each.select(*by, "width", F.posexplode("s").alias("i", "v")).groupBy(*by, "width", "i").agg(F.sum("v").alias("v"))
    return cells.groupBy(*by, "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("s"))


def split(s) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and the sum of centred products of a group's moments."""
    s = np.asarray(s, float)
    d = int(round(len(s) ** 0.5))
    m = s.reshape(d, d)
    mean = m[0, 1:] / m[0, 0]
    return m[0, 0], mean, m[1:, 1:] - m[0, 0] * np.outer(mean, mean)


def covariance(s) -> np.ndarray:
    n, _, scatter = split(s)
    return scatter / (n - 1) if n > 1 else np.full_like(scatter, np.nan)


def shrunk(c: np.ndarray, alpha: float) -> np.ndarray:
    """Part of the way to a multiple of the identity with the same mean variance."""
    return (1 - alpha) * c + alpha * np.trace(c) / len(c) * np.eye(len(c))


def eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit vectors in columns, each with its largest component positive."""
    values, vectors = np.linalg.eigh(c)
    values, vectors = values[::-1], vectors[:, ::-1]
    turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(c))])
    return values, vectors * turn


def condition_number(c: np.ndarray) -> float:
    sizes = np.linalg.svd(c, compute_uv=False)
    return float(sizes[0] / sizes[-1]) if sizes[-1] >= 1e-15 else float("inf")


def common_mode(c: np.ndarray) -> float:
    """The share of the variance in the direction of all features alike."""
    return float(c.sum() / len(c) / np.trace(c))


def rayleigh(w: np.ndarray, signal: np.ndarray, noise: np.ndarray) -> float:
    return float(w @ signal @ w / (w @ noise @ w))


def generalised(signal: np.ndarray, noise: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ratios, largest first, and filters in columns of signal against shrunk noise.

    With noise = L L', the problem is that of inv(L) signal inv(L)'.
    """
    root = np.linalg.cholesky(shrunk(noise, alpha))
    half = np.linalg.solve(root, np.linalg.solve(root, signal).T)
    values, vectors = eigen((half + half.T) / 2)
    return values, np.linalg.solve(root.T, vectors)


def inverse_operator(leadfield: np.ndarray, ridge: float) -> np.ndarray:
    """The matrix that turns potentials into source currents (Tikhonov; the pseudoinverse without ridge)."""
    if ridge <= 0:
        return np.linalg.pinv(leadfield)
    return np.linalg.solve(leadfield.T @ leadfield + ridge * np.eye(leadfield.shape[1]), leadfield.T)


def mixed_covariance(mixing: np.ndarray, variances: np.ndarray, noise: float) -> np.ndarray:
    """What uncorrelated sources of these variances give at the sensors."""
    return (mixing * variances) @ mixing.T + noise * np.eye(len(mixing))


def per_group(groups: DataFrame, by: list[str], schema: str, one: Callable[[np.ndarray], list[dict]]) -> DataFrame:
    """by and the rows that ``one`` makes of a group's moments."""
    names = [*by, *T._parse_datatype_string(schema).fieldNames()]
    full = T.StructType([*[groups.schema[c] for c in by], *T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [{**{c: r[c] for c in by}, **found} for r in frame.to_dict("records") for found in one(r["s"])]
            yield pd.DataFrame(rows, columns=names)

    return groups.select(*by, "s").mapInPandas(run, full)


def covariances(groups: DataFrame, by: list[str], alpha: float = 0.0) -> DataFrame:
    """by, a, b (a <= b), cov: shrunk by alpha."""

    def one(s) -> list[dict]:
        c = shrunk(covariance(s), alpha)
        return [{"a": i, "b": j, "cov": float(c[i, j])} for i in range(len(c)) for j in range(i, len(c))]

    return per_group(groups, by, "a long, b long, cov double", one)


def spectrum_of(groups: DataFrame, by: list[str]) -> DataFrame:
    """by, k, eigenvalue, explained (cumulative share) of the covariance."""

    def one(s) -> list[dict]:
        values, _ = eigen(covariance(s))
        shares = np.cumsum(values) / values.sum()
        return [{"k": k, "eigenvalue": float(v), "explained": float(e)} for k, (v, e) in enumerate(zip(values, shares, strict=True))]

    return per_group(groups, by, "k long, eigenvalue double, explained double", one)


def summary_of(groups: DataFrame, by: list[str]) -> DataFrame:
    """by, condition_number, common_mode, participation ((sum of eigenvalues)^2 over the sum of their squares), pc1, pc1_correlation.

    pc1 is the first eigenvalue's share for the covariance, pc1_correlation that for correlations.
    """

    def one(s) -> list[dict]:
        c = covariance(s)
        values, _ = eigen(c)
        spread = np.sqrt(np.diag(c))
        alive = spread > 0
        r = (c / np.outer(spread, spread))[np.ix_(alive, alive)] if alive.any() else np.ones((1, 1))
        return [
            {
                "condition_number": condition_number(c), "common_mode": common_mode(c),
                "participation": float(values.sum() ** 2 / (values**2).sum()), "pc1": float(values[0] / values.sum()),
                "pc1_correlation": float(np.linalg.eigvalsh(r)[-1] / len(r)),
            }
        ]

    kind = "condition_number double, common_mode double, participation double, pc1 double, pc1_correlation double"
    return per_group(groups, by, kind, one)


def directions(groups: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, mean, axes: the first k principal directions, one after the other."""

    def one(s) -> list[dict]:
        _, mean, _ = split(s)
        return [{"mean": mean.tolist(), "axes": eigen(covariance(s))[1][:, :k].T.tolist()}]

    return per_group(groups, by, "mean array<double>, axes array<array<double>>", one)


def against_rest(groups: DataFrame, by: str, alpha: float = 0.01) -> DataFrame:
    """by, k, ratio, filter: directions in which a group varies most against all other groups together.

    One matrix per group comes together in one place, each of the number of features squared.
    """
    whole = groups.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    total = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("whole"))
    both = groups.join(total).select(by, F.concat("s", F.zip_with("whole", "s", lambda w, s: w - s)).alias("s"))

    def one(s) -> list[dict]:
        own, rest = np.split(np.asarray(s, float), 2)
        if rest[0] < 2 or own[0] < 2:
            return []
        ratios, filters = generalised(covariance(own), covariance(rest), alpha)
        return [{"k": k, "ratio": float(r), "filter": filters[:, k].tolist()} for k, r in enumerate(ratios)]

    return per_group(both, [by], "k long, ratio double, filter array<double>", one)


def apply_matrix(x: Column, matrix: np.ndarray) -> Column:
    """matrix @ x, as one array of dot products."""
    rows = [F.array(*map(F.lit, map(float, row))) for row in matrix]
    return F.array(*[F.aggregate(F.zip_with(x, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in rows])


# --- regression -----------------------------------------------------------------------


def ridge_weights(s, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept for the last feature from the others; the intercept isn't penalised."""
    n, mean, scatter = split(s)
    gram = scatter[:-1, :-1] + alpha * np.eye(len(scatter) - 1)
    w = np.linalg.solve(gram, scatter[:-1, -1]) if alpha > 0 else np.linalg.lstsq(gram, scatter[:-1, -1], rcond=None)[0]
    return w, float(mean[-1] - mean[:-1] @ w)


def fit_folds(rows: DataFrame, alpha: float) -> DataFrame:
    """fold, weights, intercept, pattern: fitted on all rows but the fold's (and its embargo).

    rows: trial, fold, guard (folds that must not learn from the row, its own among them), x
    with the target last. Every fold's training moments are the whole less those it must not see.
    pattern is the training covariance times the weights.
    """
    everything = moments(rows.withColumn("fold", F.lit(-1).cast("long")), ["fold"])
    barred = moments(rows.select(F.explode(F.col("guard").cast("array<long>")).alias("fold"), "x"), ["fold"])
    whole = everything.select(F.col("s").alias("whole"), F.col("width").alias("w"))
    rest = barred.join(whole, F.col("width") == F.col("w")).select("fold", F.zip_with("whole", "s", lambda a, b: a - b).alias("s"))

    def one(s) -> list[dict]:
        w, base = ridge_weights(s, alpha)
        return [{"weights": w.tolist(), "intercept": base, "pattern": (split(s)[2][:-1, :-1] @ w).tolist()}]

    return per_group(rest, ["fold"], "weights array<double>, intercept double, pattern array<double>", one)


def cross_predictions(rows: DataFrame, alpha: float) -> DataFrame:
    """trial, fold, y, predicted: every row by the model of its fold."""
    models = fit_folds(rows, alpha).select("fold", "weights", "intercept")
    n = F.size("x")
    dot = F.aggregate(F.zip_with(F.slice("x", F.lit(1), n - 1), "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(models, "fold").select("trial", "fold", F.element_at("x", -1).alias("y"), (dot + F.col("intercept")).alias("predicted"))


def bootstrap_spread(rows: DataFrame, alpha: float, draws: int, seed: int = 1000) -> DataFrame:
    """j, mean, sd of every weight over Poisson bootstrap draws.

    A row is in a draw as often as a Poisson number says that follows from its trial and the
    draw alone, so results don't depend on partitions. Tasks sum weighted moments per draw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float)
            keys = batch["trial"].to_numpy(zero_copy_only=False).astype(np.uint64)
            wide = np.column_stack([np.ones(len(x)), x])
            own = np.stack([(poisson_of(keys, seed + d)[:, None] * wide).T @ wide for d in range(draws)])
            sums = own if sums is None else sums + own
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(draws)), pa.array(sums.reshape(draws, -1).tolist(), pa.list_(pa.float64()))], names=["draw", "s"]
            )

    each = rows.select("trial", "x").mapInArrow(run, "draw long, s array<double>")
    cells = each.select("draw", F.posexplode("s").alias("i", "v")).groupBy("draw", "i").agg(F.sum("v").alias("v"))
    drawn = cells.groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("s"))
    fitted = per_group(drawn, ["draw"], "weights array<double>", lambda s: [{"weights": ridge_weights(s, alpha)[0].tolist()}])
    each_weight = fitted.select(F.posexplode("weights").alias("j", "w"))
    return each_weight.groupBy(F.col("j").cast("long").alias("j")).agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"))


def poisson_of(keys: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson number of mean 1 for each key."""
    u = np.uint64
    x = (keys + u(seed) * u(0x9E3779B97F4A7C15)) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    uniform = ((x ^ (x >> u(31))) >> u(11)).astype(float) / float(1 << 53)
    steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])
    return np.searchsorted(steps, uniform, "right").astype(float)


# --- a small network ------------------------------------------------------------------


def start_network(inputs: int, hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    return {
        "W1": draw.normal(size=(inputs, hidden)) / np.sqrt(inputs), "b1": np.zeros(hidden),
        "W2": draw.normal(size=(hidden, 1)) / np.sqrt(hidden), "b2": np.zeros(1),
    }


def network_output(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations and outputs of one tanh layer."""
    hidden = np.tanh(x @ p["W1"] + p["b1"])
    return hidden, (hidden @ p["W2"] + p["b2"])[:, 0]


def gradient_sums(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The squared error summed over rows, and its gradient."""
    hidden, out = network_output(p, x)
    off = out - y
    back = 2 * off[:, None]
    inner = back * p["W2"].T * (1 - hidden * hidden)
    return float(off @ off), {"W1": x.T @ inner, "b1": inner.sum(axis=0), "W2": hidden.T @ back, "b2": back.sum(axis=0)}


def numerical_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, step: float = 1e-6) -> dict[str, np.ndarray]:
    """The gradient of the summed squared error by central differences: what ``gradient_sums`` must give."""
    at, out = flat(p), np.empty(flat(p).size)
    for i in range(len(at)):
        up, down = at.copy(), at.copy()
        up[i], down[i] = up[i] + step, down[i] - step
        out[i] = (gradient_sums(shaped(up, p), x, y)[0] - gradient_sums(shaped(down, p), x, y)[0]) / (2 * step)
    return shaped(out, p)


def cross_val_network(rows: DataFrame, folds: int, hidden: int, steps: int, rate: float, seed: int = 0) -> tuple[DataFrame, list[dict[str, np.ndarray]]]:
    """trial, fold, y, predicted of rows (trial, fold, x with the target last), each by the network that never saw its fold.

    All networks take a step in one job: a task adds up the gradients of each over the rows of
    the other folds. The rows are written once and read again for every step.
    """
    held = settled(rows.select("trial", "fold", "x"))
    width = held.select(F.size("x")).first()
    if width is None:
        raise ValueError("there is nothing to learn from")
    nets = [start_network(width[0] - 1, hidden, seed) for _ in range(folds)]
    size = flat(nets[0]).size
    for _ in range(steps):
        now = list(nets)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((folds, size + 1))
            for batch in batches:
                x = np.array(batch["x"].to_pylist(), float).reshape(len(batch), -1)
                fold = batch["fold"].to_numpy(zero_copy_only=False)
                for k in range(folds):
                    own = x[fold != k]
                    if len(own):
                        sums[k] += np.concatenate([[len(own)], flat(gradient_sums(now[k], own[:, :-1], own[:, -1])[1])])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["i", "v"])

        added = np.zeros(folds * (size + 1))
        for r in held.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            added[r["i"]] = r["v"]
        added = added.reshape(folds, -1)
        nets = [shaped(flat(p) - rate * a[1:] / max(a[0], 1), p) for p, a in zip(nets, added, strict=True)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(len(batch), -1)
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            out = np.full(len(batch), np.nan)
            for k in range(folds):
                if (fold == k).any():
                    out[fold == k] = network_output(nets[k], x[fold == k, :-1])[1]
            y = x[:, -1] if x.size else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["trial"], pa.array(fold.astype(np.int64)), pa.array(y), pa.array(out)], names=["trial", "fold", "y", "predicted"])

    return held.mapInArrow(predict, "trial long, fold long, y double, predicted double"), nets


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in ("W1", "b1", "W2", "b2")])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in ("W1", "b1", "W2", "b2"):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train_network(rows: DataFrame, hidden: int, steps: int, rate: float, decay: float = 0.0, seed: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:
    """Parameters and the mean squared error before each step of full gradient descent.

    rows: x with the target last. A step is a job: tasks sum their rows' gradients, Spark adds
    the sums up, the driver holds one gradient, of the size of the network.
    """
    width = rows.select(F.size("x")).first()
    if width is None:
        raise ValueError("there is nothing to learn from")
    p = start_network(width[0] - 1, hidden, seed)
    history = []
    for _ in range(steps):
        now = p

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(flat(now).size + 2)
            for batch in batches:
                x = np.array(batch["x"].to_pylist(), float).reshape(len(batch), -1)
                if len(x):
                    error, grads = gradient_sums(now, x[:, :-1], x[:, -1])
                    sums += np.concatenate([[len(x), error], flat(grads)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["i", "v"])

        added = rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(flat(p).size + 2)
        for r in added:
            sums[r["i"]] = r["v"]
        history.append(sums[1] / sums[0])
        p = shaped(flat(p) * (1 - rate * decay) - rate * sums[2:] / sums[0], p)
    return p, history


def network_predictions(rows: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """trial, y, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(len(batch), -1)
            if len(x):
                out = network_output(p, x[:, :-1])[1]
                yield pa.RecordBatch.from_arrays([batch["trial"], pa.array(x[:, -1]), pa.array(out)], names=["trial", "y", "predicted"])

    return rows.select("trial", "x").mapInArrow(run, "trial long, y double, predicted double")
