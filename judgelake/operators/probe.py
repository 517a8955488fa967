"""Linear probes on feature vectors: scaling, training, scoring, calibration."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions.num import sigmoid, six, softplus
from judgelake.runtime import Stage


def feature_scale(rows: DataFrame, vector: str, least: float = 1e-6) -> DataFrame:
    """(feature, mean, std): population figures of each place of the vectors; std at least `least`."""
    each = rows.select(F.posexplode(vector).alias("feature", "x"))
    return each.groupBy(F.col("feature").cast("bigint").alias("feature")).agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.greatest(F.stddev_pop(F.col("x").cast("double")), F.lit(least)).alias("std")
    )


def probe_probability(vector: Column, weights: list[float], bias: float, mean: list[float], std: list[float]) -> Column:
    """sigmoid of the weighted standardised vector. Scaling is folded into the weights, so a row costs one dot product."""
    w = [a / s for a, s in zip(weights, std, strict=True)]
    b = bias - sum(a * m for a, m in zip(w, mean, strict=True))
    total = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda x, y: x.cast("double") * y), F.lit(float(b)), lambda s, x: s + x)
    return sigmoid(total)


def train_probe(rows: DataFrame, vector: str, label: str, rounds: int = 20, decay: float = 1e-3) -> dict[str, object]:
    """Logistic regression by Newton steps on sums that the executors form; positives are weighed to the negatives' number.

    One pass a round brings a gradient and a Hessian of the vector's size squared to the driver, whatever the rows.
    """
    scale = feature_scale(rows, vector).orderBy("feature").collect()  # as many rows as features
    mean, std = np.array([r["mean"] for r in scale]), np.array([r["std"] for r in scale])
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    heavier = counts["n"] / max(1, counts["p"])
    size = len(mean)
    w = np.zeros(size + 1)
    data = rows.select(F.col(vector).alias("v"), F.col(label).cast("double").alias("y")).filter("v is not null and y is not null")

    def step(w: np.ndarray):
        def run(batches):
            g, h = np.zeros(size + 1), np.zeros((size + 1, size + 1))
            for pdf in batches:
                if len(pdf):
                    x = np.hstack([(np.vstack(pdf["v"]) - mean) / std, np.ones((len(pdf), 1))])
                    y = pdf["y"].to_numpy()
                    k = np.where(y == 1, heavier, 1.0)
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    g += x.T @ (k * (p - y))
                    h += (x * (k * p * (1 - p))[:, None]).T @ x
            yield pd.DataFrame({"i": np.arange((size + 1) * (size + 2)), "v": np.concatenate([g, h.ravel()])})

        parts = data.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros((size + 1) * (size + 2))
        for r in parts:
            flat[r["i"]] = r["v"]
        return flat[: size + 1], flat[size + 1 :].reshape(size + 1, size + 1)

    for _ in range(rounds):
        g, h = step(w)
        ridge = decay * np.eye(size + 1) * max(1.0, counts["p"] + counts["n"])
        change = np.linalg.solve(h + ridge, g + ridge @ w)
        w = w - change
        if np.abs(change).max() < 1e-8:
            break
    return {"weights": w[:-1].tolist(), "bias": float(w[-1]), "mean": mean.tolist(), "std": std.tolist(), "feature_dim": size}


def platt(rows: DataFrame, logit: str, label: str, rounds: int = 30) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit + b) by Newton steps over six sums a round; a stays positive."""
    a, b = 1.0, 0.0
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    known = rows.filter(z.isNotNull() & y.isNotNull()).select(z.alias("z"), y.alias("y"))
    for _ in range(rounds):
        p = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
        e, q = p - F.col("y"), p * (1 - p)
        s = known.agg(F.sum(e * F.col("z")).alias("ga"), F.sum(e).alias("gb"), F.sum(q * F.col("z") * F.col("z")).alias("haa"), F.sum(q * F.col("z")).alias("hab"), F.sum(q).alias("hbb")).first()
        if s["ga"] is None:
            break
        da, db = np.linalg.solve(np.array([[s["haa"] + 1e-9, s["hab"]], [s["hab"], s["hbb"] + 1e-9]]), np.array([s["ga"], s["gb"]]))
        a, b = max(1e-6, a - da), b - db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return float(a), float(b)


def losses(rows: DataFrame, prob: str, label: str) -> DataFrame:
    """Negative log likelihood (from the logit), Brier score and mean probabilities, in all and by class."""
    p, y = F.col(prob), F.col(label)
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.log(q / (1 - q))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), six(F.avg(softplus(z) - y * z)).alias("nll"), six(F.avg((p - y) * (p - y))).alias("brier"),
        six(F.avg(p)).alias("mean_prob"), six(F.avg(F.when(y == 1, p))).alias("mean_prob_positive"), six(F.avg(F.when(y == 0, p))).alias("mean_prob_negative"),
    )


def select_layers(spec: str, layers: int) -> list[int]:
    """Layers from 1 on: last, all, auto (a quarter, half, three quarters and the whole of them) or a list, in which
    negative ones count from the end. Repeats are left out; a layer that isn't there is an error."""
    if spec == "all":
        return list(range(1, layers + 1))
    named = {"last": [layers], "auto": [max(1, k * layers // 4) for k in (1, 2, 3, 4)]}
    picked = named[spec] if spec in named else [int(x) for x in spec.split(",") if x.strip()]
    out = list(dict.fromkeys(x + layers + 1 if x < 0 else x for x in picked))
    for x in out:
        if not 1 <= x <= layers:
            raise ValueError(f"no layer {x} of {layers}")
    return out


class Network:
    """A head on vectors: logistic regression, or one hidden layer with GELU before it. Weights are one flat array."""

    def __init__(self, size: int, hidden: int) -> None:
        self.size, self.hidden = size, hidden
        self.length = size + 1 if not hidden else (size + 1) * hidden + hidden + 1

    def start(self, seed: int) -> np.ndarray:
        if not self.hidden:
            return np.zeros(self.length)
        return np.random.default_rng(seed).normal(0, 1 / np.sqrt(self.size), self.length)

    def logits(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        if not self.hidden:
            return x @ w[:-1] + w[-1], ()
        cut = (self.size + 1) * self.hidden
        inner = w[:cut].reshape(self.size + 1, self.hidden)
        z = x @ inner[:-1] + inner[-1]
        t = np.tanh(0.7978845608 * (z + 0.044715 * z**3))
        a = 0.5 * z * (1 + t)
        return a @ w[cut:-1] + w[-1], (z, t, a, cut)

    def gradient(self, w: np.ndarray, x: np.ndarray, d: np.ndarray, kept: tuple) -> np.ndarray:
        """Gradient of the sum of losses; d is that of each logit."""
        if not self.hidden:
            return np.concatenate([x.T @ d, [d.sum()]])
        z, t, a, cut = kept
        slope = 0.5 * (1 + t) + 0.5 * z * (1 - t**2) * 0.7978845608 * (1 + 3 * 0.044715 * z**2)
        back = d[:, None] * w[cut:-1] * slope
        return np.concatenate([np.vstack([x.T @ back, back.sum(axis=0)]).ravel(), a.T @ d, [d.sum()]])


def train_network(rows: DataFrame, vector: str, label: str, dev: str, hidden: int = 0, epochs: int = 40, rate: float = 0.05, decay: float = 1e-2, seed: int = 1) -> dict[str, object]:
    """A head trained by AdamW on all rows at once; the weights of the epoch with the least loss on the dev rows stay.

    dev: boolean column of the rows held back. Vectors are standardised by the training rows, and positives weighed to
    the negatives' number. Each epoch is one pass in which the executors sum the gradient and both losses; to the driver
    comes as much as the head has weights, whatever the rows.
    """
    kept = Stage(rows.sparkSession).keep(rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"), F.col(dev).alias("dev")).filter("v is not null and y is not null and dev is not null"))
    train = kept.filter("not dev")
    scale = feature_scale(train, "v").orderBy("feature").collect()  # as many rows as features
    mean, std = np.array([r["mean"] for r in scale]), np.array([r["std"] for r in scale])
    counts = train.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    heavier, total = counts["n"] / max(1, counts["p"]), max(1, counts["n"] + counts["p"])
    net = Network(len(mean), hidden)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches):
            out = np.zeros(net.length + 2)
            for pdf in batches:
                if not len(pdf):
                    continue
                x, y, held = (np.vstack(pdf["v"]) - mean) / std, pdf["y"].to_numpy(), pdf["dev"].to_numpy(dtype=bool)
                z, inner = net.logits(w, x)
                k = np.where(y == 1, heavier, 1.0)
                loss = k * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z)
                d = np.where(held, 0.0, k * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y))
                out[:-2] += net.gradient(w, x, d, inner)
                out[-2] += loss[held].sum()
                out[-1] += held.sum()
            yield pd.DataFrame({"i": np.arange(len(out)), "v": out})

        parts = kept.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(net.length + 2)
        for r in parts:
            flat[r["i"]] = r["v"]
        return flat

    w = net.start(seed)
    m, v, best = np.zeros(net.length), np.zeros(net.length), (float("inf"), 0, w)
    for epoch in range(epochs + 1):
        got = sums(w)
        loss = got[-2] / got[-1] if got[-1] else float("inf")
        if loss < best[0]:
            best = (loss, epoch, w.copy())
        g = got[:-2] / total
        t = epoch + 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * w)
    return {"network": net, "weights": best[2], "mean": mean, "std": std, "best_epoch": best[1], "best_dev_loss": best[0]}


def network_probability(rows: DataFrame, vector: str, head: dict[str, object], name: str = "p") -> DataFrame:
    """rows with the probability that a trained network gives; a null vector has none."""
    net, w, mean, std = head["network"], head["weights"], head["mean"], head["std"]

    @F.pandas_udf("double")
    def probability(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="float64", index=v.index)
        known = v.notna()
        if known.any():
            z, _ = net.logits(w, (np.vstack(v[known]) - mean) / std)
            out[known] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    return rows.withColumn(name, probability(F.col(vector).cast("array<double>")))
