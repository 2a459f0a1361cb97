"""Contrastive training of the dense encoder on a bounded sample, resumable epoch by epoch."""

from __future__ import annotations

import hashlib
import json
import math
import os
import pickle
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.layout import Layout
from fernwake.operators.contrastive import Views, augment_matrix, loss_and_gradient
from fernwake.operators.encoders import NORM_EPS, Shape, Weights, new_weights

OPTIMIZERS, SCHEDULES = ("adamw", "adam", "sgd"), ("cosine", "step", "none")
MOST_ROWS = 200_000  # rows of the training sample, which the driver holds
RUNNING = 0.1  # share of a batch's moments in the running ones


@dataclass(frozen=True)
class Training:
    """Settings of the training loop."""

    loss: str = "imbalance"
    epochs: int = 50
    batch: int = 1024
    steps: int | None = None
    rate: float = 1e-3
    decay: float = 1e-4
    optimizer: str = "adamw"
    schedule: str = "cosine"
    clip: float = 5.0
    positive_fraction: float = 0.5
    seed: int = 0
    checkpoint_every: int = 1

    def __post_init__(self) -> None:
        if self.optimizer not in OPTIMIZERS or self.schedule not in SCHEDULES:
            raise ValueError(f"optimizer must be one of {OPTIMIZERS}, schedule one of {SCHEDULES}")
        if self.batch < 2 or self.epochs < 1 or not 0 < self.positive_fraction < 1 or self.checkpoint_every < 1 or self.steps is not None and self.steps < 1:
            raise ValueError("batch must be 2 or more, epochs, steps and checkpoint_every positive, positive_fraction between 0 and 1")


def rate_at(t: Training, epoch: int) -> float:
    """The learning rate of an epoch from 0."""
    if t.schedule == "cosine":
        return t.rate * (1 + math.cos(math.pi * epoch / t.epochs)) / 2
    return t.rate * 0.5 ** (epoch // 10) if t.schedule == "step" else t.rate


class Optimizer:
    """Adam with decay apart from (adamw) or in the gradient, or descent with momentum."""

    def __init__(self, t: Training, w: Weights) -> None:
        self.t, self.n = t, 0
        self.first = {k: np.zeros_like(v) for k, v in w.items()}
        self.second = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, w: Weights, g: Weights, rate: float) -> None:
        self.n += 1
        size = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
        shrink = min(1.0, self.t.clip / (size + 1e-6)) if self.t.clip > 0 else 1.0
        for k, d in g.items():
            d = d * shrink
            if self.t.optimizer == "adamw":
                w[k] -= rate * self.t.decay * w[k]
            else:
                d = d + self.t.decay * w[k]
            if self.t.optimizer == "sgd":
                self.first[k] = 0.9 * self.first[k] + d
                w[k] -= rate * self.first[k]
                continue
            self.first[k] += 0.1 * (d - self.first[k])
            self.second[k] += 0.001 * (d * d - self.second[k])
            w[k] -= rate * (self.first[k] / (1 - 0.9**self.n)) / (np.sqrt(self.second[k] / (1 - 0.999**self.n)) + 1e-8)


def forward_backward(x: np.ndarray, y: np.ndarray, views: int, w: Weights, s: Shape, loss: str) -> tuple[float, Weights, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Loss of a batch (rows x views, row by row), its gradient, and the batch moments of each normalisation."""
    layers, moments, h = [], {}, x
    for i in range(len(s.hidden)):
        z = h @ w[f"dense{i}.w"] + w[f"dense{i}.b"]
        mean, var = z.mean(0), z.var(0)
        moments[f"norm{i}"] = mean, var * len(z) / max(len(z) - 1, 1)
        unit = (z - mean) / np.sqrt(var + NORM_EPS)
        out = unit * w[f"norm{i}.gain"] + w[f"norm{i}.shift"]
        layers.append((h, var, unit, out > 0))
        h = np.maximum(out, 0)
    last = f"dense{len(s.hidden)}"
    e = h @ w[f"{last}.w"] + w[f"{last}.b"]
    a = e @ w["head0.w"] + w["head0.b"]
    r = np.maximum(a, 0)
    p = r @ w["head1.w"] + w["head1.b"]
    length = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    u = p / length
    value, gu = loss_and_gradient(u.reshape(-1, views, u.shape[1]), y, loss)
    gu = gu.reshape(u.shape)
    g: Weights = {}

    def dense(at: str, inputs: np.ndarray, d: np.ndarray) -> np.ndarray:
        g[f"{at}.w"], g[f"{at}.b"] = inputs.T @ d, d.sum(0)
        return d @ w[f"{at}.w"].T

    d = (gu - u * (gu * u).sum(1, keepdims=True)) / length
    d = dense("head1", r, d) * (a > 0)
    d = dense(last, h, dense("head0", e, d))
    for i in range(len(s.hidden) - 1, -1, -1):
        inputs, var, unit, open_ = layers[i]
        d = d * open_
        g[f"norm{i}.gain"], g[f"norm{i}.shift"] = (d * unit).sum(0), d.sum(0)
        d = d * w[f"norm{i}.gain"]
        d = (d - d.mean(0) - unit * (d * unit).mean(0)) / np.sqrt(var + NORM_EPS)
        d = dense(f"dense{i}", inputs, d)
    return value, g, moments


def _signature(x: np.ndarray, y: np.ndarray, *settings) -> str:
    h = hashlib.sha256(np.ascontiguousarray(x).tobytes())
    h.update(np.ascontiguousarray(y).tobytes())
    h.update(json.dumps([asdict(s) for s in settings], sort_keys=True, default=str).encode())
    return h.hexdigest()


def train(x: np.ndarray, y: np.ndarray, layout: Layout, s: Shape = Shape("mlp"), t: Training = Training(), views: Views = Views(), checkpoint: str | None = None, stop_after: int | None = None) -> tuple[Weights, list[float]]:
    """Weights and each epoch's mean loss of the dense encoder.

    A batch draws each of its rows from class 1 with ``positive_fraction``, with replacement, and
    every row in ``views.n`` augmented views. All draws come from (seed, epoch, step), so a run
    that goes on from a checkpoint ends with the same weights as one that never stopped. A
    checkpoint of other data or settings is refused.
    """
    if s.arch != "mlp":
        raise ValueError("only the dense encoder is trained here")
    x, y = np.asarray(x, np.float64), np.asarray(y).astype(np.int64)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(pos) or not len(neg):
        raise ValueError("both classes are needed")
    if len(y) < t.batch and t.steps is None:
        raise ValueError("the rows are fewer than one batch")
    w, losses, start = new_weights(s, layout, t.seed), [], 0
    opt, signature = Optimizer(t, w), _signature(x, y, s, t, views)
    if checkpoint and os.path.exists(checkpoint):
        with open(checkpoint, "rb") as f:
            saved = pickle.load(f)
        if saved["signature"] != signature:
            raise ValueError("the checkpoint is of other data or settings")
        w, losses, start = saved["weights"], saved["losses"], saved["epoch"]
        opt.first, opt.second, opt.n = saved["optimizer"]
    for epoch in range(start, t.epochs if stop_after is None else min(stop_after, t.epochs)):
        got = []
        for step in range(t.steps or len(y) // t.batch):
            rng = np.random.default_rng([t.seed, epoch, step])
            from_pos = rng.random(t.batch) < t.positive_fraction
            at = np.where(from_pos, pos[rng.integers(0, len(pos), t.batch)], neg[rng.integers(0, len(neg), t.batch)])
            batch = augment_matrix(np.repeat(x[at], views.n, axis=0), views, layout, rng)
            value, g, moments = forward_backward(batch, y[at], views.n, w, s, t.loss)
            opt.step(w, g, rate_at(t, epoch))
            for k, (mean, var) in moments.items():
                w[f"{k}.mean"] += RUNNING * (mean - w[f"{k}.mean"])
                w[f"{k}.var"] += RUNNING * (var - w[f"{k}.var"])
            got.append(value)
        losses.append(float(np.mean(got)))
        if checkpoint and ((epoch + 1) % t.checkpoint_every == 0 or epoch + 1 == t.epochs):
            os.makedirs(os.path.dirname(checkpoint) or ".", exist_ok=True)
            with open(f"{checkpoint}.tmp", "wb") as f:
                pickle.dump({"signature": signature, "epoch": epoch + 1, "weights": w, "losses": losses, "optimizer": (opt.first, opt.second, opt.n)}, f)
            os.replace(f"{checkpoint}.tmp", checkpoint)
    return w, losses


def train_on(rows: DataFrame, layout: Layout, s: Shape = Shape("mlp"), t: Training = Training(), views: Views = Views(), most: int = MOST_ROWS, checkpoint: str | None = None) -> tuple[Weights, list[float]]:
    """``train`` on at most ``most`` rows (id, label, vec) by a hash of the id; rows that are incomplete or not finite are no sample."""
    usable = rows.select("id", F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec")).dropna()
    usable = usable.where((F.size("vec") == len(layout.columns)) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)))
    got = usable.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    x = got["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(layout.columns))
    return train(x, got["label"].to_numpy(), layout, s, t, views, checkpoint)
