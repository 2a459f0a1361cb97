"""Encoders of windows and window sequences: inference with given weights, projection heads, their size and cost."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.arrays import from_matrix, to_matrix
from fernwake.functions.layout import Layout

ARCHITECTURES = ("mlp", "cnn1d", "tcn", "cnn1d_transformer")
NORM_EPS = 1e-5  # of batch and layer normalisation
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """An encoder's architecture and sizes; ``steps`` windows make a sequence."""

    arch: str = "cnn1d"
    embedding: int = 128
    hidden: tuple[int, ...] = (256, 256)
    channels: tuple[int, ...] = (64, 128, 128)
    kernel: int = 3
    heads: int = 4
    blocks: int = 2
    projection: int = 64
    projection_hidden: int = 128
    steps: int = 1

    def __post_init__(self) -> None:
        if self.arch not in ARCHITECTURES:
            raise ValueError(f"arch must be one of {ARCHITECTURES}")
        if self.embedding < 1 or self.steps < 1 or self.arch == "cnn1d_transformer" and self.embedding % self.heads:
            raise ValueError("embedding and steps must be positive, and heads divide the embedding")


# ---- layers: x is rows first ---------------------------------------------------------------------


def dense(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    return x @ w[f"{at}.w"] + w[f"{at}.b"]


def batch_norm(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    """By the running mean and variance; the channels are the second axis."""
    across = (slice(None), *[None] * (x.ndim - 2))
    scale = w[f"{at}.gain"] / np.sqrt(w[f"{at}.var"] + NORM_EPS)
    return x * scale[across] + (w[f"{at}.shift"] - w[f"{at}.mean"] * scale)[across]


def layer_norm(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + NORM_EPS) * w[f"{at}.gain"] + w[f"{at}.shift"]


def conv(x: np.ndarray, w: Weights, at: str, dilation: int = 1, causal: bool = False) -> np.ndarray:
    """Along the last axis of rows x channels x length, with zeros around it; causal ones see no later step."""
    kernel = w[f"{at}.w"]  # out x in x width
    reach = (kernel.shape[2] - 1) * dilation
    p = np.pad(x, ((0, 0), (0, 0), (reach, 0) if causal else (reach // 2, reach - reach // 2)))
    taps = np.stack([p[:, :, i * dilation : i * dilation + x.shape[2]] for i in range(kernel.shape[2])], -1)
    return np.einsum("nclk,ock->nol", taps, kernel) + w[f"{at}.b"][None, :, None]


def attention(x: np.ndarray, w: Weights, at: str, heads: int) -> np.ndarray:
    n, t, d = x.shape
    q, k, v = (dense(x, w, f"{at}.{c}").reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3) for c in "qkv")
    s = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // heads)
    a = np.exp(s - s.max(-1, keepdims=True))
    return dense(((a / a.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(n, t, d), w, f"{at}.o")


# ---- encoders: rows x features, or rows x steps x features ---------------------------------------


def _mlp(x: np.ndarray, w: Weights, s: Shape, layout: Layout) -> np.ndarray:
    """All steps side by side; dense layers with batch normalisation and a rectifier between them."""
    h = x.reshape(len(x), -1)
    for i in range(len(s.hidden)):
        h = np.maximum(batch_norm(dense(h, w, f"dense{i}"), w, f"norm{i}"), 0)
    return dense(h, w, f"dense{len(s.hidden)}")


def _cnn(x: np.ndarray, w: Weights, s: Shape, layout: Layout) -> np.ndarray:
    """Convolutions over the electrodes, feature types being the channels (one channel where the layout isn't regular); a sequence's steps are averaged."""
    if x.ndim == 3:
        return _cnn(x.reshape(-1, x.shape[2]), w, s, layout).reshape(len(x), x.shape[1], -1).mean(1)
    if layout.regular and x.shape[1] == len(layout.columns):
        order = [i for g in layout.channel_groups() for i in g]
        h = x[:, order].reshape(len(x), len(layout.channels), len(layout.types)).transpose(0, 2, 1)
    else:
        h = x[:, None]
    for i in range(len(s.channels)):
        h = np.maximum(batch_norm(conv(h, w, f"conv{i}"), w, f"norm{i}"), 0)
    return dense(h.mean(2), w, "out")


def _tcn(x: np.ndarray, w: Weights, s: Shape, layout: Layout) -> np.ndarray:
    """Blocks of two causal convolutions of doubling dilation with a residual; the mean over the steps."""
    h = (x if x.ndim == 3 else x[:, None]).transpose(0, 2, 1)
    for i in range(len(s.channels)):
        y = np.maximum(conv(h, w, f"block{i}.first", 2**i, True), 0)
        y = np.maximum(conv(y, w, f"block{i}.second", 2**i, True), 0)
        h = np.maximum(y + (conv(h, w, f"block{i}.skip") if f"block{i}.skip.w" in w else h), 0)
    return dense(h.mean(2), w, "out")


def _transformer(x: np.ndarray, w: Weights, s: Shape, layout: Layout) -> np.ndarray:
    """Each step by the convolutional encoder, then attention over a leading class token and the steps; the token is read."""
    x = x if x.ndim == 3 else x[:, None]
    tokens = _cnn(x.reshape(-1, x.shape[2]), w, s, layout).reshape(len(x), x.shape[1], -1)
    h = np.concatenate([np.broadcast_to(w["token"], (len(x), 1, s.embedding)), tokens], 1)
    for i in range(s.blocks):
        h = layer_norm(h + attention(h, w, f"layer{i}", s.heads), w, f"layer{i}.norm0")
        h = layer_norm(h + dense(np.maximum(dense(h, w, f"layer{i}.up"), 0), w, f"layer{i}.down"), w, f"layer{i}.norm1")
    return h[:, 0]


ENCODERS: dict[str, Callable[[np.ndarray, Weights, Shape, Layout], np.ndarray]] = {"mlp": _mlp, "cnn1d": _cnn, "tcn": _tcn, "cnn1d_transformer": _transformer}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def encode(x: np.ndarray, w: Weights, s: Shape, layout: Layout, normalize: bool = False) -> np.ndarray:
    h = ENCODERS[s.arch](x, w, s, layout)
    return unit(h) if normalize else h


def project(x: np.ndarray, w: Weights, s: Shape, layout: Layout) -> np.ndarray:
    """What the contrastive loss sees: the encoding through a head of two dense layers, at length 1."""
    return unit(dense(np.maximum(dense(encode(x, w, s, layout), w, "head0"), 0), w, "head1"))


def new_weights(s: Shape, layout: Layout, seed: int) -> Weights:
    """Random weights: uniform within 1 / sqrt(inputs), normalisations neutral, the token zero."""
    rng = np.random.default_rng(seed)
    w: Weights = {}

    def layer(at: str, *shape: int, inputs: int) -> None:
        r = 1 / math.sqrt(inputs)
        w[f"{at}.w"] = rng.uniform(-r, r, shape)
        w[f"{at}.b"] = rng.uniform(-r, r, shape[0] if len(shape) == 3 else shape[1])

    def norm(at: str, n: int, running: bool = True) -> None:
        w[f"{at}.gain"], w[f"{at}.shift"] = np.ones(n), np.zeros(n)
        if running:
            w[f"{at}.mean"], w[f"{at}.var"] = np.zeros(n), np.ones(n)

    n = len(layout.columns)
    if s.arch == "mlp":
        sizes = [n * s.steps, *s.hidden, s.embedding]
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            layer(f"dense{i}", a, b, inputs=a)
            if i < len(s.hidden):
                norm(f"norm{i}", b)
    elif s.arch == "tcn":
        sizes = [n, *s.channels]
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            layer(f"block{i}.first", b, a, s.kernel, inputs=a * s.kernel)
            layer(f"block{i}.second", b, b, s.kernel, inputs=b * s.kernel)
            if a != b:
                layer(f"block{i}.skip", b, a, 1, inputs=a)
        layer("out", sizes[-1], s.embedding, inputs=sizes[-1])
    else:
        sizes = [len(layout.types) if layout.regular else 1, *s.channels]
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            layer(f"conv{i}", b, a, s.kernel, inputs=a * s.kernel)
            norm(f"norm{i}", b)
        layer("out", sizes[-1], s.embedding, inputs=sizes[-1])
        if s.arch == "cnn1d_transformer":
            e = s.embedding
            w["token"] = np.zeros((1, 1, e))
            for i in range(s.blocks):
                for c in "qkvo":
                    layer(f"layer{i}.{c}", e, e, inputs=e)
                layer(f"layer{i}.up", e, 2 * e, inputs=e)
                layer(f"layer{i}.down", 2 * e, e, inputs=2 * e)
                norm(f"layer{i}.norm0", e, False)
                norm(f"layer{i}.norm1", e, False)
    layer("head0", s.embedding, s.projection_hidden, inputs=s.embedding)
    layer("head1", s.projection_hidden, s.projection, inputs=s.projection_hidden)
    return w


def embed(rows: DataFrame, w: Weights, s: Shape, layout: Layout, normalize: bool = True, projected: bool = False) -> DataFrame:
    """id and ``embedding`` of each row (id, vec of steps x features), batch by batch.

    Entries that are missing or not finite count as 0. Rows whose vector is null or of another
    length are left out.
    """
    dim = len(layout.columns) * s.steps
    shared = rows.sparkSession.sparkContext.broadcast(w)  # a model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, taken = to_matrix(batch.column(1), dim)
            x = np.where(np.isfinite(m), m, 0.0).astype(np.float64)
            x = x.reshape(-1, s.steps, len(layout.columns)) if s.steps > 1 else x
            e = [project(x[i : i + 1024], shared.value, s, layout) if projected else encode(x[i : i + 1024], shared.value, s, layout, normalize) for i in range(0, len(x), 1024)]
            out = np.concatenate(e) if e else np.zeros((0, s.projection if projected else s.embedding))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(taken)), from_matrix(out)], ["id", "embedding"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(run, "id long, embedding array<float>")


def count_parameters(w: Weights) -> tuple[int, int]:
    """All numbers of a model, and those that training changes (running means and variances aren't)."""
    trained = sum(v.size for k, v in w.items() if not k.endswith((".mean", ".var")))
    return trained, trained


def flops(w: Weights, s: Shape, layout: Layout) -> int:
    """Multiplications and additions of one sample through dense layers, convolutions and the attention's products."""
    n, t = len(layout.columns), s.steps
    length = len(layout.channels) if layout.regular else n
    total = 0
    for k, v in w.items():
        if not k.endswith(".w") or k.startswith("head"):
            continue
        times = 1
        if k.startswith("conv"):
            times = length * t
        elif k.startswith("block"):
            times = t
        elif k.startswith("layer"):
            times = t + 1
        elif k == "out.w" and s.arch != "tcn":
            times = t
        total += 2 * v.size * times
    if s.arch == "cnn1d_transformer":
        total += s.blocks * 4 * (t + 1) ** 2 * s.embedding
    return total


def model_stats(w: Weights, s: Shape, layout: Layout) -> dict[str, int]:
    """Parameters, trained ones and operations a sample."""
    n, trained = count_parameters(w)
    return {"n_params": n, "n_trainable": trained, "flops": flops(w, s, layout)}
