"""Scoring of pixels: pooling, repeated runs, and an encoder in numpy that runs over Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.sources.arrays import opened


def softmax_pool(rows: DataFrame, score: Column, values: str, n: int, *keys: str) -> DataFrame:
    """(keys, dim, pooled): weighted sum of vectors of n values over time, the weights being the softmax of the scores of a
    key's rows. One shuffle by key: the highest score by a window, sums of n columns."""
    top = rows.withColumn("__s", score).withColumn("__w", F.exp(F.col("__s") - F.max("__s").over(Window.partitionBy(*keys))))
    sums = top.groupBy(*keys).agg(F.sum("__w").alias("__all"), *(F.sum(F.col("__w") * F.get(values, F.lit(k))).alias(f"__{k}") for k in range(n)))
    pooled = F.array(*(F.col(f"__{k}") / F.col("__all") for k in range(n)))
    return sums.select(*keys, F.posexplode(pooled).alias("dim", "pooled"))


def repeat_average(runs: DataFrame, values: str, *keys: str) -> DataFrame:
    """(keys, dim, value): mean of the vectors of several runs."""
    each = runs.select(*keys, F.posexplode(values).alias("dim", "value"))
    return each.groupBy(*keys, "dim").agg(F.avg("value").alias("value"))


def score_batches(rows: DataFrame, inputs: Sequence[str], key: str, make: Callable[[], Callable[..., np.ndarray]], width: int, dtype: str = "float") -> DataFrame:
    """(key, z): a scorer over Arrow batches. make() runs once a task, loads the weights and returns a function of arrays
    (batch, steps, bands), one for each input column, which are arrays of equally many arrays of equally many numbers."""
    kind, numbers = dict(rows.dtypes)[key], {"float": np.float32, "double": np.float64}[dtype]

    def array(c: pa.Array) -> np.ndarray:
        return c.flatten().flatten().to_numpy(zero_copy_only=False).astype(numbers).reshape(len(c), len(c[0]), len(c[0][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in batches:
            if not b.num_rows:
                continue
            scorer = scorer or make()
            z = scorer(*(array(b.column(k + 1)) for k in range(len(inputs)))).astype(numbers)
            offsets = pa.array(np.arange(0, (b.num_rows + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)))], [key, "z"])

    return rows.select(key, *inputs).mapInArrow(run, f"{key} {kind}, z array<{dtype}>")


@dataclass(frozen=True)
class EncoderShape:
    bands: int
    width: int = 16
    heads: int = 2
    layers: int = 1
    hidden: int = 32


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def random_weights(shape: EncoderShape, seed: int) -> dict[str, np.ndarray]:
    """Weights for tests and examples. Trained ones are arrays under the same names and of the same shapes: those under which
    a saved model of this kind has them (fixed values)."""
    rng = np.random.default_rng(seed)
    d, h = shape.width, shape.hidden
    make = lambda *s: rng.normal(0, 1 / np.sqrt(s[-1]), s).astype(np.float32)
    w = {
        "embedding.0.weight": make(d, shape.bands), "embedding.0.bias": make(d), "embedding.2.weight": make(d, d), "embedding.2.bias": make(d),
        "attn_pool.query.weight": make(1, d), "attn_pool.query.bias": make(1),
        "attn_pool.temporal_context.weight_ih_l0": make(3 * d, d), "attn_pool.temporal_context.weight_hh_l0": make(3 * d, d),
        "attn_pool.temporal_context.bias_ih_l0": make(3 * d), "attn_pool.temporal_context.bias_hh_l0": make(3 * d),
    }
    for k in range(shape.layers):
        at = f"transformer_encoder.layers.{k}."
        w |= {
            at + "self_attn.in_proj_weight": make(3 * d, d), at + "self_attn.in_proj_bias": make(3 * d), at + "self_attn.out_proj.weight": make(d, d), at + "self_attn.out_proj.bias": make(d),
            at + "linear1.weight": make(h, d), at + "linear1.bias": make(h), at + "linear2.weight": make(d, h), at + "linear2.bias": make(d),
        }
        w |= {f"{at}norm{j}.{part}": (1 if part == "weight" else 0) + make(d) / 10 for j in (1, 2) for part in ("weight", "bias")}
    return w


class _Layers:
    """The parts of a network by the names of their weights."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    def linear(self, x: np.ndarray, name: str, sep: str = ".") -> np.ndarray:
        return x @ self.w[f"{name}{sep}weight"].T + self.w[f"{name}{sep}bias"]

    def norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def attention(self, x: np.ndarray, name: str, heads: int) -> np.ndarray:
        n, t, d = x.shape
        q, k, v = (p.reshape(n, t, heads, -1).swapaxes(1, 2) for p in np.split(self.linear(x, f"{name}.in_proj", "_"), 3, axis=-1))
        mixed = softmax(q @ k.swapaxes(-1, -2) / np.sqrt(d // heads)) @ v
        return self.linear(mixed.swapaxes(1, 2).reshape(n, t, d), f"{name}.out_proj")

    def recurrent(self, x: np.ndarray, name: str) -> np.ndarray:
        """States of a gated recurrent unit: reset, update and new gate; the reset gate scales the state's part of the new
        one, and the update gate keeps the old state."""
        into = x @ self.w[f"{name}.weight_ih_l0"].T + self.w[f"{name}.bias_ih_l0"]
        state, states = np.zeros_like(x[:, 0]), []
        for t in range(x.shape[1]):
            own = state @ self.w[f"{name}.weight_hh_l0"].T + self.w[f"{name}.bias_hh_l0"]
            (ri, zi, ni), (rh, zh, nh) = np.split(into[:, t], 3, axis=-1), np.split(own, 3, axis=-1)
            keep = sigmoid(zi + zh)
            state = keep * state + (1 - keep) * np.tanh(ni + sigmoid(ri + rh) * nh)
            states.append(state)
        return np.stack(states, axis=1)


def encode(x: np.ndarray, weights: dict[str, np.ndarray], shape: EncoderShape) -> np.ndarray:
    """(batch, steps, bands and day) to (batch, width): an embedding plus the encoded day, attention layers with the norm
    behind each part, and pooling of their output by weights that a recurrent pass over it gives."""
    net = _Layers(weights)
    bands, doy = x[..., : shape.bands], x[..., shape.bands]
    angle = doy[..., None] * np.exp(-np.log(10000.0) * np.arange(0, shape.width, 2) / shape.width)
    day = np.stack([np.sin(angle), np.cos(angle)], axis=-1).reshape(*doy.shape, shape.width)
    z = net.linear(np.maximum(net.linear(bands, "embedding.0"), 0), "embedding.2") + day
    for k in range(shape.layers):
        at = f"transformer_encoder.layers.{k}"
        z = net.norm(z + net.attention(z, f"{at}.self_attn", shape.heads), f"{at}.norm1")
        z = net.norm(z + net.linear(np.maximum(net.linear(z, f"{at}.linear1"), 0), f"{at}.linear2"), f"{at}.norm2")
    scores = net.linear(net.recurrent(z, "attn_pool.temporal_context"), "attn_pool.query")[..., 0]
    return (softmax(scores)[..., None] * z).sum(axis=1)


def two_sensor_scorer(s2: EncoderShape, s1: EncoderShape, w2: dict[str, np.ndarray], w1: dict[str, np.ndarray], reduce: np.ndarray, bias: np.ndarray | None = None, fusion: str = "concat") -> Callable[..., np.ndarray]:
    """Encodes both sensors, fuses them (concat or sum) and reduces linearly."""
    if fusion not in ("concat", "sum"):
        raise ValueError(f"unknown fusion method {fusion!r}")

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = encode(a, w2, s2), encode(b, w1, s1)
        out = (np.concatenate([x, y], axis=1) if fusion == "concat" else x + y) @ reduce.T
        return out if bias is None else out + bias

    return run


# Names that a saved model of this kind has (fixed values).
PARTS = ("s2_backbone.", "s1_backbone.")
REDUCER = "dim_reducer.0."
TRAINING_ONLY = "projector."
WRAPPED = "_orig_mod."


def model_arrays(w2: Mapping[str, np.ndarray], w1: Mapping[str, np.ndarray], reduce: np.ndarray, bias: np.ndarray) -> dict[str, np.ndarray]:
    """All weights of a model under the names that it is saved with."""
    return {**{PARTS[0] + k: v for k, v in w2.items()}, **{PARTS[1] + k: v for k, v in w1.items()}, REDUCER + "weight": reduce, REDUCER + "bias": bias}


def save_arrays(path: str, arrays: Mapping[str, np.ndarray]) -> None:
    """Named arrays as an .npz file in a local or shared folder."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    store, at = opened(path)
    with store.open_output_stream(at) as f:
        f.write(held.getvalue())


def load_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of an .npz file. Names lose the prefix that a compiled model is saved with."""
    store, at = opened(path)
    with store.open_input_file(at) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
        return {k.removeprefix(WRAPPED): z[k] for k in z.files}


def checked_model(arrays: Mapping[str, np.ndarray], s2: EncoderShape, s1: EncoderShape, out: int, fusion: str = "concat") -> Callable[..., np.ndarray]:
    """A scorer of loaded weights. Every weight of the given shapes must be there, in its shape, and no other; those of the
    head that only training uses are passed over."""
    wide = s2.width + s1.width if fusion == "concat" else s2.width
    need = {k: v.shape for k, v in model_arrays(random_weights(s2, 0), random_weights(s1, 0), np.empty((out, wide)), np.empty(out)).items()}
    have = {k: v.shape for k, v in arrays.items() if not k.startswith(TRAINING_ONLY)}
    faults = [f"missing {k}" for k in need if k not in have] + [f"unexpected {k}" for k in have if k not in need]
    faults += [f"{k} is {have[k]}, not {need[k]}" for k in need if k in have and have[k] != need[k]]
    if faults:
        raise ValueError("; ".join(faults))
    w2, w1 = ({k.removeprefix(part): v for k, v in arrays.items() if k.startswith(part)} for part in PARTS)
    return two_sensor_scorer(s2, s1, w2, w1, arrays[REDUCER + "weight"], arrays[REDUCER + "bias"], fusion)
