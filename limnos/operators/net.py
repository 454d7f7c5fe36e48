"""The class-weighted softmax net (M6): dense ReLU layers, trained by
data-parallel gradient descent.

Rows stay where they are, packed once into blocks of ``BLOCK`` (one binary a
column) that are kept for all steps.  Each step broadcasts the parameters (their
number is fixed by the layers), every partition adds up the gradient of its
training rows and the loss of its validation rows in one pass over its blocks,
``STEP`` rows at a time so that what is between two layers stays in the
processor's cache, Spark sums the partials, and the driver makes one Adam step.  The gradient is that of all rows, so the fit
does not depend on how they are partitioned.  Kernels of hidden layers carry an
L2 penalty, classes their weights; on the validation loss the rate is cut, and
training stops and goes back to its best parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 20_000  # a task of a step has this many rows at least (as far as there are rows)
BLOCK = 2048        # rows of a packed block, at most
STEP = 1024         # rows whose gradient is taken at once
FOLD = 64           # partials are summed in Spark down to this many before the driver adds them


@dataclass(frozen=True)
class NetConfig:
    """Hidden layers and training settings; patience counts steps without a
    lower validation loss."""

    hidden: tuple[int, ...] = (64, 32, 16)
    classes: int = 4
    l2: float = 1e-4
    rate: float = 0.01
    min_rate: float = 1e-4
    cut: float = 0.2
    cut_patience: int = 15
    stop_patience: int = 30
    epochs: int = 200
    seed: int = 42


@dataclass
class Fitted:
    """Layer sizes, best parameters and the loss curve of a training."""

    sizes: list[int]
    parameters: np.ndarray
    history: list[tuple[int, float, float, float, float]] = field(default_factory=list)

    def history_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double, val_accuracy double, rate double")


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kernel and bias of each layer, as views of the flat parameters."""
    out, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:]):
        out.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def initial(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Seeded uniform kernels (limit sqrt(6 / (in + out))), zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for n, m in zip(sizes[:-1], sizes[1:]):
        limit = np.sqrt(6 / (n + m))
        parts += [rng.uniform(-limit, limit, n * m), np.zeros(m)]
    return np.concatenate(parts)


def _activations(layers, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of each layer and the class probabilities, a column a row of data."""
    inputs = [x]
    for kernel, bias in layers[:-1]:
        z = kernel.T @ inputs[-1]
        z += bias[:, None]
        inputs.append(np.maximum(z, 0.0, out=z))
    z = layers[-1][0].T @ inputs[-1]
    z += layers[-1][1][:, None]
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return inputs, z


def forward(layers, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of each layer, and the class probabilities."""
    inputs, p = _activations(layers, x.T)
    return [i.T for i in inputs], p.T


def gradient(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over rows of the weighted cross entropy, and its gradient."""
    layers = unpack(flat, sizes)
    inputs, d = _activations(layers, x.T)
    at = np.arange(len(y))
    loss = float(-(w * np.log(np.maximum(d[y, at], 1e-300))).sum())
    out = np.zeros_like(flat)
    grads = unpack(out, sizes)
    d[y, at] -= 1
    d *= w
    for i in range(len(layers) - 1, -1, -1):
        grads[i][0][:] = inputs[i] @ d.T
        grads[i][1][:] = d.sum(axis=1)
        if i:
            d = layers[i][0] @ d
            d *= inputs[i] > 0
    return loss, out


def penalty(flat: np.ndarray, sizes: Sequence[int], l2: float) -> tuple[float, np.ndarray]:
    """L2 penalty of the hidden kernels, and its gradient."""
    out = np.zeros_like(flat)
    total = 0.0
    for (kernel, _), (g, _) in list(zip(unpack(flat, sizes), unpack(out, sizes)))[:-1]:
        total += l2 * float((kernel ** 2).sum())
        g[:] = 2 * l2 * kernel
    return total, out


PACKED = "val boolean, n long, low int, high int, x binary, y binary, w binary"


def _pack(n_inputs: int):
    """Rows to blocks of training or validation rows, ``x`` by input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_inputs)
                y, w, val = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "val"))
                rows = []
                for held, mine in ((False, ~val), (True, val)):
                    if mine.any():
                        own = y[mine]
                        rows.append((held, len(own), int(own.min()), int(own.max()), np.ascontiguousarray(x[mine].T, dtype=np.float64).tobytes(),
                                     own.astype(np.int32).tobytes(), w[mine].astype(np.float64).tobytes()))
                kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["val", "n", "low", "high", "x", "y", "w"])
    return run


def _partials(held, sizes: list[int]):
    """One row a partition: gradient, training loss and rows, validation loss,
    rows and right ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = held.value
        layers = unpack(flat, sizes)
        total = np.zeros(len(flat) + 5)
        for b in batches:
            for val, x, y, w in zip(*(b.column(c) for c in ("val", "x", "y", "w"))):
                y, w = np.frombuffer(y.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float64)
                x = np.frombuffer(x.as_buffer(), np.float64).reshape(sizes[0], len(y))
                for i in range(0, len(y), STEP):
                    part, own = x[:, i:i + STEP], y[i:i + STEP]
                    if val.as_py():
                        p = _activations(layers, part)[1]
                        right = np.maximum(p[own, np.arange(len(own))], 1e-300)
                        total[len(flat) + 2:] += [-np.log(right).sum(), len(own), (p.argmax(axis=0) == own).sum()]
                    else:
                        loss, grad = gradient(flat, sizes, part.T, own, w[i:i + STEP])
                        total[:len(flat)] += grad
                        total[len(flat):len(flat) + 2] += [loss, len(own)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for part in b.column("part").to_pylist():
            v = np.frombuffer(part)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _pass(rows: DataFrame, parts: int, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    held = rows.sparkSession.sparkContext.broadcast(flat)
    partials = rows.mapInArrow(_partials(held, sizes), "part binary")
    if parts > FOLD:
        partials = partials.repartition(FOLD, F.xxhash64("part")).mapInArrow(_add, "part binary")
    got = sum(np.frombuffer(r["part"]) for r in partials.collect())    # FOLD rows at most
    held.destroy()
    return got


def train_net(rows: DataFrame, x: str, label: str, weight: str, validation: str, n_inputs: int,
              config: NetConfig = NetConfig()) -> Fitted:
    """Fit on the rows whose ``validation`` is false, stop on those where it is
    true (without any, the training loss decides).  ``x`` is a vector or array
    column of ``n_inputs`` numbers, ``label`` a class from 0 on, ``weight`` a
    row's weight in the loss.  Rows with a NULL label or weight are left out."""
    kind = rows.schema[x].dataType.typeName()
    xs = F.col(x) if kind == "array" else vector_to_array(x)
    data = (rows.where(F.col(label).isNotNull() & F.col(weight).isNotNull())
            .select(xs.alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"),
                    F.col(validation).alias("val"))
            .mapInArrow(_pack(n_inputs), PACKED).persist(StorageLevel.MEMORY_AND_DISK))
    sizes = [n_inputs, *config.hidden, config.classes]
    flat = initial(sizes, config.seed)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    rate, best, since_best, since_cut = config.rate, (np.inf, flat), 0, 0
    fitted = Fitted(sizes, flat)
    try:
        low, high, parts, n_rows = (
            data.groupBy(F.spark_partition_id().alias("p")).agg(F.min("low").alias("a"), F.max("high").alias("b"), F.sum("n").alias("n"))
            .agg(F.min("a"), F.max("b"), F.count("p"), F.sum("n")).collect()[0])
        if low is None:
            raise ValueError("no labelled rows to train on")
        if low < 0 or high >= config.classes:
            raise ValueError(f"labels {low} to {high} do not fit {config.classes} classes")
        parts = max(1, min(parts, -(-n_rows // TASK_ROWS)))
        dealt = data.coalesce(parts)
        for epoch in range(config.epochs + 1):
            got = _pass(dealt, parts, flat, sizes)
            grad, (loss, n, val_loss, n_val, right) = got[:-5], got[-5:]
            if not n:
                raise ValueError("no training rows")
            extra, extra_grad = penalty(flat, sizes, config.l2)
            train_loss = loss / n + extra
            watched = val_loss / n_val + extra if n_val else train_loss
            fitted.history.append((epoch, float(train_loss), float(watched), float(right / n_val) if n_val else None, rate))
            if watched < best[0] - 1e-12:
                best, since_best, since_cut = (watched, flat), 0, 0
            else:
                since_best, since_cut = since_best + 1, since_cut + 1
            if since_best >= config.stop_patience or epoch == config.epochs:
                break
            if since_cut >= config.cut_patience:
                rate, since_cut = max(config.min_rate, rate * config.cut), 0
            g = grad / n + extra_grad
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            step = mean / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(square / (1 - 0.999 ** (epoch + 1))) + 1e-7)
            flat = flat - rate * step
    finally:
        data.unpersist()
    fitted.parameters = best[1]
    return fitted


class NetModel(Transformer, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted net as a pipeline stage: class probabilities (array of doubles)
    of a vector column, in Arrow batches."""

    layers = Param(Params._dummy(), "layers", "sizes of the layers, input first", TypeConverters.toListInt)
    parameters = Param(Params._dummy(), "parameters", "kernels and biases, layer by layer", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str | None = None, probabilityCol: str | None = None,
                 layers: Sequence[int] | None = None, parameters: Sequence[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes = self.getOrDefault(self.layers)
        held = dataset.sparkSession.sparkContext.broadcast(np.array(self.getOrDefault(self.parameters)))

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, sizes[0]))
            return pd.Series(list(forward(unpack(held.value, sizes), rows)[1]))

        return dataset.withColumn(self.getProbabilityCol(), probabilities(vector_to_array(self.getFeaturesCol())))
