"""Linear classifiers and label models fitted to all labelled rows, however many there are.

Rows stay in a stored table; a step is one pass over it that adds vectors up where the rows lie, and the sums, whose length is
bounded by the features and the kinds, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical
from .store import discard, durable

#: Rows that a pass looks at together, and vectors that are added in one place.
ROWS, MOST = 2_048, 64
#: Passes of a regression, past steps that it keeps, and the share of the loss by which a pass must lower it.
PASSES, MEMORY, LEAST_GAIN = 40, 8, 1e-5


def sliced(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _added(vectors) -> np.ndarray:
    return np.sum([np.asarray(v.values) for v in vectors], axis=0)


def _add(batches):
    """One vector for all of a task's."""
    vectors = [v for batch in batches for v in batch.column(0)]
    if vectors:
        yield pa.RecordBatch.from_arrays([pa.array([_added(vectors)], pa.list_(pa.float64()))], names=["sums"])


def summed(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over all batches of the vectors that `sums` makes of them; a task hands on one vector, and the driver gets some MOST at once."""

    def run(batches):
        total = np.zeros(width)
        for batch in sliced(batches):
            total += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    found, tasks = rows.mapInArrow(run, "sums array<double>"), rows.rdd.getNumPartitions()
    while tasks > MOST:
        tasks = -(-tasks // MOST)
        found = found.repartition(tasks).mapInArrow(_add, "sums array<double>")
    return _added(found.toArrow().column(0)) if tasks else np.zeros(width)


def listed_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, listed column) pairs of a batch's lists."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy()


def matrix(labelled: DataFrame, listed: lexical.Listed, shape: bool = False) -> DataFrame:
    """(kind, columns) of all rows, stored."""
    shared = labelled.sparkSession.sparkContext.broadcast(listed)
    return durable(labelled.select("text", "kind").mapInArrow(lexical._present(shared, shape), "kind int, columns array<int>"), "matrix")


def _pass(w: np.ndarray, b: np.ndarray, targets):
    """Loss and its slopes, not yet divided by the rows, over a batch."""
    width, kinds = w.shape

    def sums(batch):
        row, column = listed_columns(batch.column("columns"))
        target, n = targets(batch), batch.num_rows
        z = np.stack([np.bincount(row, w[column, k], n) for k in range(kinds)], 1) + b
        z -= z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        error = np.exp(log_p) - target
        slope = np.stack([np.bincount(column, error[row, k], width) for k in range(kinds)], 1)
        return np.concatenate([slope.ravel(), error.sum(0), [-(target * log_p).sum()]])

    return sums


def softmax_regression(rows: DataFrame, targets: Callable[[pa.RecordBatch], np.ndarray], width: int, kinds: int, l2: float = 1e-3, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, kinds) and biases for the soft `targets` of all rows (columns array<int>, ...), by L-BFGS.

    The same loss as `lexical.softmax_regression` has. Columns are scaled by their frequency; a pass that does not lower the
    loss enough is tried again with a tenth of its step.
    """

    def first(batch):
        _, column = listed_columns(batch.column("columns"))
        return np.concatenate([np.bincount(column, minlength=width), targets(batch).sum(0), [batch.num_rows]])

    known = summed(rows, first, width + kinds + 1)
    n = max(known[-1], 1)
    scale = np.append(np.repeat(1 / np.sqrt(known[:width] / n + l2), kinds), np.ones(kinds))

    def at(u):
        w, b = np.split(u * scale, [width * kinds])
        s = summed(rows, _pass(w.reshape(width, kinds), b, targets), (width + 1) * kinds + 1)
        slope = s[:-1] / n
        slope[: width * kinds] += l2 * w
        return s[-1] / n + l2 / 2 * (w @ w), slope * scale

    u = np.append(np.zeros(width * kinds), np.log(np.maximum(known[width:-1] / n, 1e-6)))
    loss, slope = at(u)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    size = 1.0
    for _ in range(passes):
        way, kept = -slope, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ way))
            way = way - kept[-1] * y
        if past:
            s, y, r = past[-1]
            way = way / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept)):
            way = way + s * (a - r * (y @ way))
        new_u = u + size * way
        new_loss, new_slope = at(new_u)
        if new_loss > loss + 1e-4 * size * (slope @ way):
            size *= 0.1
            if size < 1e-3:
                break
            continue
        s, y = new_u - u, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-MEMORY:]
        gain, u, loss, slope, size = loss - new_loss, new_u, new_loss, new_slope, 1.0
        if gain <= LEAST_GAIN * max(loss, 1e-9):
            break
    w, b = np.split(u * scale, [width * kinds])
    return w.reshape(width, kinds), b


def one_hot(kinds: int):
    return lambda batch: np.eye(kinds)[batch.column("kind").to_numpy()]


def fit(labelled: DataFrame, listed: lexical.Listed, kinds: int, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A classifier of the rows (text, kind), all of them."""
    rows = matrix(labelled, listed, shape)
    try:
        return softmax_regression(rows, one_hot(kinds), len(listed.features), kinds)
    finally:
        discard(rows)
