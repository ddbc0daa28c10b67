"""Least squares for the quadratic surface, from mergeable triangular factors.

The design matrix of any set of rows is represented by the 7 x 7 triangular
factor of [basis | response]. Factors of parts stack and reduce to the factor
of the whole, so rows are reduced where they are read and only factors move.
Rank and condition are those of the design itself; normal equations would
square the condition number and could not apply the limit of 1e12.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS = 6
WIDTH = TERMS + 1
MAX_CONDITION = 1e12
FIT = "coefficients array<double>, rank int, condition_number double"


class FitError(ValueError):
    """The surface cannot be fitted to these rows."""


def design(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.column_stack([x, y, np.ones(len(x)), x * y, x * x, y * y])


def reduce_rows(block: np.ndarray) -> np.ndarray:
    """The triangular factor of a block of rows, padded to 7 x 7."""
    r = np.linalg.qr(block, mode="r") if len(block) else np.zeros((0, WIDTH))
    out = np.zeros((WIDTH, WIDTH))
    out[: len(r)] = r
    return out


def solve(factor: np.ndarray, n: int, max_condition: float = MAX_CONDITION, label: str = "fit") -> tuple[np.ndarray, int, float]:
    """Coefficients, rank and condition number; FitError when they do not hold."""
    if max_condition <= 1:
        raise ValueError("the largest condition number must exceed one")
    if n < TERMS:
        raise FitError(f"{label}: {n} rows for {TERMS} terms")
    a, b = factor[:, :TERMS], factor[:, TERMS]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    rank = int(np.sum(s > np.finfo(float).eps * max(n, TERMS) * s[0])) if s[0] > 0 else 0
    condition = float(s[0] / s[-1]) if s[-1] > 0 else float("inf")
    if rank < TERMS:
        raise FitError(f"{label}: rank {rank} of {TERMS}")
    if not condition <= max_condition:
        raise FitError(f"{label}: condition number {condition:.3g} above {max_condition:.3g}")
    return vt.T @ ((u.T @ b) / s), rank, condition


def factors(rows: DataFrame, keys: Sequence[str], x: str, y: str, response: str) -> DataFrame:
    """``keys, n, factor`` (49 doubles, by rows): one factor for each key.

    Every Arrow batch reduces its rows by key before the shuffle, so a key with
    a third of all rows sends one factor for each batch. Rows must be finite.
    """
    keys = list(keys)
    own = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(response).cast("double").alias("_z"))
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}{', ' if keys else ''}n long, factor array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch)
            xyz = [table.column(c).to_numpy() for c in ("_x", "_y", "_z")]
            block = np.column_stack([design(xyz[0], xyz[1]), xyz[2]])
            if keys:
                frame = table.select(keys).to_pandas()
                index = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            else:
                index = np.zeros(len(block), int)
            order = np.argsort(index, kind="stable")
            starts = np.flatnonzero(np.diff(index[order], prepend=-1))
            first = pa.array(order[starts])
            parts = np.split(block[order], starts[1:])
            cols = [table.column(k).combine_chunks().take(first) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(p) for p in parts], pa.int64()), pa.array([reduce_rows(p).ravel().tolist() for p in parts], pa.list_(pa.float64()))], [*keys, "n", "factor"])

    made = own.mapInArrow(partial, schema)

    def merge(key, table):
        stack = np.array(table.column("factor").to_pylist(), float).reshape(-1, WIDTH)
        out = reduce_rows(stack)
        return pa.table([*[table.column(k).combine_chunks().slice(0, 1) for k in keys], pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=[*keys, "n", "factor"])

    return made.groupBy(*keys).applyInArrow(merge, schema)


def fit_quadratic(rows: DataFrame, x: str, y: str, response: str, by: Sequence[str] = (), max_condition: float = MAX_CONDITION) -> DataFrame:
    """``by, n, coefficients, rank, condition_number`` for each key.

    Fewer than six rows, a rank below six or a condition number above the limit
    stops the job with a FitError that names the key.
    """
    by = list(by)
    f = factors(rows, by, x, y, response)
    kinds = ", ".join(f"`{k}` {f.schema[k].dataType.simpleString()}" for k in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                n = batch.column(len(by))[i].as_py()
                label = ", ".join(f"{k}={batch.column(j)[i].as_py()}" for j, k in enumerate(by)) or "fit"
                out.append(solve(np.array(batch.column(len(by) + 1)[i].as_py()).reshape(WIDTH, WIDTH), n, max_condition, label))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], pa.array([c.tolist() for c, _, _ in out], pa.list_(pa.float64())), pa.array([r for _, r, _ in out], pa.int32()), pa.array([c for _, _, c in out], pa.float64())], [*by, "n", "coefficients", "rank", "condition_number"])

    return f.mapInArrow(run, f"{kinds}{', ' if by else ''}n long, {FIT}")
