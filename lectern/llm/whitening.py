"""Whitening of embeddings by the leading eigenvectors of their covariance, found by LOBPCG over distributed block products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_pass, staged

#: Components at most, and further columns of the iterate that speed the last of them up.
COMPONENTS, GUARD = 16, 4
#: Vectors become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers farther from OFFSET than this are set to it: doubles would not hold them.
REACH = 1 << 52
#: Residuals, as shares of the largest eigenvalue: aimed at, and accepted once they no longer fall.
AIM, ACCEPT = 1e-14, 1e-11
ROUNDS = 300
#: Components whose eigenvalue is a smaller share of the trace hold rounding only, and are left out.
LEAST = 1e-13
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is not null, not empty and holds finite numbers only."""
    x = F.expr(f"transform(embedding, c -> cast(floor(greatest(least({SCALE} * cast(c as double), {REACH}D), -{REACH}D)) as long) + {OFFSET}L)")
    fine = F.expr("size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(cast(c as double)) and abs(cast(c as double)) < double('infinity'))")
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def gathered(df: DataFrame, part, shape: tuple[int, int], kind: str = "double") -> np.ndarray:
    """The sum over all rows of part(x), a small matrix: summed by batch and task in numpy, over tasks by Spark; the driver gets the sum."""

    def run(batches):
        total = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                here = part(rows_of(batch.slice(begin, 4096)))
                total = here if total is None else total + here
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for row in arrow_pass(df.select("x"), run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = row["v"]
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from differences to a whole number near it, so that nothing is lost to the offset."""
    near = sums // n
    return (x - near).astype(np.float64) - (sums - near * n) / n


def orthonormal(parts: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the parts' columns, each part after those before it; columns that add nothing go."""
    q = np.zeros((len(parts[0]), 0))
    for part in parts:
        scale = np.linalg.norm(part, axis=0)
        part = part[:, scale > 0] / scale[scale > 0]
        for column in part.T:
            left = column - q @ (q.T @ column)
            left -= q @ (q.T @ left)
            if (size := np.linalg.norm(left)) > 1e-9 and q.shape[1] < len(q):
                q = np.column_stack([q, left / size])
    return q


def lobpcg(product, dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors, residual): the `wanted` largest of the symmetric matrix that product() multiplies with.

    Each round takes one distributed product of the basis of iterate, residual and previous direction; Rayleigh-Ritz on it gives
    the next iterate. It ends when residuals reach AIM or have not fallen for three rounds, and fails above ACCEPT.
    """
    block = min(dims, wanted + GUARD)
    x = orthonormal([np.random.default_rng(13).standard_normal((dims, block))])
    residual, before = np.zeros((dims, 0)), np.zeros((dims, 0))
    best, stale = (np.inf, None, None), 0
    for _ in range(ROUNDS):
        basis = orthonormal([x, residual, before])
        image = product(basis)
        small = basis.T @ image
        values, mixed = np.linalg.eigh((small + small.T) / 2)
        values, mixed = values[::-1][:block], mixed[:, ::-1][:, :block]
        fresh = basis @ mixed
        before = fresh - x @ (x.T @ fresh)
        x, residual = fresh, image @ mixed - fresh * values
        size = float(np.linalg.norm(residual[:, :wanted], axis=0).max()) / max(values[0], 1e-300)
        if size < best[0] / 2:
            stale = 0
        else:
            stale += 1
        if size < best[0]:
            best = (size, values[:wanted], x[:, :wanted])
        if size <= AIM or stale >= 3 and best[0] <= ACCEPT:
            break
    if best[0] > ACCEPT:
        raise RuntimeError(f"eigenvectors are not certain: residual {best[0]:.3g} of the largest eigenvalue")
    return best[1], best[2], best[0]


def _squares(d: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum of (n * d - rest)^2 by row, exact; null where a long can't hold it."""
    reach = int(np.abs(d).max(initial=0)) * n + int(np.abs(rest).max(initial=0))
    if d.shape[1] * reach * reach < 1 << 63:
        return ((n * d - rest) ** 2).sum(1).tolist()
    exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame) -> DataFrame:
    """For each row with a whole vector and each of up to COMPONENTS components: the row's whitened coordinate.

    Columns are vec_id, component, n, deviation, whitened, explained, identity_error. Rows whose vector is null, empty, or
    holds null or non-finite entries are dropped, and so are those whose length is not the most frequent one (of equals the longest).
    The covariance is that of each distinct vector once; repeated rows and null vec_ids each get their own result rows.
    Tied eigenvalues span a space that any basis of it may stand for: one is chosen, the same for all rows. Components
    without variance are left out, so equal vectors only, a single vector or an empty table give no rows. deviation is
    null beyond the range of long. Other columns, whatever their names, are not read.
    """
    spark = embeddings.sparkSession
    rows = staged(whole(embeddings), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dims = lengths["d"]
    rows = rows.where(F.size("x") == dims)
    fit = staged(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = gathered(fit, lambda x: x.sum(0, keepdims=True), (1, dims), "long")[0]

    def product(basis: np.ndarray) -> np.ndarray:
        def part(x):
            c = centred(x, n, sums)
            return c.T @ (c @ basis)

        return gathered(fit, part, basis.shape) / n

    trace = float(gathered(fit, lambda x: np.array([[np.square(centred(x, n, sums)).sum()]]), (1, 1))[0, 0]) / n
    if not trace > 0:
        return spark.createDataFrame([], RESULT)
    values, vectors, _ = lobpcg(product, dims, min(COMPONENTS, dims))
    keep = values > LEAST * trace
    values, vectors = values[keep], vectors[:, keep]
    m = len(values)
    mapping = vectors / np.sqrt(values)

    def second(x):
        w = np.column_stack([np.ones(len(x)), centred(x, n, sums) @ mapping])
        return w.T @ w

    moments = gathered(fit, second, (m + 1, m + 1)) / n
    error = float(np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(m)).max())
    explained = values / trace
    near = sums // n
    rest = sums - near * n

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x = rows_of(part)
                coords, k = centred(x, n, sums) @ mapping, len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(k), m))),
                        pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()),
                        pa.array(np.full(k * m, n)),
                        pa.array(_squares(x - near, n, rest), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                        pa.array(coords.ravel()),
                        pa.array(np.tile(explained, k)),
                        pa.array(np.full(k * m, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return arrow_pass(rows, run, RESULT)
