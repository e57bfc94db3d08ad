"""Whitening of embedding vectors: components of their covariance, and each vector's coordinates in units of deviation.

Entries become whole numbers, so sums and products over all vectors are exact whatever order tasks come in: products
are taken around the rounded mean, in pieces small enough for floating point to be exact, and the covariance is
rounded once, at its end. Tasks send a matrix of the vectors' width; the driver holds that matrix, takes it apart by
spectral divide and conquer, and broadcasts the components: all of it is bounded by the width, not by the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.qdwh import eigenvectors
from oddsloom.llm.tables import in_batches, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Components with a smaller share of all variance are numerical noise and left out.
NOISE = 1e-11
LIMB = 20


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, vec`` of the vectors whose entries are all there, finite, and not beyond what a long holds when scaled."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**62 / SCALE)
    return vectors.filter(F.col(vec_col).isNotNull() & F.forall(vec_col, good)).select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))


def _whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, a row each."""
    flat = batch.column(batch.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64).reshape(-1, width) + SHIFT


def _wide(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, exact, as Python's: products of limbs in pieces whose sums floating point holds."""
    limbs = []
    while y.any():
        low = ((y + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        limbs.append(low)
        y = (y - low) >> LIMB
    width = y.shape[1]
    total = np.zeros((width, width), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            most = max(1, int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)))
            rows = max(1, (1 << 53) // most)
            for k in range(0, len(y), rows):
                part = a[k : k + rows].T.astype(np.float64) @ b[k : k + rows].astype(np.float64)
                total += part.astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _sums(rows: DataFrame, width: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            total += _whole(batch, width).astype(object).sum(axis=0) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), _wide(total.tolist())], ["i", "s"])

    found = {r.i: int(r.s) for r in in_batches(rows.select("vec"), run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return [found[i] for i in range(width)]


def _covariance(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            total += gram(_whole(batch, width) - middle)
        for k in range(0, len(i), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(i[part]), pa.array(j[part]), _wide(total[i[part], j[part]].tolist())], ["i", "j", "s"])

    sent = in_batches(rows.select("vec"), run, "i long, j long, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    v = np.zeros((width, width))
    for r in sent.collect():
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)
    return v


def _identity_error(whitened: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1))), pa.array(total.ravel())], ["i", "s"])

    sent = in_batches(whitened.select("whitened"), run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    total = np.zeros(k * (k + 1))
    for r in sent.collect():
        total[r.i] = r.s / n
    total = total.reshape(k, k + 1)
    # The vectors are centred already; what their mean differs from 0 is rounding.
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of all vectors that are valid.

    Vectors of another length than most have (of equally many, the longest) are left out like those with null or
    non-finite entries, or with entries too large to be whole numbers. Components without variance are not returned,
    so one vector alone, or equal ones, and an empty table give no rows. Repeated rows count and are returned each;
    null identifiers stay. ``deviation`` is null where a long does not hold it. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, kind = valid(vectors, id_col, vec_col), vectors.schema[id_col].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.filter(F.size("vec") > 0).groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], shape)
    width, n = most.width, most.n
    rows = rows.filter(F.size("vec") == width)
    sums = _sums(rows, width)
    v = _covariance(rows, width, n, sums)
    values, vecs = eigenvectors(v, min(components, width))
    values, vecs = values[values > NOISE * np.trace(v)], vecs[values > NOISE * np.trace(v)]
    if not len(values):
        return spark.createDataFrame([], shape)
    model = spark.sparkContext.broadcast((n, sums, vecs.T / np.sqrt(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn = model.value
        for batch in batches:
            x = _whole(batch, width)
            most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums))
            if most >= 1 << 62:
                centred = x.astype(object) * n - np.array(sums, object)
            else:
                centred = x * n - np.array(sums, np.int64)
            largest = int(np.abs(centred).max(initial=0))
            square = (centred.astype(object) if largest**2 * width >= 1 << 63 else centred) ** 2
            deviation = [d if d < 1 << 63 else None for d in square.sum(axis=1).tolist()]
            w = (centred / n).astype(np.float64) @ turn
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), flat], ["vec_id", "deviation", "whitened"])

    out = written(in_batches(rows, run, f"vec_id {kind}, deviation long, whitened array<double>"), "whitened")
    error = _identity_error(out, len(values), n)
    shares = F.array(*(F.lit(float(e / np.trace(v))) for e in values))
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
