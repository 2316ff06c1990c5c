"""Whitening of embeddings from an exact integer scatter.

An entry c becomes the integer x = floor(64 c) + ``SHIFT``.  Over the distinct integer
vectors ("fit list") every task subtracts the shift again and accumulates its sums S and
cross-products XᵀX exactly: integers are cut into limbs of 20 bits, whose products a
float matrix product adds up without rounding (2^40 for a product, 2^13 rows at a time),
and are put together as integers of any size.  Totals leave a task as limbs of 30 bits,
which Spark sums as longs.  The driver gets one row for each pair of dimensions, forms
n XᵀX - S Sᵀ in integers, and only then divides and decomposes by ``eigh``.

The largest deviation of the whitened fit list's covariance from the identity is measured
by a second pass over the fit list, on vectors whose mean was subtracted in integers.

Defined results: rows whose vector is null, or has an entry that is null, not finite or
beyond a long as x, are left out, as are those of another length than the commonest one
of the fit list (of equally common ones the longest).  Repeated rows count once in the fit
list and are all whitened; null ids stay.  An empty table, or one without valid rows, gives
no rows.  Components whose eigenvalue is zero to double precision can't be whitened and are
not returned.  A deviation beyond a long is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from .shared_windows import remove, work_dir
from .textbatch import buffers, frugal, pick, small_batches

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Bits of a limb in products, and rows that are multiplied together: 2 * 20 + 13 = 53.
LIMB, ROWS = 20, 1 << 13
#: Bits and number of the limbs that Spark sums.
SENT, N_SENT = 30, 6


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of ``size`` entries with sums ``sums`` of x; unit eigenvectors (rows of
    ``components``) and eigenvalues of x's covariance, falling; each one's share of its trace."""

    n: int
    size: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are valid, their lengths, and x - SHIFT of their entries in a row."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        floor = np.floor(entries * float(SCALE))
        good = (floor >= -(2.0**63)) & (floor < 2.0**63 - 2.0**21)  # a NaN is neither
    wrong = np.append(0, np.cumsum(~good))
    ends = np.cumsum(length)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - length])
    return valid, length[valid], floor[np.repeat(valid, length)].astype(np.int64)


def packed(length: np.ndarray, entries: np.ndarray) -> list[bytes]:
    """Each vector as a byte that tells the width of its entries, the least that holds them
    all, and the entries: equal vectors have equal bytes."""
    out: list[bytes] = [b""] * len(length)
    ends = np.cumsum(length)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        table = entries[(ends[rows] - size)[:, None] + np.arange(size)]
        low, high = table.min(axis=1, initial=0), table.max(axis=1, initial=0)
        fits = [(low >= -(1 << b - 1)) & (high < 1 << b - 1) for b in (16, 32)]
        width = np.where(fits[0], 2, np.where(fits[1], 4, 8))
        for w in (2, 4, 8):
            own = np.flatnonzero(width == w)
            data = table[own].astype(f"<i{w}").tobytes()
            for k, i in enumerate(rows[own].tolist()):
                out[i] = bytes([w]) + data[k * size * w : (k + 1) * size * w]
    return out


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of ``size`` entries that ``packed`` made, as rows of a table."""
    raw, offs = buffers(column)
    width = raw[offs[:-1]] if len(column) else np.zeros(0, np.uint8)
    table = np.zeros((len(column), size), np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        data = raw[offs[rows][:, None] + 1 + np.arange(size * w)]
        table[rows] = np.ascontiguousarray(data).view(f"<i{w}").reshape(len(rows), size)
    return table


def _encoded(df: DataFrame) -> DataFrame:
    """(vec_id, size, x) of the valid rows; x is packed."""
    source = pick(df, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    schema = StructType([source.schema["vec_id"], StructField("size", LongType()), StructField("x", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, length, entries = integers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(valid)), pa.array(length), pa.array(packed(length, entries), pa.binary())], names=["vec_id", "size", "x"])

    small_batches(df.sparkSession)
    return source.mapInArrow(frugal(run), schema)


def _limbs(table: np.ndarray) -> list[np.ndarray]:
    """Limbs whose sum, the k-th one shifted by k times ``LIMB`` bits, is the table; all but
    the last are not negative."""
    out, rest = [], table
    while len(rest) and (int(rest.max(initial=0)) >= 1 << LIMB or int(rest.min(initial=0)) < -(1 << LIMB)):
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def products(table: np.ndarray) -> np.ndarray:
    """XᵀX as integers of any size."""
    total = np.zeros((table.shape[1],) * 2, object)
    for a in range(0, len(table), ROWS):
        limbs = _limbs(table[a : a + ROWS])
        for i, x in enumerate(limbs):
            for j, y in enumerate(limbs):
                total += (x.T @ y).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _sums(table: np.ndarray) -> np.ndarray:
    total = np.zeros(table.shape[1], object)
    for a in range(0, len(table), ROWS):
        for i, x in enumerate(_limbs(table[a : a + ROWS])):
            total += x.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
    return total


def _scatter(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and XᵀX (of x - SHIFT) over the fit list."""
    upper = np.triu_indices(size)
    ends = [f"l{k}" for k in range(N_SENT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            table = unpacked(batch.column(0), size)
            n, sums, cross = n + len(table), sums + _sums(table), cross + products(table)
        if n:
            values = [n, *sums.tolist(), *cross[upper].tolist()]
            at = [[-1, *range(size), *upper[0].tolist()], [-1] * (1 + size) + upper[1].tolist()]
            cut = [[(v >> (SENT * k)) & ((1 << SENT) - 1) for v in values] for k in range(N_SENT - 1)]
            columns = [*at, *cut, [v >> (SENT * (N_SENT - 1)) for v in values]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", *ends])

    partial = fit.select("x").mapInArrow(frugal(run), ", ".join(f"{c} long" for c in ("i", "j", *ends)))
    rows = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ends]).collect()
    value = {(r["i"], r["j"]): sum(r[c] << (SENT * k) for k, c in enumerate(ends)) for r in rows}
    return value[-1, -1], [value[i, -1] for i in range(size)], [[value[min(i, j), max(i, j)] for j in range(size)] for i in range(size)]


def centred(table: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, which a shift of x leaves as it is, exactly: as longs where they suffice."""
    most = max(abs(int(table.max(initial=0))), abs(int(table.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return table * n - np.array(sums, np.int64)
    return table.astype(object) * n - np.array(sums, object)


def _squares(whole: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exactly; null beyond a long."""
    most = max((abs(int(v)) for v in (whole.max(initial=0), whole.min(initial=0))), default=0) if whole.size else 0
    if whole.shape[1] * most * most < 1 << 63:
        return pa.array((whole * whole).sum(axis=1).astype(np.int64))
    total = [sum(v * v for v in row) for row in whole.astype(object).tolist()]
    return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def _identity_error(fit: DataFrame, model: Whitening, shifted: list[int]) -> float:
    k, n, project = len(model.eigenvalues), model.n, model.components.T / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (centred(unpacked(batch.column(0), model.size), n, shifted).astype(np.float64) / n) @ project
            values = np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    rows = fit.select("x").mapInArrow(frugal(run), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    total = np.array([r["v"] for r in rows]) / n
    mean, cross = total[:k], total[k:].reshape(k, k)
    return float(np.abs(cross - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(df: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table (vec_id, embedding) by its fit list.  The fit list is written
    to the shared folder and deleted again."""
    spark = df.sparkSession
    root = work_dir(spark)
    _encoded(df).select("size", "x").distinct().write.parquet(f"{root}/fit")
    fit = spark.read.parquet(f"{root}/fit")
    common = fit.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None or common["size"] == 0:
        remove(spark, root)
        return Whitening(common["n"] if common else 0, 0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    size = common["size"]
    fit = fit.where(F.col("size") == size)
    n, sums, cross = _scatter(fit, size)
    scatter = [[n * cross[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    # a quotient of integers is rounded once, however large they are
    covariance = np.array([[v / (n * n) for v in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(scatter[i][i] for i in range(size)) / (n * n)
    order = order[values[order] > trace * size * np.finfo(float).eps]
    vectors = vectors[:, order].T
    # one sign for every fit: a component's largest entry is positive
    vectors = vectors * np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(axis=1)])[:, None]
    model = Whitening(n, size, tuple(s + n * SHIFT for s in sums), vectors, values[order], values[order] / trace if trace else values[order], 0.0)
    error = _identity_error(fit, model, sums) if len(order) else 0.0
    remove(spark, root)
    return Whitening(**{**model.__dict__, "identity_error": error})


def whiten(df: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) for every valid row: the exact sum over dimensions of
    (n x - S)^2, and x - S / n on each component over the root of its eigenvalue."""
    n, size = model.n, model.size
    shifted = [s - n * SHIFT for s in model.sums]
    project = model.components.T / np.sqrt(model.eigenvalues) if len(model.eigenvalues) else np.zeros((size, 0))
    encoded = _encoded(df).where(F.col("size") == size)
    schema = StructType([encoded.schema["vec_id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = centred(unpacked(batch.column(2), size), n, shifted)
            z = (whole.astype(np.float64) / max(n, 1)) @ project
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _squares(whole), listed], names=["vec_id", "deviation", "whitened"])

    return encoded.mapInArrow(frugal(run), schema)


def whitened_rows(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error."""
    model = fit_whitening(df, components)
    share = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    rows = whiten(df, model).select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", share.alias("explained"))).alias("i", "v"))
    return rows.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
