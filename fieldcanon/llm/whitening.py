"""Whitening of embeddings: their leading principal components, scaled to unit variance.

Entries become whole numbers first, so equal vectors are equal exactly. Sums and centred products
are added up by partition in numpy and then by Spark; the driver gets one row for each entry of the
covariance, whose size depends on the vectors' length alone, and finds the components there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, StructType

from .common import written
from .eigen import leading

#: Steps of the whole numbers in 1.
STEPS = 256
#: Most components of a row.
COMPONENTS = 4
#: Whole numbers stay below this, so that sums of a batch fit 64 bits.
BOUND = 2**40
#: Components whose eigenvalue is a smaller share of the first one's are rounding only.
RANK = 1e-10
#: Rows that are summed up before they are handed on.
FLUSH_ROWS = 2**20


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite (and below ``BOUND`` steps)."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < BOUND / STEPS)), F.lit(False))


def whole(vector: Column) -> Column:
    """The entries as whole numbers of steps, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS))


def _matrices(batch: pa.RecordBatch, column: str, size: int | None = None) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices, one for each length."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths) if size is None else [size]:
        if d:
            yield flat[(starts[lengths == d])[:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``size, at, total``: the sum of each entry by the vectors' length, and their number at -1."""
    totals: dict[tuple[int, int], int] = {}
    rows = 0

    def out() -> pa.RecordBatch:
        keys = list(totals)
        return pa.record_batch({"size": pa.array([k[0] for k in keys], pa.int32()), "at": pa.array([k[1] for k in keys], pa.int32()), "total": pa.array([totals[k] for k in keys], pa.int64())})

    for batch in batches:
        for x in _matrices(batch, "x"):
            d = x.shape[1]
            for at, total in zip(range(-1, d), [len(x), *x.sum(axis=0).tolist()]):
                totals[d, at] = totals.get((d, at), 0) + total
        rows += batch.num_rows
        if rows >= FLUSH_ROWS:
            yield out()
            totals, rows = {}, 0
    if totals:
        yield out()


@dataclass(frozen=True)
class Whitening:
    """The fitted components: number and sums of the distinct vectors, eigenvalues, unit vectors
    (columns), and the variance of all dimensions together."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """The exact sums over dimensions of ``(n * x - S)^2``."""
        far = self.n * (np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if int(far) ** 2 * len(self.sums) < 2**62:
            apart = x * self.n - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1)
        sums = np.array(self.sums, object)
        apart = x.astype(object) * self.n - sums
        return (apart * apart).sum(axis=1).tolist()


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct whole-number vector once, written, as it is read several times."""
    return written(vectors.select("x").distinct(), "fit")


def sums_of(fit: DataFrame) -> tuple[int, int, tuple[int, ...]]:
    """Length, number and exact sums of the fit list, for the length that most of its vectors have (of
    equally frequent ones the longest)."""
    parts = fit.mapInArrow(_sums, "size int, at int, total bigint")
    totals = written(parts.groupBy("size", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "sums")
    most = totals.where("at = -1").orderBy(F.desc("total"), F.desc("size")).first()
    if most is None:
        return 0, 0, ()
    found = {r["at"]: int(r["total"]) for r in totals.where(F.col("size") == most["size"]).collect()}
    return most["size"], found.pop(-1), tuple(found[i] for i in range(most["size"]))


def covariance(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The covariance of the fit list, centred before multiplying, divided by ``n``."""
    size, mean = len(sums), np.array([s / n for s in sums])
    upper = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            for x in _matrices(batch, "x", size):
                apart = x - mean
                total += apart.T @ apart
                seen = True
        if seen:
            yield pa.record_batch({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "v": pa.array(total[upper])})

    rows = fit.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[rows["i"], rows["j"]] = rows["v"] / n
    return np.triu(out) + np.triu(out, 1).T


def fit(fitted: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of a fit list, ``None`` if it is empty."""
    size, n, sums = sums_of(fitted)
    if not n:
        return None
    matrix = covariance(fitted, n, sums)
    values, vectors = leading(matrix, components)
    kept = values > max(values[0], 0) * RANK
    return Whitening(n, sums, values[kept], vectors[:, kept], float(np.trace(matrix)))


def projected(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Rows ``vec_id, component, deviation, whitened`` for the vectors ``vec_id, x`` of the model's length."""
    size, k = len(model.sums), len(model.values)
    wide = pa.decimal128(38, 0)
    schema = StructType([vectors.schema["vec_id"]]).add("component", IntegerType()).add("deviation", DecimalType(38, 0)).add("whitened", DoubleType())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for x in _matrices(batch, "x", size):
                apart = model.deviations(x)
                apart = pa.array(apart, pa.int64()).cast(wide) if isinstance(apart, np.ndarray) else pa.array(apart, wide)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.record_batch([ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), apart.take(each), pa.array(model.project(x).ravel())], names=schema.names)

    return vectors.where(F.size("x") == size).mapInArrow(rows, schema)


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest entry of the difference between the covariance of the whitened fit list and the
    identity, measured by Spark's own centred aggregates on the projected list."""
    k = len(model.values)
    if not k:
        return 0.0
    size = len(model.sums)
    names = [f"c{i}" for i in range(k)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _matrices(batch, "x", size):
                yield pa.record_batch(list(map(pa.array, model.project(x).T)), names=names)

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = fitted.mapInArrow(project, ", ".join(f"{c} double" for c in names)).agg(*(F.covar_pop(names[i], names[j]).alias(f"v{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"v{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Return ``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each
    remaining row of ``df`` and component, numbered from 1 by falling variance.

    Dropped are rows whose vector is null or empty, holds a null or an entry that is not finite (or of
    2^32 or more), or has another length than most distinct vectors have (of equally frequent lengths
    the longest counts). Components are fitted on each distinct vector once, so copies don't shift them;
    every row is returned, copies, rows without an id and repeated ids too. Directions in which the
    fit list doesn't vary have no unit variance and are left out: a list of one vector, or none, gives
    no rows. Of equal eigenvalues any basis is right. ``deviation`` is exact, of up to 38 digits. Other
    columns are ignored, whatever their names.
    """
    vectors = df.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col)).alias("x"))
    fitted = fit_list(vectors)
    model = fit(fitted, components)
    if model is None or not len(model.values):
        model, error = Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 1.0), 0.0
        vectors = vectors.where("false")
    else:
        error = identity_error(fitted, model)
    shares = [float(v) / model.trace for v in model.values]
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("component")) if shares else F.lit(None).cast("double")
    return projected(vectors, model).select(
        "vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
