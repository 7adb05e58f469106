"""Whitening of embeddings: exact integer cross-products from bit planes, then eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from purseflow.session import staged

SCALE = 256
COMPONENTS = 4
# Rows packed into one set of bit planes: 128 words of 64 rows.
CHUNK_ROWS = 8192
# Integers of any size are added up in parts of so many bits.
_LIMB = 40
_LONG_MAX = (1 << 63) - 1


def scaled_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(vec_id, x): each entry times ``scale``, rounded down to a long.

    Vectors that are null, hold a null or non-finite entry, or are shorter than the longest of the
    rest are left out. Entries beyond a long become the nearest long.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    entries = vectors.select(
        quoted(id_col).alias("vec_id"), quoted(vector_col).cast("array<double>").alias("e")
    ).filter(F.col("e").isNotNull() & ~F.exists("e", bad))
    x = F.transform("e", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x")
    rows = staged(entries.select("vec_id", x), "scaled")
    longest = rows.agg(F.max(F.size("x")).alias("longest"))
    return rows.join(F.broadcast(longest), F.size("x") == F.col("longest")).select("vec_id", "x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(value: int) -> list[int]:
    """``value`` >= 0 in parts of 40 bits, the lowest first."""
    found = []
    while value:
        found.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return found


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows, least and largest entry of every dimension."""
    low = high = None
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch)
        rows += len(x)
        least, most = x.min(axis=0, initial=_LONG_MAX), x.max(axis=0, initial=-_LONG_MAX - 1)
        low = least if low is None else np.minimum(low, least)
        high = most if high is None else np.maximum(high, most)
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high),
             pa.array(np.full(len(low), rows, dtype=np.int64))],
            names=["dim", "low", "high", "rows"],
        )


def bit_planes(shifted: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Planes by words: word w of a plane holds one bit of 64 rows of one dimension.

    ``bits[k]`` are the dimensions that have a bit k; planes come in that order.
    """
    rows = len(shifted)
    padded = np.zeros((-(-rows // 64) * 64, shifted.shape[1]), dtype=np.uint64)
    padded[:rows] = shifted
    planes = []
    for k, dims in enumerate(bits):
        ones = ((padded[:, dims] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        planes.append(np.ascontiguousarray(np.packbits(ones, axis=0).T).view(np.uint64))
    return np.concatenate(planes) if planes else np.zeros((0, len(padded) // 64), np.uint64)


class Scatter:
    """Exact sums and cross-products of shifted entries, added up from chunks of rows.

    ``bits[k]`` are the dimensions whose shifted entries have a bit k. Sums are kept as longs while
    those surely hold them, and moved to Python integers before they might not.
    """

    def __init__(self, bits: list[np.ndarray], dims: int):
        self.bits, self.dims = bits, dims
        spare = 62 - 2 * len(bits) - (CHUNK_ROWS - 1).bit_length()
        self.kind = np.int64 if spare >= 0 else object
        self.room = 1 << max(spare, 0)
        self.cross, self.sums = np.zeros((dims, dims), dtype=object), np.zeros(dims, dtype=object)
        self._clear()

    def _clear(self) -> None:
        self.part = np.zeros((self.dims, self.dims), dtype=self.kind)
        self.twice = np.zeros(self.dims, dtype=self.kind)
        self.single = np.zeros(self.dims, dtype=self.kind)
        self.chunks = 0

    def add(self, shifted: np.ndarray) -> None:
        """At most CHUNK_ROWS rows of non-negative entries."""
        planes = bit_planes(shifted, self.bits)
        begin = np.concatenate(([0], np.cumsum([len(d) for d in self.bits]))).astype(int).tolist()
        for i, mine in enumerate(self.bits):
            for p, a in enumerate(mine.tolist(), begin[i]):
                # Rows that have bit p and bit q, for all planes q from p on.
                both = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
                both = both.astype(self.kind, copy=False)
                self.single[a] += both[0] << i
                self.twice[a] += both[0] << (2 * i)
                for j in range(i, len(self.bits)):
                    first = max(begin[j], p)
                    dims = self.bits[j][first - begin[j] :]
                    self.part[a, dims] += both[first - p : begin[j + 1] - p] << (i + j)
        self.chunks += 1
        if self.chunks >= self.room:
            self.flush()

    def flush(self) -> None:
        part = self.part.astype(object)
        # Pairs with q < p are the same counts seen from the other side; q = p is there once.
        self.cross += part + part.T
        self.cross[np.diag_indices(self.dims)] -= self.twice.astype(object)
        self.sums += self.single.astype(object)
        self._clear()


def _scatter(low: np.ndarray, bits: list[np.ndarray]):
    """(a, b, limb, part): cross-products of dimensions a <= b; b = -1 for the sum of a."""
    dims = len(low)
    base = low.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Scatter(bits, dims)
        for batch in batches:
            x = _matrix(batch)
            for start in range(0, len(x), CHUNK_ROWS):
                # Modulo 2^64 the difference is right even where a signed one would overflow.
                found.add(x[start : start + CHUNK_ROWS].view(np.uint64) - base)
        found.flush()
        for a in range(dims):
            values = [found.sums[a], *found.cross[a, a:]]
            rows = [
                (a, b, k, part)
                for b, value in zip((-1, *range(a, dims)), values)
                for k, part in enumerate(limbs(int(value)))
            ]
            if rows:
                columns = zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in columns], names=["a", "b", "limb", "part"]
                )

    return run


@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors with integer ``sums``; rows of ``axes`` are components."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: long where that fits, Python integers otherwise."""
        widest = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
        if self.n * widest + max((abs(int(s)) for s in self.sums), default=0) <= _LONG_MAX:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components: the centred vector's projections over the square roots."""
        centred = (self.deviations(x) / self.n).astype(np.float64)
        return centred @ self.axes.T / np.sqrt(self.eigenvalues)

    def lengths(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squared deviations, exact; none where a long cannot hold it."""
        d = self.deviations(x)
        widest = max((abs(int(v)) for v in (d.min(initial=0), d.max(initial=0))), default=0)
        if widest * widest * d.shape[1] <= _LONG_MAX:
            return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (d.astype(object) ** 2).sum(axis=1)
        return [int(v) if v <= _LONG_MAX else None for v in exact]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each distinct x once, staged; equal ones meet in partial aggregates."""
    return staged(rows.select("x").distinct(), "distinct")


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the ``distinct`` vectors (x); none if no vector has an entry.

    Entries are shifted by their dimension's least, so that they are non-negative, and their bits
    packed across rows. AND-popcounts of two planes, weighted by their bits, add up to exact
    cross-products C; n C - S S' are the exact n^2-fold covariances, centred as integers, and only
    their quotients are rounded. Components whose variance is rounding error are left out.

    The driver receives sums per pair of dimensions, whose number the data's rows don't change.
    """
    spans = distinct.mapInArrow(_ranges, "dim int, low long, high long, rows long")
    spans = spans.groupBy("dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")
    )
    found = sorted(spans.collect())
    if not found:
        return None
    dims, n = len(found), found[0]["rows"]
    low = np.array([r["low"] for r in found], dtype=np.int64)
    width = np.array([(r["high"] - r["low"]).bit_length() for r in found])
    bits = [np.flatnonzero(width > k) for k in range(int(width.max()))]
    parts = distinct.mapInArrow(_scatter(low, bits), "a int, b int, limb int, part long")
    cross, sums = np.zeros((dims, dims), dtype=object), np.zeros(dims, dtype=object)
    for r in parts.groupBy("a", "b", "limb").agg(F.sum("part").alias("part")).collect():
        value = r["part"] << (_LIMB * r["limb"])
        if r["b"] < 0:
            sums[r["a"]] += value
        else:
            cross[r["a"], r["b"]] += value
            if r["a"] != r["b"]:
                cross[r["b"], r["a"]] += value
    centred = cross * n - np.outer(sums, sums)
    covariance = (centred / (n * n)).astype(np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    real = np.flatnonzero(values > dims * np.finfo(np.float64).eps * max(values[0], 0.0))[:components]
    trace = int(np.trace(centred)) / (n * n)
    return Whitening(n, sums + low.astype(object) * n, vectors[:, real].T.copy(), values[real], trace)


def _moments(shared):
    """(i, j, part): sums of products of whitened entries; j = -1 for the sum of i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.eigenvalues)
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.whitened(_matrix(batch))
            products += w.T @ w
            sums += w.sum(axis=0)
        found = np.concatenate((sums[:, None], products), axis=1)
        i, j = np.divmod(np.arange(k * (k + 1), dtype=np.int32), np.int32(k + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array((j - 1).astype(np.int32)), pa.array(found.ravel())],
            names=["i", "j", "part"],
        )

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit vectors' covariance minus the identity."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)
    parts = distinct.mapInArrow(_moments(shared), "i int, j int, part double")
    k = len(model.eigenvalues)
    found = np.zeros((k, k + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("part").alias("part")).collect():
        found[r["i"], r["j"] + 1] = r["part"] / model.n
    mean, products = found[:, 0], found[:, 1:]
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


_RESULT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _apply(shared, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.eigenvalues)
        explained = model.eigenvalues / model.trace
        for batch in batches:
            rows = batch.num_rows
            x = _matrix(batch)
            at = np.repeat(np.arange(rows), k)
            lengths = pa.array(model.lengths(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                    lengths.take(pa.array(at)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """One row per remaining vector and component: id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Entries are scaled to integers as in ``scaled_vectors``, which also says what is left out. The
    fit uses each distinct integer vector once (n of them). ``deviation`` is the sum over dimensions
    of (n x - S)^2, null where a long cannot hold it. Components without variance are left out, so
    fewer than two distinct vectors, or an empty table, give no rows. Repeated rows and repeated
    or null ids each keep their rows. Ties between eigenvalues leave the choice of axes to the
    eigenvalue routine; all rows share it. Other columns are not looked at.

    Vectors are dealt once, to find distinct ones; everything else is partial sums.
    """
    rows = scaled_vectors(vectors, id_col, vector_col)
    distinct = distinct_vectors(rows)
    model = fit_whitening(distinct, components)
    id_type = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, {_RESULT}"
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("vec_id", id_col)
    error = identity_error(distinct, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_apply(shared, error), schema).withColumnRenamed("vec_id", id_col)
