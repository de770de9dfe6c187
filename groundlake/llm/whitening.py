"""Whitened embeddings: exact variances of dimensions and of sums of two dimensions give every covariance (polarisation)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

SCALE = 256
SHORT, LONG = b"\x02", b"\x08"  # how a packed vector begins: 16 or 64 bits an entry
SMALL = 1 << 20  # entries under this, in blocks of ROWS rows, can be squared and summed in 64 bits
ROWS = 4096
LIMB = 60  # sums travel as two parts, high and low, each within 38 decimal digits
MOST = 10**38


def packed(column: pa.ListArray) -> list[bytes | None]:
    """floor(256 * entry) of each vector as bytes: equal vectors have equal bytes; None for a null vector or a null or non-finite entry.

    Entries beyond 64 bits become the nearest long, as Spark's own floor does.
    """
    with np.errstate(all="ignore"):
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.floor(values * SCALE)
    good, big = np.isfinite(values), np.abs(x) >= 32768
    low, high = x < -(2.0**63), x >= 2.0**63
    x = np.where(good & ~low & ~high, x, 0).astype(np.int64)
    x[good & low], x[good & high] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    odd = np.concatenate([[0], np.cumsum(~good)])
    wide = np.concatenate([[0], np.cumsum(big & good)])
    short, long = x.astype("<i2").tobytes(), x.astype("<i8").tobytes()
    out: list[bytes | None] = []
    for a, z, null in zip((ends - lengths).tolist(), ends.tolist(), column.is_null().to_pylist()):
        if null or odd[z] > odd[a]:
            out.append(None)
        else:
            out.append(LONG + long[8 * a : 8 * z] if wide[z] > wide[a] else SHORT + short[2 * a : 2 * z])
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """A row for each packed vector, filled up with zeros to ``dims`` entries."""
    if rows and all(r[:1] == SHORT and len(r) == 1 + 2 * dims for r in rows):
        return np.ascontiguousarray(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)[:, 1:]).view("<i2").astype(np.int64)
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for k, r in enumerate(rows):
        x = np.frombuffer(r[1:], dtype="<i2" if r[:1] == SHORT else "<i8")
        out[k, : len(x)] = x
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, unpacked(part.column("x").to_pylist(), dims)


def centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - middle; Python integers where squares could pass 64 bits."""
    if x.size and max(abs(int(x.min())), abs(int(x.max())), *map(abs, middle)) >= SMALL // 2:
        return x.astype(object) - np.array(middle, dtype=object)
    return x - np.array(middle, dtype=np.int64)


def squares(z: np.ndarray) -> np.ndarray:
    """Sums of squares over the rows: of dimension i at (i, i), of the sum of dimensions i and j at (i, j), j > i."""
    dims = z.shape[1]
    out = np.zeros((dims, dims), dtype=object)
    for i in range(dims):
        pair = z[:, i:] + z[:, i : i + 1]
        pair[:, 0] = z[:, i]
        out[i, i:] = (pair * pair).sum(axis=0) if z.dtype == object else np.einsum("ij,ij->j", pair, pair)
    return out


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums ``middle * n + rest``; columns of ``axes`` are unit eigenvectors by falling eigenvalue."""

    n: int
    middle: list[int]
    rest: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; not a number on axes without variance."""
        z = centred(x, self.middle).astype(np.float64) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, z @ self.axes / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum)^2, exact, as Python integers."""
        z = centred(x, self.middle)
        square = (z * z).sum(axis=1).astype(object)
        fits = z.dtype != object and z.shape[1] * SMALL * self.n < 1 << 62  # 0 <= rest < n
        cross = ((z if fits else z.astype(object)) @ np.array(self.rest, dtype=np.int64 if fits else object)).astype(object)
        return self.n * self.n * square - 2 * self.n * cross + sum(r * r for r in self.rest)


def covariance(n: int, sums: list[int], pairs: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances, divisor n, from exact sums about a common middle: each is one correctly rounded division of integers.

    n^2 Var(a) = n * sum(a^2) - sum(a)^2 for a dimension and for a sum of two; Cov(i, j) = (Var(i + j) - Var(i) - Var(j)) / 2.
    """
    dims = len(sums)
    var = {(i, j): n * s - (sums[i] + (sums[j] if j > i else 0)) ** 2 for (i, j), s in pairs.items()}
    out = np.zeros((dims, dims))
    for (i, j), v in var.items():
        out[i, j] = out[j, i] = v / (n * n) if i == j else (v - var[i, i] - var[j, j]) / (2 * n * n)
    return out


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals of (i, j, high, low): as many rows as dimensions, or pairs of them, reach the driver."""
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r.i, r.j): (int(r.high) << LIMB) + int(r.low) for r in found}


PARTS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _parts(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    exact = pa.decimal128(38, 0)
    keys, values = list(totals), list(totals.values())
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(v >> LIMB) for v in values], exact), pa.array([Decimal(v & (1 << LIMB) - 1) for v in values], exact)]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])


def vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, the packed vector, in place of ``column``; rows without a whole finite vector go."""

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        return pa.array(packed(values), pa.binary())

    return rows.withColumn("x", pack.asNondeterministic()(F.col(column).cast("array<double>"))).drop(column).filter("x is not null")


def fit(xs: DataFrame, components: int) -> Whitening | None:
    """The whitening of ``xs`` (x, packed and distinct); None if there is no vector."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {(-1, 0): 0}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.column("x").slice(lo, ROWS).to_pylist()
                x = unpacked(rows, max((len(r) - 1) // r[0] for r in rows))
                totals[-1, 0] += len(x)
                safe = x if not x.size or np.abs(x.astype(np.float64)).max() < 1 << 50 else x.astype(object)
                for i, s in enumerate(safe.sum(axis=0).tolist() if x.size else [0] * x.shape[1]):
                    totals[i, 0] = totals.get((i, 0), 0) + s
        yield _parts(totals)

    found = _summed(xs.mapInArrow(sums, PARTS))
    n = found.pop((-1, 0), 0)
    if not n:
        return None
    dims = len(found)
    total = [found[i, 0] for i in range(dims)]
    middle = [s // n for s in total]
    rest = [s - n * m for s, m in zip(total, middle)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, dims), dtype=object)
        for _, x in _blocks(batches, dims):
            out += squares(centred(x, middle))
        yield _parts({(i, j): int(out[i, j]) for i in range(dims) for j in range(i, dims)})

    v = covariance(n, rest, _summed(xs.mapInArrow(moments, PARTS)))
    values, axes = np.linalg.eigh(v) if dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    if dims:
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
        values = np.where(values > dims * np.finfo(float).eps * max(float(values.max()), 0), values, 0)
    trace = float(np.trace(v))
    return Whitening(n, middle, rest, axes, values, [float(e) / trace if trace > 0 else None for e in values])


def identity_error(xs: DataFrame, found: Whitening) -> float | None:
    """Largest entry, without its sign, of the whitened vectors' covariance less the identity; axes without variance don't count."""
    dims, live = len(found.middle), np.flatnonzero(found.values > 0)
    k = len(live)
    if not k:
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, dims):
            w = found.project(x)[:, live]
            first += w.sum(axis=0)
            second += w.T @ w
        cells = [(i, j) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * k + [i for i, _ in cells], pa.int32()), pa.array([*range(k), *(j for _, j in cells)], pa.int32()), pa.array([*first, *second.ravel()], pa.float64())], ["i", "j", "s"])

    rows = xs.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k + k * k rows
    sums = {(r.i, r.j): r.s / found.n for r in rows}
    return max(abs(sums[i, j] - sums[-1, i] * sums[-1, j] - (i == j)) for i in range(k) for j in range(k))


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of ``embeddings``
    (vec_id, embedding) and each of the first ``components`` axes.

    Entries become x = floor(256 * entry). The fit is on each distinct x once: n of them, with sums S. deviation is the sum over
    dimensions of (n * x - S)^2 as an exact decimal, null beyond 38 digits; whitened is x - S / n on the axis over the
    root of its eigenvalue e; explained is e over the trace. Axes are the covariance's unit eigenvectors by
    falling eigenvalue, of the sign that makes their largest entry positive.

    Rows with a null vector or with null or non-finite entries are dropped. Repeated rows and ids stay; a null vec_id
    is carried along; other columns are ignored; an empty table gives no rows. Vectors of fewer entries than the longest count
    as filled up with zeros; there are as many components as entries at most. On an axis without variance (e zero to
    double precision) whitened is null; if no axis has any, so are explained and identity_error.

    Scale: three passes over the distinct vectors, which are shuffled once in 16 bits an entry, copies met by partial
    aggregation; a task sends on a row for each pair of dimensions, and that many reach the driver, however many vectors there are.
    All sums are exact integers about the rounded mean. The rows themselves aren't shuffled.
    """
    rows = vectors(embeddings.select("vec_id", "embedding"))
    with scratch(embeddings.sparkSession, "whitening") as keep:
        xs = keep(rows.select("x").distinct(), "distinct")
        found = fit(xs, components)
        error = identity_error(xs, found) if found else None
    schema = "vec_id bigint, deviation decimal(38,0), whitened array<double>"
    if not found:
        found = Whitening(0, [], [], np.zeros((0, 0)), np.zeros(0), [])
    dims = len(found.middle)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dims):
            deviations = pa.array([Decimal(d) if d < MOST else None for d in found.deviations(x)], pa.decimal128(38, 0))
            whitened = pa.array([[None if v != v else v for v in row] for row in found.project(x).tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviations, whitened], ["vec_id", "deviation", "whitened"])

    out = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(project, schema).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(e).cast("double") for e in found.explained]).cast("array<double>")
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
