"""Whitening of embedding vectors by TSQR: a QR of each partition, a tree of merged R factors, an SVD of the last one.

Vectors are taken as integers first: x = floor(scale * c) + offset for each entry c, so sums over
any number of rows are exact and the same however the rows are dealt out.  Rows are centred by
those sums (the integer part exactly, then the fraction), each partition's rows are reduced to
an upper triangle R, triangles are stacked and reduced again in a tree, and the singular values
and right vectors of the last one whiten the rows.  No covariance is formed on the way.

Results for odd input:

* A null vector, one with a null, NaN or infinite entry, and one whose length is not ``dim`` (by
  default the commonest length, the longer of equally common ones) take no part and get no row.
* An entry so large that x has no place in 53 bits counts as the largest that has.
* Components without variance (a standard deviation of less than 1e-12 of the first one's) are left
  out: equal vectors only, or a single one, give no component at all; an empty table gives no row.
* Equal vectors get equal results, with a row for each.  Eigenvalues that tie give any basis of
  their space, the same for all rows.
* A null id is kept.  Other columns are neither read nor returned, so their names may be any.
* A deviation that a long cannot hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
_LARGEST = 2.0**53
#: Rows reduced at a time, and parts merged by one task of the tree.
BLOCK, FAN_IN = 4096, 16
#: Standard deviations below this share of the largest count as none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n rows in so many parts, exact sums, components as rows, the eigenvalue of each and the sum of all."""

    parts: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def commonest_length(rows: DataFrame, vector: str) -> int:
    """Of lengths that vectors have, the one most have; 0 without vectors."""
    found = rows.groupBy(F.size(vector).alias("k")).count().where("k > 0").orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    return found[0]["k"] if found else 0


def usable(vector: str, dim: int) -> F.Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, bad)


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    c = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c) + OFFSET, -_LARGEST, _LARGEST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(i, BLOCK)
            yield piece, _integers(piece.column(at), dim)


def exact_sums(vectors: DataFrame, dim: int) -> tuple[int, int, list[int]]:
    """(parts with rows, n, sums): integers of any size, added in Spark as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for _, x in _blocks(batches, dim):
            n += len(x)
            # halves of 32 bits, so that no sum of a block overflows
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (h << 32) + v for t, h, v in zip(total, high.tolist(), low.tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})

    parts = vectors.mapInArrow(run, "n long, total array<string>").select("n", F.posexplode("total").alias("at", "t"))
    found = parts.groupBy("at").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).orderBy("at").collect()
    return (found[0]["parts"], found[0]["n"], [int(r["t"]) for r in found]) if found else (0, 0, [0] * dim)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part is taken off exactly, then the fraction."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2 over the dimensions, exact."""
    d = x - np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    most = int(np.abs(d).max(initial=0)) + 1
    if (most * n) ** 2 * len(sums) < 1 << 63:
        y = d * n - np.array(rest, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    out = (sum((int(a) * n - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in d)
    return [v if v < 1 << 63 else None for v in out]


def tree(parts: DataFrame, count: int, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The parts (columns id long, part binary; about count of them) merged FAN_IN at a time until one is left."""

    def merged(group: pa.Table) -> pa.Table:
        one = merge([x.as_py() for x in group.column("part")])
        return pa.table({"id": group.column("id").slice(0, 1), "part": pa.array([one], pa.binary())})

    while True:
        count = -(-count // FAN_IN)
        parts = parts.withColumn("id", F.col("id") % F.lit(max(1, count))).groupBy("id").applyInArrow(merged, "id long, part binary")
        if count <= 1:
            break
    found = parts.collect()
    return bytes(found[0]["part"]) if found else None


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, always square."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == rows.shape[1] else np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def r_factor(vectors: DataFrame, n: int, sums: list[int], parts: int) -> np.ndarray:
    """The R factor of all centred rows."""
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _blocks(batches, dim):
            rows = centred(x, n, sums)
            r = _triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"id": pa.array([TaskContext.get().partitionId()], pa.int64()), "part": pa.array([r.tobytes()], pa.binary())})

    def merge(found: list[bytes]) -> bytes:
        r = np.frombuffer(found[0]).reshape(dim, dim)
        for x in found[1:]:
            r = _triangle(np.vstack([r, np.frombuffer(x).reshape(dim, dim)]))
        return r.tobytes()

    last = tree(vectors.mapInArrow(run, "id long, part binary"), parts, merge)
    return np.frombuffer(last).reshape(dim, dim) if last else np.zeros((dim, dim))


def fit(rows: DataFrame, vector: str = "embedding", dim: int | None = None) -> Whitening | None:
    """Fits on all usable vectors; None where there are none.  To the driver come sums and one R factor, of dim columns."""
    dim = commonest_length(rows, vector) if dim is None else dim
    if not dim:
        return None
    vectors = rows.select(vector).where(usable(vector, dim))
    parts, n, sums = exact_sums(vectors, dim)
    if not n:
        return None
    _, singular, right = np.linalg.svd(r_factor(vectors, n, sums, parts))
    some = int((singular > NO_VARIANCE * max(singular[0], 1e-300)).sum()) if singular[0] > 0 else 0
    values = singular**2 / n
    return Whitening(parts, n, sums, right[:some], values[:some], float(values.sum()))


def _projection(model: Whitening, k: int) -> np.ndarray:
    return model.components[:k].T / np.sqrt(model.values[:k])


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding", into: str = "whitened", k: int | None = None) -> DataFrame:
    """rows with a column of whitened vectors beside (in place of one of that name); null where a vector is not usable."""
    k = len(model.values) if k is None else min(k, len(model.values))
    n, sums, dim, by = model.n, model.sums, model.dim, _projection(model, k)
    rows = rows.drop(into)
    schema = pa.list_(pa.float64())
    hidden = next(f"v{i}" for i in range(len(rows.columns) + 1) if f"v{i}" not in rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), BLOCK):
                piece = batch.slice(i, BLOCK)
                at = piece.schema.get_field_index(hidden)
                use = piece.column(at)
                z = centred(_integers(use.drop_null(), dim), n, sums) @ by
                valid = use.is_valid().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(valid * k)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)), mask=pa.array(~valid))
                yield pa.RecordBatch.from_arrays([*(piece.column(j) for j in range(piece.num_columns) if j != at), lists.cast(schema)], names=[*(x for x in piece.schema.names if x != hidden), into])

    out = rows.withColumn(hidden, F.when(usable(vector, dim), F.col(vector)))
    return out.mapInArrow(run, StructType([*rows.schema, StructField(into, ArrayType(DoubleType()))]))


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves.

    Each partition centres its own rows before it multiplies; means and products are merged in a tree.
    """
    n, sums, dim, by = model.n, model.sums, model.dim, _projection(model, k)

    def joined(a: tuple, b: tuple) -> tuple:
        total, d = a[0] + b[0], b[1] - a[1]
        return total, a[1] + d * (b[0] / total), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / total)

    def packed(a: tuple) -> bytes:
        return np.concatenate([[float(a[0])], a[1], a[2].reshape(-1)]).tobytes()

    def unpacked(raw: bytes) -> tuple:
        flat = np.frombuffer(raw)
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for _, x in _blocks(batches, dim):
            z = centred(x, n, sums) @ by
            mean = z.mean(axis=0)
            own = (float(len(z)), mean, (z - mean).T @ (z - mean))
            all_ = own if all_ is None else joined(all_, own)
        if all_ is not None:
            yield pa.RecordBatch.from_pydict({"id": pa.array([TaskContext.get().partitionId()], pa.int64()), "part": pa.array([packed(all_)], pa.binary())})

    def merge(found: list[bytes]) -> bytes:
        acc = unpacked(found[0])
        for raw in found[1:]:
            acc = joined(acc, unpacked(raw))
        return packed(acc)

    _, _, products = unpacked(tree(vectors.mapInArrow(run, "id long, part binary"), model.parts, merge))
    return float(np.abs(products / n - np.eye(k)).max())


_REPORT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """A row for each usable vector and each of the first components: whitened value, exact deviation, shares and error."""
    spark = rows.sparkSession
    schema = _REPORT.format(rows.schema[key].dataType.simpleString())
    model = fit(rows, vector)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    k = min(most, len(model.values))
    n, sums, dim, by = model.n, model.sums, model.dim, _projection(model, k)
    good = rows.select(key, vector).where(usable(vector, dim))
    error, shares = identity_error(good.select(vector), model, k), model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, dim, 1):
            m = len(x)
            z = centred(x, n, sums) @ by
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(z.reshape(-1)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.mapInArrow(run, schema)
