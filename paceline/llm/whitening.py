"""Embedding whitening with an exact covariance from digit-slice products.

1. A task splits its vectors' integers into limbs of LIMB bits and multiplies limb matrices
   with float64 BLAS. A product of LIMB-bit digits summed over ROWS rows stays below 2**53,
   so each is exact. The limb products are put together as big integers.
2. Big integers leave a task as 32-bit limbs in longs, which Spark sums, task by task, before
   they are carried over into one big integer an entry: n, the sums S and the products are
   exact at every number of rows. To the driver go d * (d + 3) / 2 rows, d being the dimension.
3. n * sum(x x') - S S' is the covariance times n**2, exactly; rounded once to double, it is
   decomposed. Eigenvectors of a symmetric matrix of d rows are the driver's only numeric work.
4. A further pass whitens each vector and sums up the covariance of the result, a task centring
   on its own mean first; the parts are merged pairwise with their means. The last pass gives
   the rows.

Each step is one pass over the vectors that leaves nothing behind but sums, so a lost executor
costs its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb and rows of a product: 2 * LIMB + log2(ROWS) < 53.
LIMB, ROWS = 20, 4096
#: An entry beyond this after scaling counts as this: the integers are longs.
LARGEST = 2.0**62
#: Limbs of 32 bits that a sum is carried in; sums of more bits than they hold can't occur in less than 2**60 rows.
CARRIED = 6
#: A component whose eigenvalue is less than this share of the largest has no direction of its own.
FLAT = 1e-13


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry, as long."""
    return np.clip(np.floor(vectors * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Digits of LIMB bits as float64, the lowest first; the last one has the sign. As few as the largest number needs."""
    out = []
    while True:
        if -(1 << LIMB) < x.min() and x.max() < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        out.append((x & (2**LIMB - 1)).astype(np.float64))
        x = x >> LIMB


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of a matrix of longs, as big integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        digits = limbs(x[at : at + ROWS])
        sums: dict[int, np.ndarray] = {}
        for i, a in enumerate(digits):
            for j, b in enumerate(digits[i:], i):
                exact = (a.T @ b).astype(np.int64).astype(object)
                sums[i + j] = sums.get(i + j, 0) + (exact if i == j else exact + exact.T)
        for place, some in sums.items():
            total = total + some * (1 << (LIMB * place))
    return total


def split(value: int) -> list[int]:
    """A big integer as CARRIED limbs of 32 bits; the last one has the sign."""
    return [(value >> (32 * i)) & 0xFFFFFFFF for i in range(CARRIED - 1)] + [value >> (32 * (CARRIED - 1))]


def joined(parts) -> int:
    """The big integer of limbs, summed or not."""
    return sum(int(p) << (32 * i) for i, p in enumerate(parts))


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = pc.list_flatten(column).cast(pa.float64(), safe=False)
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, limbs) of a task: products for i <= j, sums for j = -1, the number of rows at (-1, -1)."""
    n, s, g = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = integers(_vectors(batch.column(0)))
            some = np.array([sum(c.tolist()) if abs(c).max(initial=0) > 2**40 else int(c.sum()) for c in x.T], object)
            n, s, g = n + len(x), some if s is None else s + some, gram(x) if g is None else g + gram(x)
    if n:
        d = len(s)
        keys = [(-1, -1), *((i, -1) for i in range(d)), *((i, j) for i in range(d) for j in range(i, d))]
        values = [n, *s, *(g[i, j] for i in range(d) for j in range(i, d))]
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
        columns += [pa.array(c, pa.int64()) for c in zip(*map(split, values), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", *(f"l{k}" for k in range(CARRIED))])
    release_memory()


class Fit:
    """n, S and the components of a table of vectors: `values` falling, `vectors` a column each, `trace` of the covariance."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], components: int = COMPONENTS):
        d = len(sums)
        self.n, self.sums = n, sums
        exact = [[n * products[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        values, vectors = np.linalg.eigh(np.array([[v / n**2 for v in row] for row in exact]))  # each entry correctly rounded
        self.trace = sum(exact[i][i] for i in range(d)) / n**2
        top = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[top], vectors[:, top]
        self.full = self.values > FLAT * max(values.max(initial=0.0), 0.0)
        self.scale = np.where(self.full, 1 / np.sqrt(np.where(self.full, self.values, 1.0)), 0.0)
        self.explained = np.where(self.full, self.values, 0.0) / self.trace if self.trace > 0 else np.zeros(len(top))
        self.floors, self.rests = [s // n for s in sums], [s % n for s in sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as double; the subtraction of large numbers is one of integers."""
        return (x - np.array(self.floors, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rests])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) * self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)**2) a row, exactly: in longs where they hold it, else in big integers."""
        y = x - np.array(self.floors, np.int64)
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) < 2**63:
            z = y * self.n - np.array(self.rests, np.int64)
            return (z * z).sum(axis=1).tolist()
        return [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, self.rests, strict=True)) for row in y.tolist()]


def merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, scatter) of two parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _part(w: np.ndarray) -> tuple:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _spread(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's (n, mean, scatter) of whitened vectors, one row."""
        parts = (_part(fit.whitened(integers(_vectors(b.column(0))))) for b in batches if b.num_rows)
        total = functools.reduce(merged, parts, None) if False else None
        for part in parts:
            total = part if total is None else merged(total, part)
        if total:
            lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in total[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), *lists], ["n", "mean", "scatter"])
        release_memory()

    return run


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, mean, scatter) of a partition as one."""
    total = None
    for batch in batches:
        for n, mean, scatter in zip(*(batch.column(i) for i in range(3)), strict=True):
            m = mean.values.to_numpy()
            part = (n.as_py(), m, scatter.values.to_numpy().reshape(len(m), len(m)))
            total = part if total is None else merged(total, part)
    if total:
        lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in total[1:]]
        yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), *lists], ["n", "mean", "scatter"])


_PART = "n long, mean array<double>, scatter array<double>"
#: Tasks that merge the parts of all others, and so rows that reach the driver.
MERGERS = 64


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; components without a direction are left out."""
    parts = vectors.mapInArrow(_spread(fit), _PART)
    parts = parts.repartition(MERGERS).mapInArrow(_merge_groups, _PART)
    total = None
    for row in parts.toLocalIterator():  # MERGERS rows, of the components' size
        k = len(row["mean"])
        part = (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(k, k))
        total = part if total is None else merged(total, part)
    if total is None:
        return 0.0
    cov = (total[2] / total[0])[np.ix_(fit.full, fit.full)]
    return float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): vectors without null or non-finite entries, of the most frequent length, the longest of equally frequent ones."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    vector = rows[vector_col].cast("array<double>")
    good = rows.select(rows[id_col].alias("vec_id"), vector.alias("vector")).where((F.size("vector") > 0) & F.forall("vector", finite))
    lengths = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    return good.where(F.size("vector") == F.lit(most))


def learn(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit over all `vector`s; None without any."""
    names = [f"l{k}" for k in range(CARRIED)]
    parts = small_batches(vectors.select("vector")).mapInArrow(_sums, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    got = {(r["i"], r["j"]): joined(r[c] for c in names) for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).toLocalIterator()}
    if not got:
        return None
    d = sum(1 for i, j in got if j < 0 <= i)
    return Fit(got[-1, -1], [got[i, -1] for i in range(d)], got, components)


def _applied(fit: Fit, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = integers(_vectors(some.column(1)))
                rows = np.repeat(np.arange(len(x)), k)
                deviations = pa.array([str(v) for v in fit.deviations(x)], pa.string()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), fit.n)), deviations,
                        pa.array(fit.whitened(x).ravel()), pa.array(np.tile(fit.explained, len(x))), pa.array(np.full(len(rows), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        release_memory()

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty or holds a null or non-finite entry are left out. Vectors of other
    lengths than the most frequent one (the longest of equally frequent ones) lack entries or have
    some that others lack, and are left out too. Entries count as floor(64 * c) + 1000000, at most
    2**62 away from zero. A component numbers from 1 by falling variance, up to the dimension or
    `components`. One without variance (fewer vectors than dimensions, or equal ones) has whitened
    and explained 0, and no part in identity_error. deviation is a decimal text, exact at any size.
    Ids may be null, repeated and of any type. An empty table, or one without usable
    vectors, gives an empty result. Further columns of `rows` are not read.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    vectors = small_batches(_usable(rows, id_col, vector_col))
    fit = learn(vectors, components)
    if fit is None:
        return rows.sparkSession.createDataFrame([], shape)
    return vectors.mapInArrow(_applied(fit, identity_error(vectors.select("vector"), fit)), shape)


def op11_whitening(spark, sf_dir):
    """Deviations that a long can't hold are null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
