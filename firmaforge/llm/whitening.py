"""Embedding whitening: components of the covariance by FEAST contour integration.

The data give two things, each in one distributed pass: the number of vectors with the exact sums
of every dimension, and the covariance, centred before it is multiplied. A pass adds up small
matrices per task and then row by row; only a matrix of dimension x dimension reaches the driver.

The largest components are found without a dense eigensolver. Inertia counts (negative pivots of
a symmetric factorisation of V - s) tell how many eigenvalues lie above s, so bisection cuts the
spectrum into intervals of known, small numbers of eigenvalues. Each interval is a row of a Spark
job: Gauss-Legendre quadrature of complex shifted solves over a circle around the interval
projects a block of vectors onto its eigenspace, Rayleigh-Ritz extracts values and vectors, and
this is repeated until the residuals vanish. An interval whose values differ in number from its
inertia count fails the job: none is missed, none comes twice.

Defined results: rows whose vector is null, empty, holds a null or an entry that is not finite
are left out, and so are entries too large to count exactly (over 2^52 after scaling) and, if
lengths differ, vectors of other than the most frequent length (the longer one in a tie);
components whose variance doubles can't tell from none (under 2^-40 of a bound of the largest)
don't exist, so a table of equal vectors gives no rows; repeated rows and null ids count as they stand; a deviation over
2^63 - 1 is null; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firmaforge.llm.batches import fresh, table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 52)
NODES = 8
INTERVAL = 12
ROUNDS = 60
NOTHING = 2.0**-40


# Symmetric factorisation and inertia


def inertia_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: positive pivots of v - shift, with blocks of one or two."""
    a = v - shift * np.eye(len(v))
    alpha = (1 + np.sqrt(17)) / 8
    above = 0
    while len(a):
        big = np.abs(a)
        i, j = divmod(int(big.argmax()), len(a))
        k = int(big.diagonal().argmax())
        if big[i, j] == 0:
            break
        pick = [k] if big[k, k] >= alpha * big[i, j] else [i, j]
        rest = np.delete(np.arange(len(a)), pick)
        block, side = a[np.ix_(pick, pick)], a[np.ix_(rest, pick)]
        if len(pick) == 1:
            above += block[0, 0] > 0
            a = a[np.ix_(rest, rest)] - side @ side.T / block[0, 0]
        else:  # a pivot of two with a large off-diagonal has a value of each sign
            above += 1
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(above)


@dataclass(frozen=True)
class Interval:
    low: float
    high: float
    count: int


def intervals(v: np.ndarray, k: int, most: int = INTERVAL) -> list[Interval]:
    """Parts of the spectrum that hold the ``k`` largest positive eigenvalues, from the top.

    A part holds ``most`` eigenvalues unless they are closer than doubles tell apart; the last may
    hold some beyond ``k`` that are as close.
    """
    top = float(np.abs(v).sum(axis=1).max())
    if top == 0:
        return []
    floor = NOTHING * top
    high = top * (1 + 2.0**-40)
    positive = inertia_above(v, floor)
    k = min(k, positive)
    closest = 2.0**-44 * top

    def lowest(a: float, z: float, want: int) -> tuple[float, int]:
        """A cut between a and z above which are ``want`` or as few more as cuts allow."""
        above = inertia_above(v, a)
        while z - a > closest and above > want:
            mid = (a + z) / 2
            n = inertia_above(v, mid)
            a, z, above = (mid, z, n) if n >= want else (a, mid, above)
        return a, above

    low, total = lowest(floor, high, k)
    todo, out = [Interval(low, high, total)], []
    while todo:
        part = todo.pop()
        if part.count == 0:
            continue
        mid = (part.low + part.high) / 2
        if part.count <= most or part.high - part.low <= closest:
            out.append(part)
            continue
        upper = inertia_above(v, mid) - sum(p.count for p in out + todo if p.low >= part.high)
        todo += [Interval(part.low, mid, part.count - upper), Interval(mid, part.high, upper)]
    return sorted(out, key=lambda p: -p.high)


def feast(v: np.ndarray, part: Interval, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and unit vectors of ``v`` in an interval of known count."""
    d, norm = len(v), np.abs(v).sum(axis=1).max()
    centre, radius = (part.low + part.high) / 2, (part.high - part.low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - at)  # the upper half of the circle; the lower one is its conjugate
    size = min(d, 2 * part.count + 8)
    y = np.random.default_rng(part.count).standard_normal((d, size))
    tolerance = 2.0**-50 * norm * np.sqrt(d)
    best = None
    for _ in range(rounds):
        q = np.zeros_like(y)
        for t, w in zip(angle, weight, strict=True):
            e = radius * np.exp(1j * t)
            q += w / 2 * (e * np.linalg.solve((centre + e) * np.eye(d) - v, y)).real
        # Directions that the filter has removed are noise; those of its rank span the space.
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, s > 2.0**-44 * s[0]]
        u, _ = np.linalg.qr(u)
        ritz, mix = np.linalg.eigh(u.T @ v @ u)
        y = u @ mix
        inside = (ritz > part.low) & (ritz <= part.high)
        residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * ritz[inside], axis=0).max(initial=0)
        if inside.sum() == part.count:
            if best is None or residual < best[0]:
                best = residual, ritz[inside][::-1], y[:, inside][:, ::-1]
            elif best[0] <= 16 * tolerance:
                break  # no better than rounding allows
            if residual <= tolerance:
                break
    if best is None or best[0] > 2.0**-36 * norm:
        raise ArithmeticError(f"{part.count} eigenvalues counted between {part.low} and {part.high}, not found")
    return best[1], best[2]


def components(spark: SparkSession, v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v`` and their vectors; each interval is solved in a task."""
    parts = intervals(v, k)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                values, vectors = feast(v, Interval(p["low"], p["high"], p["count"]))
                arrays = [pa.array([p["high"]] * len(values)), pa.array(values), pa.array(vectors.T.tolist())]
                yield pa.RecordBatch.from_arrays(arrays, names=["high", "value", "vector"])

    rows = spark.createDataFrame([(p.low, p.high, p.count) for p in parts], "low double, high double, count int")
    found = rows.repartition(len(parts)).mapInArrow(solve, "high double, value double, vector array<double>").collect()
    found.sort(key=lambda r: -r["value"])
    values = np.array([r["value"] for r in found[:k]])
    return values, np.array([r["vector"] for r in found[:k]]).reshape(len(values), len(v)).T


# Passes over the vectors


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their scaled entries as longs."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == d)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
    with np.errstate(over="ignore", invalid="ignore"):
        c = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(rows), d) * SCALE)
        good = (np.abs(c) <= LARGEST).all(axis=1)
    return rows[good], c[good].astype(np.int64) + OFFSET


def _add_rows(parts: DataFrame, d: int) -> np.ndarray:
    """Sum of the matrices whose rows (at, row as d doubles in binary) the tasks gave out."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(row)
        if total:
            arrays = [pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()])]
            yield pa.RecordBatch.from_arrays(arrays, names=["at", "row"])

    out = np.zeros((d, d))
    # One row per dimension comes back, whatever the number of vectors.
    for r in parts.repartition("at").mapInArrow(add, "at int, row binary").collect():
        out[r["at"]] = np.frombuffer(r["row"])
    return out


@dataclass(frozen=True)
class Fit:
    """Number of vectors, exact sums, and components with their eigenvalues and trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs if they suffice, else Python's integers."""
        s = np.array(self.sums, object)
        top = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if top < 1 << 62:
            return self.n * x - s.astype(np.int64)
        return self.n * x.astype(object) - s

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ (self.vectors / np.sqrt(self.values))


def _squares(centred: np.ndarray) -> list[int | None]:
    top = int(np.abs(centred).max(initial=0))
    if top * top * max(centred.shape[1], 1) < 1 << 63:
        c = centred.astype(np.int64)
        return (c * c).sum(axis=1).tolist()
    found = [sum(int(e) * int(e) for e in row) for row in centred]
    return [f if f < 1 << 63 else None for f in found]


def _length(vectors: DataFrame) -> int:
    """The most frequent length, the longer one in a tie; zero if there is none."""
    sized = vectors.select(F.size("v").alias("d")).filter("d > 0").groupBy("d").count()
    found = sized.orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            _, x = _matrix(batch.column(0), d)
            n += len(x)
            # 2^10 rows of at most 2^52 + 10^6 fit a long.
            for a in range(0, len(x), 1 << 10):
                total = [t + s for t, s in zip(total, x[a : a + (1 << 10)].sum(axis=0).tolist(), strict=True)]
        arrays = [pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array(map(str, total), pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", "n", "s"])

    found = vectors.mapInArrow(part, "at int, n long, s string").groupBy("at")
    found = found.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * d
    for r in found:
        sums[r["at"]] = int(r["s"])
    return found[0]["n"] if found else 0, sums


def _scatter(vectors: DataFrame, d: int, width: int, values) -> np.ndarray:
    """Sum over all vectors of r r', with r = ``values`` of the entries of a batch."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            r = values(_matrix(batch.column(0), d)[1])
            total += r.T @ r
        arrays = [pa.array(range(width), pa.int32()), pa.array([row.tobytes() for row in total])]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", "row"])

    return _add_rows(vectors.mapInArrow(part, "at int, row binary"), width)


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Fit | None:
    """Of a frame with one column ``v``; None if no vector takes part."""
    d = _length(vectors)
    n, sums = _sums(vectors, d) if d else (0, [])
    if not n:
        return None
    still = Fit(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    v = _scatter(vectors, d, d, lambda x: still.centred(x).astype(float) / n) / n
    v = (v + v.T) / 2
    values, columns = components(vectors.sparkSession, v, k)
    return Fit(n, sums, values, columns, float(np.trace(v)))


def whiten(df: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component."""
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if vec_id.lower() in made:
        raise ValueError(f"rename {vec_id}: a column of the result has that name")
    vectors = df.select(F.col(f"`{vector}`").alias("v"))
    model = fit(vectors, k)
    own = fresh(["deviation", "all_", "v"], vec_id)
    source = df.select(F.col(f"`{vec_id}`").alias(own), F.col(f"`{vector}`").alias("v"))
    added = "deviation long, all_ array<double>"
    if model is None or not len(model.values):
        rows = source.limit(0).selectExpr(f"`{own}`", "cast(null as long) deviation", "array(0d) all_")
        model, error = Fit(0, [], np.zeros(1), np.zeros((0, 0)), 1.0), 0.0
    else:
        d, width = len(model.sums), len(model.values)
        spread = _scatter(vectors, d, width, lambda x: model.whitened(model.centred(x))) / model.n
        error = float(np.abs(spread - np.eye(width)).max())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, x = _matrix(batch.column(1), d)
                centred = model.centred(x)
                flat = pa.array(model.whitened(centred).ravel())
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
                arrays = [batch.column(0).take(pa.array(rows)), pa.array(_squares(centred), pa.int64()),
                          pa.ListArray.from_arrays(ends, flat)]
                yield pa.RecordBatch.from_arrays(arrays, names=[own, "deviation", "all_"])

        rows = source.mapInArrow(run, StructType([source.schema[own], *StructType.fromDDL(added).fields]))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return rows.select(own, "deviation", F.posexplode("all_").alias("at_", "whitened")).select(
        F.col(own).alias(vec_id),
        (F.col("at_") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at_")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
