"""Whitening of embeddings: incremental eigendecomposition by rank-one updates, spectra combined, Rayleigh-Ritz refinement."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bound_batches, materialize

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Whole numbers are clipped here, where a double holds them exactly.
MOST = 1 << 52
#: Spectra of so many tasks are combined in one task of the next round.
FAN_IN = 16
EPS = np.finfo(float).eps


def secular(lam: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(lam) + rho z z^T and the differences lam[k] - value[j], for rising distinct lam, z without zeros, rho > 0.

    Each root lies between two poles and is found as its offset from the nearer one, all roots at once: the secular function
    is replaced by a rational one with the same two poles, value and slopes, and a step that leaves the bracket halves it.
    """
    n, w = len(lam), rho * z * z
    top = lam[-1] + w.sum()
    right = np.append(lam[1:], top)
    middle = lam + (right - lam) / 2
    below = np.triu(np.ones((n, n)))  # [k, j]: pole k lies at or below root j
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + (w[:, None] / (lam[:, None] - middle)).sum(axis=0)
        near_right = at_middle < 0
        near_right[-1] = False
        origin = np.where(near_right, right, lam)
        delta = lam[:, None] - origin  # poles seen from each root's origin
        at = np.arange(n)
        left_pole, right_pole = delta[at, at], right - origin
        lo = np.where(near_right, (lam - right) / 2, 0.0)
        hi = np.where(near_right, 0.0, np.append((right - lam)[:-1] / 2, w.sum()))
        tau = (lo + hi) / 2
        for _ in range(60):
            d = delta - tau
            t = w[:, None] / d
            every, under = np.einsum("kj->j", t), np.einsum("kj,kj->j", t, below)  # terms of poles below are negative, others positive
            f = 1 + every
            lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
            done = (np.abs(f) <= 8 * n * EPS * (1 + every - 2 * under)) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            t /= d
            psi = np.einsum("kj,kj->j", t, below)
            phi = np.einsum("kj->j", t) - psi
            dl, dr = left_pole - tau, right_pole - tau
            a, b, c = (dl + dr) * f - dl * dr * (psi + phi), dl * dr * f, f - dl * psi - dr * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = tau + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            tau = np.where(done, tau, np.where((step > lo) & (step < hi), step, (lo + hi) / 2))
    return origin + tau, delta - tau


def rank_one(lam: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of vectors diag(lam) vectors^T + rho v v^T.

    Deflation: directions of v too small to matter keep their pair; of nearly equal eigenvalues a reflection
    leaves v one direction, so only distinct poles reach the secular equation.
    """
    z = vectors.T @ v
    size = rho * (z @ z)
    if not size > 0:
        return lam, vectors
    tol = 8 * EPS * max(abs(lam[0]), abs(lam[-1]), size)
    close = np.diff(lam) <= tol
    if close.any():
        vectors, z = vectors.copy(), z.copy()
        edges = np.flatnonzero(np.diff(np.r_[False, close, False]))
        for a, b in zip(edges[::2], edges[1::2] + 1, strict=True):  # lam[a:b] are nearly equal
            own = z[a:b].copy()
            long = np.sqrt(own @ own)
            if long > 0:
                mirror = own.copy()
                mirror[-1] += np.copysign(long, own[-1])
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, mirror) * (2 / (mirror @ mirror))
                z[a:b] = 0
                z[b - 1] = -np.copysign(long, own[-1])
    live = rho * np.abs(z) * np.sqrt(z @ z) > tol
    if not live.any():
        return lam, vectors
    poles = lam[live]
    values, gaps = secular(poles, z[live], rho)
    # z anew from the roots, for which these are the exact eigenvalues; so the vectors are orthogonal
    n = len(poles)
    apart = poles[:, None] - poles
    shifted = np.where(np.arange(n)[:, None] <= np.arange(n), np.roll(apart, -1, axis=1), apart)  # [k, j]: pole k less pole j, or j + 1 from k on
    shifted[:, -1] = -1.0
    exact = np.sqrt(np.abs((gaps / shifted).prod(axis=1)))
    turn = exact[:, None] / gaps
    turn *= np.sign(z[live])[:, None]
    turn /= np.sqrt((turn * turn).sum(axis=0))
    lam, vectors = lam.copy(), vectors.copy()
    lam[live], vectors[:, live] = values, vectors[:, live] @ turn
    if (np.diff(lam) < 0).any():
        order = np.argsort(lam, kind="stable")
        lam, vectors = lam[order], vectors[:, order]
    return lam, vectors


class Spectrum:
    """Count, exact sums, and the eigenpairs of the scatter about the mean of what was added."""

    def __init__(self, size: int):
        self.n, self.sums, self.lam, self.vectors = 0, [0] * size, np.zeros(size), np.eye(size)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates by rows: each one's distance from the mean so far, times n / (n + 1).

        More rows than dimensions are first turned by an orthogonal transformation (QR about their own mean) into as many rows as
        dimensions, of the same scatter; these give an update each, and the distance of the means one more.
        """
        before, m, size = self.n, len(rows), len(self.sums)
        if m > size:
            own = rows.mean(axis=0)
            away = own - self.mean()
            for v in np.linalg.qr(rows - own, mode="r"):
                self.lam, self.vectors = rank_one(self.lam, self.vectors, v, 1.0)
            if before:
                self.lam, self.vectors = rank_one(self.lam, self.vectors, away, before * m / (before + m))
        else:
            at = self.mean()
            for i, x in enumerate(rows, before):
                away = x - at
                if i:
                    self.lam, self.vectors = rank_one(self.lam, self.vectors, away, i / (i + 1))
                at = at + away / (i + 1)
        self.n += m
        exact = rows if np.abs(rows).max(initial=0) < 1 << 40 else rows.astype(object)
        self.sums = [a + int(b) for a, b in zip(self.sums, exact.sum(axis=0), strict=True)]

    def join(self, other: Spectrum) -> None:
        """A rank-one update for each eigenpair of the other, and one for the distance of the means."""
        if not other.n:
            return
        if self.n:
            for value, v in zip(other.lam, other.vectors.T, strict=True):
                if value > 0:
                    self.lam, self.vectors = rank_one(self.lam, self.vectors, v, float(value))
            self.lam, self.vectors = rank_one(self.lam, self.vectors, other.mean() - self.mean(), self.n * other.n / (self.n + other.n))
        else:
            self.lam, self.vectors = other.lam, other.vectors
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "lam": self.lam.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row) -> Spectrum:
        out = cls(len(row.sums))
        out.n, out.sums = int(row.n), [int(s) for s in row.sums]
        out.lam, out.vectors = np.array(row.lam, float), np.array(row.vectors, float).reshape(len(out.sums), -1)
        return out


_FIELDS = "n long, sums array<string>, lam array<double>, vectors array<double>"


def whole(vectors: pa.ListArray, size: int) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry; shorter vectors end in zeros."""
    flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    flat = flat[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * out), -MOST, MOST).astype(np.int64) + OFFSET


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles) without rows whose vector is null or holds null or non-finite entries."""
    sound = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull()).where(F.coalesce(sound, F.lit(False)))


def spectrum(rows: DataFrame, size: int) -> Spectrum:
    """The spectrum of all rows (column _v): one for each task, then of FAN_IN spectra one, until one is left."""

    def fit(batches):
        own = Spectrum(size)
        for b in batches:
            own.add(whole(b.column(0), size))
        if own.n:
            got = own.row()
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in got.items()}, schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("lam", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = Spectrum(size)
        for row in frame.sort_values("part").itertuples():
            total.join(Spectrum.of(row))
        return pd.DataFrame([{"part": int(frame["part"].min()) // FAN_IN} | total.row()])

    bound_batches(rows.sparkSession)
    parts = rows.select("_v").mapInArrow(fit, _FIELDS).select(F.spark_partition_id().cast("long").alias("part"), "*")
    parts = materialize(parts)
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, f"part long, {_FIELDS}")
        most //= FAN_IN
    found = parts.collect()  # one row
    return Spectrum.of(found[0]) if found else Spectrum(size)


def _summed(rows: DataFrame, size: int, features) -> np.ndarray:
    """Sums over all rows of the products of their features, a symmetric matrix; features turns whole vectors into an array."""

    def products(batches):
        total = None
        for b in batches:
            y = features(whole(b.column(0), size))
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            at = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": at[0], "j": at[1], "s": total[at]}, schema=pa.schema([("i", pa.int64()), ("j", pa.int64()), ("s", pa.float64())]))

    got = rows.select("_v").mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # size * (size + 1) / 2 rows
    out = np.zeros((1 + max((r.j for r in got), default=-1),) * 2)
    for r in got:
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def fit(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> dict:
    """n, exact sums, eigenvalues, components (columns), trace and the rows used; see whiten."""
    used = usable(rows, id_col, vec_col)
    size = used.agg(F.max(F.size("_v"))).first()[0] or 0
    if not size:
        return {"n": used.count(), "sums": [], "values": np.zeros(0), "vectors": np.zeros((0, 0)), "trace": 0.0, "rows": used, "size": 0}
    start = spectrum(used, size)
    n, sums, basis = start.n, start.sums, start.vectors
    away = centring(n, sums)
    ritz = _summed(used, size, lambda x: away(x) @ basis) / n  # the covariance seen in the basis, which is turned to its own axes
    values, turn = np.linalg.eigh(ritz)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = basis @ turn[:, order]
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    values = np.where(values > 16 * size * EPS * max(np.trace(ritz), 0.0), values, 0.0)[order]
    return {"n": n, "sums": sums, "values": values, "vectors": vectors, "trace": float(np.trace(ritz)), "rows": used, "size": size}


def centring(n: int, sums: list[int]):
    """A function from whole vectors to their distances from the mean as doubles, from the exact n x - S where 64 bits hold it."""
    small = n * (MOST >> 20) < 1 << 62 and all(abs(s) < 1 << 62 for s in sums)
    fixed = np.array(sums, np.int64 if small else object)

    def away(x: np.ndarray) -> np.ndarray:
        return exact(x).astype(float) / n

    def exact(x: np.ndarray) -> np.ndarray:
        if small and np.abs(x).max(initial=0) <= MOST >> 20:
            return n * x - fixed
        return n * x.astype(object) - np.array(sums, object)

    away.exact = exact
    return away


def deviations(exact: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; null where a long doesn't hold it."""
    if exact.dtype != object and np.abs(exact).max(initial=0).astype(float) ** 2 * max(1, exact.shape[1]) < 2**62:
        return (exact * exact).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in exact)]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    x is floor(1024 c) + 100000 of each entry c (clipped at 2^52 in size), S the sums of x; deviation is the exact sum of
    (n x - S)^2, null where it exceeds a long. Components are the first eigenvectors of the covariance of all x by falling eigenvalue,
    each with its largest entry positive. Every task makes a rank-one update for each of its rows, spectra are combined by
    rank-one updates in rounds, and the covariance in the basis so found is summed over all rows and
    solved, which gives the vectors to double precision. identity_error is measured over all rows again.

    Rows of null vectors or with null, NaN or infinite entries are left out; ids may be null or repeat. Shorter vectors count as ending
    in entries of 0. A component without variance (fewer distinct rows than components) has null whitened values and takes no part
    in identity_error; explained is null where nothing varies. No usable rows or only empty vectors: no rows.
    """
    model = fit(rows, components, id_col, vec_col)
    kind = dict(rows.dtypes)[id_col]
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    spark = rows.sparkSession
    if not model["size"]:
        return spark.createDataFrame([], schema).toDF(*names)
    n, sums, values, vectors, size = (model[k] for k in ("n", "sums", "values", "vectors", "size"))
    live = np.flatnonzero(values > 0)
    scaled = vectors[:, live] / np.sqrt(values[live])
    away = centring(n, sums)
    sums_of = _summed(model["rows"], size, lambda x: np.c_[np.ones(len(x)), away(x) @ scaled]) / n
    error = float(np.abs(sums_of[1:, 1:] - np.outer(sums_of[0, 1:], sums_of[0, 1:]) - np.eye(len(live))).max(initial=0.0))
    share = [float(v / model["trace"]) if model["trace"] > 0 else None for v in values]
    count = len(values)

    def run(batches):
        for b in batches:
            m = b.num_rows
            exact = away.exact(whole(b.column(1), size))
            y = np.full((m, count), np.nan)
            y[:, live] = (exact.astype(float) / n) @ scaled
            each = np.repeat(np.arange(m), count)
            flat = y.ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n)), pa.array(deviations(exact), pa.int64()).take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)), pa.array(share * m, pa.float64()), pa.array(np.full(m * count, error))],
                names=["_id", *names[1:]],
            )

    return model["rows"].mapInArrow(run, schema).toDF(*names)
