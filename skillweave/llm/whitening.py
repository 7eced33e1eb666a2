"""Operator 13: embedding whitening by a one-sided Jacobi singular value decomposition.

The distinct integer vectors are the fit list. Tasks reduce their centred rows to triangular factors block by block (TSQR),
factors are merged in groups of a bounded fan until one is left, and plane rotations make that factor's columns orthogonal:
the accumulated rotations are the components, the columns' lengths the singular values. No covariance matrix is formed, so
small deviations keep their digits. Rows travel once, to find the distinct ones; sums, factors and models are of the
width's size, whatever the number of rows. A copy held by any share of the rows goes before the shuffle, task by task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import folded, stored, table
from skillweave.llm.topk_search import finite

COMPONENTS = 4
#: Steps of one unit of a component.
SCALE = 256
#: Bytes of rows that are reduced at once, and of factors that are merged at once.
BLOCK_BYTES = 1 << 22
FOLD_BYTES = 1 << 26
SWEEPS = 60
_PART = "place long, body binary"


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows that take part: x is floor(scale * component) of every component, as long.

    Rows whose vector is null, empty or holds a null or non-finite component, or one that no long can hold, take no part.
    """
    scaled = F.transform("embedding", lambda c: c.cast("double") * scale)
    fits = F.forall(scaled, lambda c: (c >= float(-(2**63))) & (c < float(2**63)))
    good = finite(F.col("embedding")) & (F.size("embedding") > 0)
    return rows.select("vec_id", "embedding").filter(good).filter(F.coalesce(fits, F.lit(False))).select("vec_id", F.transform(scaled, lambda c: F.floor(c)).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


class Centre:
    """n and the sums of the fit list; what lies off the mean is counted in n-ths, as whole numbers."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.most = n, sums, n * most + max(map(abs, sums), default=0)

    def off(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: Python integers where 64 bits may not hold them."""
        if self.most < 2**63:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.off(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The exact sum of squares of off(x) for each row; null where no long holds it."""
        d = self.off(x)
        if self.most**2 * max(1, x.shape[1]) < 2**63:
            return pa.array((d * d).sum(1), pa.int64())
        return pa.array([v if (v := sum(int(c) ** 2 for c in row)) < 2**63 else None for row in d], pa.int64())


def centre_of(fit: DataFrame, width: int) -> Centre:
    """n and exact sums of fit (x), added up in each task first; the driver gets one row for each dimension."""

    def run(batches):
        n, most, sums = 0, 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            if len(x):
                high = max(int(x.max()), -int(x.min()))
                n, most = n + len(x), max(most, high)
                sums += (x.sum(0) if high * len(x) < 2**63 else x.astype(object).sum(0)).astype(object)
        out = [(i, n, str(int(s)), str(most)) for i, s in enumerate(sums)] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, [pa.int64(), pa.int64(), pa.string(), pa.string()])], ["i", "n", "s", "most"])

    whole = lambda c: F.col(c).cast("decimal(38,0)")
    parts = fit.mapInArrow(run, "i long, n long, s string, most string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(whole("s")).alias("s"), F.max(whole("most")).alias("most")).orderBy("i").collect()
    return Centre(rows[0].n, [int(r.s) for r in rows], int(rows[0].most))


def _reduced(width: int, centre: Centre):
    """One triangular factor of the centred rows of a task."""
    step = max(width, BLOCK_BYTES // (8 * width))

    def run(batches):
        r = np.zeros((0, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), step):
                r = np.linalg.qr(np.vstack([r, centre.centred(x[at : at + step])]), mode="r")
        out = [(TaskContext.get().partitionId(), np.ascontiguousarray(r).tobytes())] if len(r) else []
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["place", "body"])

    return run


def _stacked(width: int):
    def merge(bodies: list[bytes]) -> bytes:
        r = np.zeros((0, width))
        for b in bodies:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(b).reshape(-1, width)]), mode="r")
        return np.ascontiguousarray(r).tobytes()

    return merge


def pairings(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of n columns in which every pair meets once: one stands, the others move around."""
    m = n + n % 2
    ring = list(range(1, m))
    out = []
    for _ in range(m - 1):
        seats = [0, *ring]
        pairs = [(min(p), max(p)) for p in zip(seats[: m // 2], reversed(seats[m // 2 :])) if max(p) < n]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(r: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns, by plane rotations of r's columns."""
    n = r.shape[1]
    a, v = np.vstack([r, np.zeros((max(0, n - len(r)), n))]), np.eye(n)
    tiny = np.finfo(float).eps * n**0.5
    rounds = pairings(n) if n > 1 else []
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > tiny * np.sqrt(xx) * np.sqrt(yy)
            if not on.any():
                continue
            turned = True
            p, q, xx, yy, xy = p[on], q[on], xx[on], yy[on], xy[on]
            slope = (yy - xx) / (2 * xy)
            t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1.0, slope))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order] / np.sqrt((v * v).sum(0))[order]


_MODEL = "sigma binary, v binary"


def decomposed(fit: DataFrame, width: int, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and components (columns) of the centred fit list: TSQR, then rotations in one task."""
    parts = fit.mapInArrow(_reduced(width, centre), _PART)
    whole = folded(parts, _stacked(width), fan=max(2, min(64, FOLD_BYTES // (8 * width * width))))

    def run(batches):
        for batch in batches:
            out = [jacobi(np.frombuffer(b).reshape(-1, width)) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x[i]).tobytes() for x in out], pa.binary()) for i in (0, 1)], ["sigma", "v"])

    row = whole.mapInArrow(run, _MODEL).collect()[0]
    return np.frombuffer(row.sigma), np.frombuffer(row.v).reshape(width, -1)


def _moments(width: int, k: int, white):
    """(n, mean, centred products) of a task's whitened rows, merged block by block."""

    def run(batches):
        body = None
        for batch in batches:
            w = white(_matrix(batch.column(0), width))
            if len(w):
                mean = w.mean(0)
                one = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes()
                body = one if body is None else _joined(k)([body, one])
        out = [(TaskContext.get().partitionId(), body)] if body else []
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["place", "body"])

    return run


def _joined(k: int):
    def merge(bodies: list[bytes]) -> bytes:
        n, mean, prod = 0.0, np.zeros(k), np.zeros((k, k))
        for b in bodies:
            x = np.frombuffer(b)
            m, other, more = x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k)
            d = other - mean
            prod = prod + more + np.outer(d, d) * (n * m / (n + m))
            mean, n = mean + d * (m / (n + m)), n + m
        return np.concatenate([[n], mean, prod.ravel()]).tobytes()

    return merge


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, embedding).

    A row for each vector that takes part (see integers) and each of the first components, numbered from 1 by falling
    eigenvalue. The fit list has each distinct integer vector once. Components whose deviation is zero to double precision
    are left out, so a table of one distinct vector gives no rows, as an empty one does. Rows that repeat, with or without
    vec_id, are rows of their own. Vectors of different widths are whitened apart. deviation is null where no long holds
    it. Other columns are ignored.
    """
    rows = integers(rows, scale)
    fits = stored(rows.select("x").distinct(), "fit")
    widths = [r.width for r in fits.select(F.size("x").alias("width")).distinct().orderBy("width").collect()]
    kind = f"vec_id {dict(rows.dtypes)['vec_id']}, {WHITENED}"
    out = None
    for width in widths:
        one = _whitened(rows.filter(F.size("x") == width), fits.filter(F.size("x") == width), width, components, kind)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.sparkSession.createDataFrame([], kind)


def _whitened(rows: DataFrame, fit: DataFrame, width: int, components: int, kind: str) -> DataFrame:
    centre = centre_of(fit, width)
    sigma, v = decomposed(fit, width, centre)
    n, trace = centre.n, float((sigma * sigma).sum())
    k = min(components, int((sigma > sigma[0] * width * np.finfo(float).eps).sum()))
    explained = sigma[:k] ** 2 / trace if k else np.zeros(0)
    axes = v[:, :k] * (n**0.5 / sigma[:k])
    white = lambda x: centre.centred(x) @ axes
    if k:
        body = folded(fit.mapInArrow(_moments(width, k, white), _PART), _joined(k)).collect()[0].body
        error = float(np.abs(np.frombuffer(body)[k + 1 :].reshape(k, k) / n - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x) * k
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(m, n, np.int64)),
                centre.deviation(x).take(each),
                pa.array(white(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(m, error if k else 0.0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kind.split(", ")])

    return rows.mapInArrow(run, kind)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
