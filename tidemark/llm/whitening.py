"""Embedding whitening by incremental eigendecomposition.

Every task keeps the eigenvalues and eigenvectors of the scatter of its vectors around their running mean, and each vector is
one centred rank-one update of them: the new eigenvalues are the roots of a secular equation, entries with nothing to update and
equal eigenvalues are deflated (Golub 1973, Bunch, Nielsen and Sorensen 1978), and the vectors come from recomputed weights (Gu and
Eisenstat 1994). Spectra of tasks are combined in a tree, each by one rank-one update per eigenvector and one for the distance of the means. The
basis found serves a last pass over all vectors, which projects their covariance, centred by exact sums of integers, and solves
the small problem that is left (Rayleigh-Ritz); as the basis is complete, its solution is that of the covariance.

Tasks and driver hold a few matrices as wide as a vector is long, whatever the number of vectors; an update costs the third power of that length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

EPS = np.finfo(float).eps
FAN = 8
SAFE = 1 << 62


def secular_roots(d: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (d - x)) = 0`` for rising ``d`` and positive weights, one right of each pole.

    Returns them and the matrix ``root j - d[i]``, each difference to full relative precision: roots are sought as distances from the nearer
    pole. Steps are those of the two-pole rational model; one that leaves the bracket is replaced by a bisection.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + weights.sum())
    gap = right - d
    apart = d[:, None] - d[None, :]
    at_left = np.arange(k)[:, None] <= np.arange(k)[None, :]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + np.sum(weights[:, None] / (apart - gap / 2), axis=0)
        from_right = (middle < 0) & (np.arange(k) < k - 1)
        origin = np.where(from_right, right, d)
        apart = d[:, None] - origin[None, :]
        low = np.where(from_right, -gap / 2, 0.0)
        high = np.where(from_right, 0.0, np.where(middle < 0, gap, gap / 2))
        low = np.where(~from_right & (middle < 0), gap / 2, low)
        x = (low + high) / 2
        left, other = d - origin, right - origin
        for _ in range(120):
            inverse = 1 / (apart - x)
            f = 1 + weights @ inverse
            below = f < 0
            low, high = np.where(below, x, low), np.where(below, high, x)
            near = np.abs(f) <= EPS * k * (1 + weights @ np.abs(inverse))
            done = near | (high - low <= 2 * EPS * np.minimum(np.abs(low), np.abs(high)))
            if done.all():
                break
            to_left, to_right = left - x, other - x
            inverse *= inverse
            slope = weights @ inverse
            inverse *= at_left
            slope_left = weights @ inverse
            c = f - to_left * slope_left - to_right * (slope - slope_left)
            a = (to_left + to_right) * f - to_left * to_right * slope
            b = to_left * to_right * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
            inside = (new > low) & (new < high)
            x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return origin + x, x - apart


class Spectrum:
    """Number, mean and scatter of vectors of one length; the scatter as rising ``values`` and orthonormal ``vectors`` (columns)."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def update(self, rho: float, v: np.ndarray) -> None:
        """Add ``rho * v v'`` to the scatter, ``rho`` not negative."""
        length = np.linalg.norm(v)
        rho = rho * length * length
        if not rho > 0:
            return
        z = self.vectors.T @ (v / length)
        tiny = 8 * EPS * max(self.values[-1], rho)
        # Within a run of equal eigenvalues any basis will do: a reflection leaves one vector with a share of the update.
        start = 0 if np.any(np.diff(self.values) <= tiny) else len(z)
        while start < len(z):
            stop = int(np.searchsorted(self.values, self.values[start] + tiny, side="right"))
            run = z[start:stop]
            if stop - start > 1 and np.any(run[:-1]):
                mirror = run.copy()
                mirror[-1] += np.copysign(np.linalg.norm(run), run[-1])
                mirror /= np.linalg.norm(mirror)
                part = self.vectors[:, start:stop]
                self.vectors[:, start:stop] = part - 2 * np.outer(part @ mirror, mirror)
                z[start:stop] = run - 2 * (mirror @ run) * mirror
                z[start:stop - 1] = 0
            start = stop
        live = np.flatnonzero(rho * np.abs(z) > tiny)
        if not len(live):
            return
        d = self.values[live]
        roots, differences = secular_roots(d, rho * z[live] ** 2)
        own = np.diagonal(differences).copy()
        poles = d[None, :] - d[:, None]
        np.fill_diagonal(poles, 1.0)
        ratios = differences / poles
        np.fill_diagonal(ratios, 1.0)
        weights = np.sqrt(np.abs(own * ratios.prod(axis=1))) * np.where(z[live] < 0, -1.0, 1.0)
        turned = weights[:, None] / -differences
        turned /= np.linalg.norm(turned, axis=0)
        values, vectors = self.values.copy(), self.vectors
        values[live] = roots
        vectors[:, live] = vectors[:, live] @ turned
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def add(self, x: np.ndarray) -> None:
        """One vector more: its distance from the mean so far is a rank-one update."""
        away = x - self.mean
        self.update(self.n / (self.n + 1), away)
        self.n += 1
        self.mean += away / self.n

    def merge(self, other: Spectrum) -> None:
        """The vectors of ``other`` too, by one update for each of its eigenvectors and one for the distance of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(value, vector)
        both = self.n + other.n
        away = other.mean - self.mean
        self.update(self.n * other.n / both, away)
        self.mean += away * (other.n / both)
        self.n = both


class Whitening(NamedTuple):
    """What is known of the vectors of one length: ``components`` are columns, by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None


def fixed_point(vectors: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``(vec_id, x)`` of ``vectors(vec_id, embedding)``: each entry as ``floor(scale * entry) + shift``, a long.

    Rows without a vector, or with missing or non-finite entries, are left out. Entries of 2^60 or more are held at that size.
    """
    numbers = F.transform("embedding", lambda c: c.cast("double"))
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    limit = F.lit(float(1 << 60))
    return vectors.where(fit).select("vec_id", F.transform(numbers, lambda c: F.floor(
        F.greatest(F.least(c * scale, limit), -limit)) + shift).alias("x"))


def _by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of each length in a batch."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    offsets = np.asarray(x.offsets, np.int64)
    flat = np.asarray(x.values, np.int64)
    lengths = np.diff(offsets)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        yield size, rows, flat[offsets[rows][:, None] + np.arange(size)]


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """``x`` as integers that can be multiplied by ``factor``: Python's own where 64 bits would not do."""
    return x if int(np.abs(x).max(initial=0)) * factor < SAFE else x.astype(object)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly."""
    most = max([int(np.abs(x).max(initial=0)) * n, *map(abs, sums)])
    return x * n - np.array(sums) if 2 * most < SAFE else x.astype(object) * n - np.array(sums, object)


_PARTIAL = "size int, part long, n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"
_MATRIX = "size int, part long, n long, mean array<double>, matrix array<double>"


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<decimal(38,0)>": pa.list_(pa.decimal128(38, 0))}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.table({name: pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields})


def _tree(parts: DataFrame, merge: Callable[[list[dict]], dict], ddl: str, name: str) -> list[dict]:
    """One row per ``size``: rows are merged in groups of neighbours, by part, until one is left."""
    parts = materialize(parts, name)
    last = parts.agg(F.max("part")).first()[0] or 0

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return _table([merge(rows) | {"size": rows[0]["size"], "part": rows[0]["part"] // FAN}], ddl)

    while last:
        parts = materialize(parts.groupBy("size", F.expr(f"part div {FAN}").alias("of")).applyInArrow(run, ddl), name)
        last //= FAN
    return [r.asDict() for r in parts.toLocalIterator()]


def _spectra(points: DataFrame) -> dict[int, dict]:
    """Basis, number and exact sums of all vectors, by length."""
    def run(batches):
        found: dict[int, tuple[Spectrum, list[int]]] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                spectrum, sums = found.setdefault(size, (Spectrum(size), [0] * size))
                sums[:] = [a + int(b) for a, b in zip(sums, _exact(x, len(x)).sum(axis=0))]
                for row in x.astype(float):
                    spectrum.add(row)
        rows = [{"size": size, "part": TaskContext.get().partitionId(), "n": s.n, "sums": list(map(Decimal, sums)), "mean": s.mean,
                 "values": s.values, "vectors": s.vectors.ravel()} for size, (s, sums) in found.items()]
        yield from _table(rows, _PARTIAL).to_batches()

    def merge(rows: list[dict]) -> dict:
        whole, sums = None, None
        for r in rows:
            s = Spectrum(0)
            s.n, s.mean, s.values = r["n"], np.array(r["mean"]), np.array(r["values"])
            s.vectors = np.array(r["vectors"]).reshape(len(s.mean), -1)
            if whole is None:
                whole, sums = s, r["sums"]
            else:
                whole.merge(s)
                sums = [a + b for a, b in zip(sums, r["sums"])]
        return {"n": whole.n, "sums": sums, "mean": whole.mean, "values": whole.values, "vectors": whole.vectors.ravel()}

    found = _tree(points.select("x").mapInArrow(run, _PARTIAL), merge, _PARTIAL, "whitening-spectra")
    return {r["size"]: {"n": r["n"], "sums": [int(s) for s in r["sums"]],
                        "basis": np.linalg.qr(np.array(r["vectors"]).reshape(r["size"], -1))[0]} for r in found}


def _covariances(points: DataFrame, project: dict[int, Callable[[np.ndarray], np.ndarray]], name: str) -> dict[int, np.ndarray]:
    """Covariance of the projected vectors, by length; every batch is centred by its own mean before it is multiplied."""
    def joined(a: dict | None, n: int, mean: np.ndarray, matrix: np.ndarray) -> dict:
        if a is None:
            return {"n": n, "mean": mean, "matrix": matrix}
        away, both = mean - a["mean"], a["n"] + n
        return {"n": both, "mean": a["mean"] + away * (n / both), "matrix": a["matrix"] + matrix + np.outer(away, away) * (a["n"] * n / both)}

    def run(batches):
        found: dict[int, dict] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                y = project[size](x)
                mean = y.mean(axis=0)
                found[size] = joined(found.get(size), len(y), mean, (y - mean).T @ (y - mean))
        part = TaskContext.get().partitionId()
        rows = [r | {"size": size, "part": part, "matrix": r["matrix"].ravel()} for size, r in found.items()]
        yield from _table(rows, _MATRIX).to_batches()

    def merge(rows: list[dict]) -> dict:
        whole = None
        for r in rows:
            mean = np.array(r["mean"])
            whole = joined(whole, r["n"], mean, np.array(r["matrix"]).reshape(len(mean), len(mean)))
        return whole | {"matrix": whole["matrix"].ravel()}

    found = _tree(points.select("x").mapInArrow(run, _MATRIX), merge, _MATRIX, name)
    return {r["size"]: np.array(r["matrix"]).reshape(len(r["mean"]), len(r["mean"])) / r["n"] for r in found}


def _centred(n: int, sums: list[int], directions: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: (_deviations(x, n, sums) / n).astype(float) @ directions


def fit(points: DataFrame, components: int = 8) -> dict[int, Whitening]:
    """Means, components and variances of all vectors of ``points(x)``, arrays of longs, for each length of vectors by itself.

    There are as many components as asked for, or as vectors are long. A component without variance is not whitened; if no
    component has any, there is no identity error. Repeated vectors count as often as they occur; no rows give no fit.
    """
    spectra = _spectra(points)
    ritz = _covariances(points, {size: _centred(s["n"], s["sums"], s["basis"]) for size, s in spectra.items()}, "whitening-ritz")
    fitted = {}
    for size, s in spectra.items():
        values, turned = np.linalg.eigh((ritz[size] + ritz[size].T) / 2)
        top = np.argsort(values, kind="stable")[::-1][:components]
        total = np.trace(ritz[size])
        variances = np.where(values[top] > size * EPS * values.max(initial=0), values[top], 0.0)
        fitted[size] = Whitening(s["n"], s["sums"], s["basis"] @ turned[:, top], variances,
                                 variances / total if total > 0 else np.zeros(len(top)), None)
    whole = _covariances(points, {size: _centred(w.n, w.sums, _directions(w)[:, w.variances > 0]) for size, w in fitted.items()}, "whitening-identity")
    errors = {size: float(np.abs(c - np.eye(len(c))).max()) if len(c) else None for size, c in whole.items()}
    return {size: w._replace(identity_error=errors[size]) for size, w in fitted.items()}


def _directions(w: Whitening) -> np.ndarray:
    return np.divide(w.components, np.sqrt(w.variances), out=np.zeros_like(w.components), where=w.variances > 0)


def whiten(points: DataFrame, fitted: dict[int, Whitening]) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)`` for every vector and component.

    ``deviation`` is null where it is beyond the range of a long; ``deviation_exact`` is a decimal, null from 10^38 on. ``whitened`` is null for a
    component without variance. Vectors without entries have no component and give no row; a missing id stays missing, rows that
    share an id stay apart; ties between equal variances are settled once for all rows; other columns are left out.
    """
    kind = points.schema["vec_id"].dataType.simpleString()
    ddl = (f"vec_id {kind}, component int, n long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    names = [f.split(" ")[0] for f in ddl.split(", ")]
    directions = {size: _directions(w) for size, w in fitted.items()}

    def run(batches):
        for batch in batches:
            for size, rows, x in _by_length(batch.column(1)):
                w = fitted[size]
                away = _deviations(x, w.n, w.sums)
                k = len(w.variances)
                squares = _exact(away, int(np.abs(away).max(initial=0)) * size)
                squares = (squares * squares).sum(axis=1)
                exact = pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                white = ((away / w.n).astype(float) @ directions[size]).ravel()
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                    pa.array(np.full(len(white), w.n), pa.int64()), pa.array(white, mask=np.tile(w.variances <= 0, len(rows))),
                    pa.array(np.tile(w.explained, len(rows))), pa.array([w.identity_error] * len(white), pa.float64()), exact.take(each)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = points.select("vec_id", "x").mapInArrow(run, ddl)
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation_exact as bigint)").alias("deviation"), "whitened", "explained",
                       "identity_error", "deviation_exact")
