"""Graph-signal processing. What quadratic forms express runs in SQL; eigenvectors only in grouped kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IncompleteSignal, InvalidFilterParameter
from .graph import degrees
from .tasks import spread

#: Instants that a task takes of one zone.
BLOCK = 4096


def laplacian(points: DataFrame, links: DataFrame) -> DataFrame:
    """(zone, i, j, value): D - A as coordinates, the diagonal included."""
    deg = points.select("zone", "idx").join(degrees(links), ["zone", "idx"], "left").fillna(0.0, ["degree"])
    off = links.select("zone", F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("value"))
    return off.union(deg.select("zone", "idx", "idx", "degree"))


def laplacian_norm(links: DataFrame) -> DataFrame:
    """(zone, i, j, value): I - D^-1/2 A D^-1/2 as coordinates; only nodes with neighbours."""
    deg = degrees(links)
    a, b = deg.select("zone", F.col("idx").alias("src"), F.col("degree").alias("ds")), deg.select("zone", F.col("idx").alias("dst"), F.col("degree").alias("dd"))
    off = links.join(a, ["zone", "src"]).join(b, ["zone", "dst"])
    off = off.select("zone", F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("value"))
    return off.union(deg.select("zone", "idx", "idx", F.lit(1.0)))


def dirichlet(signal: DataFrame, links: DataFrame, normalised: bool = True) -> DataFrame:
    """(zone, t, energy): x'Lx as a sum over undirected edges. ``signal`` is (zone, t, idx, value)."""
    lines = links.where("src < dst")
    x = signal
    if normalised:
        x = signal.join(degrees(links), ["zone", "idx"]).withColumn("value", F.col("value") / F.sqrt("degree"))
    a, b = x.select("zone", "t", F.col("idx").alias("src"), F.col("value").alias("va")), x.select("zone", "t", F.col("idx").alias("dst"), F.col("value").alias("vb"))
    rows = lines.join(a, ["zone", "src"]).join(b, ["zone", "t", "dst"])
    return rows.groupBy("zone", "t").agg(F.sum(F.col("weight") * (F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb"))).alias("energy"))


def centred(signal: DataFrame) -> DataFrame:
    mean = signal.groupBy("zone", "t").agg(F.avg("value").alias("m"))
    return signal.join(mean, ["zone", "t"]).select("zone", "t", "idx", (F.col("value") - F.col("m")).alias("value"))


def project_kernel(signal: DataFrame, links: DataFrame) -> DataFrame:
    """The signal without its part along sqrt(degree), the kernel of the normalised Laplacian of a connected zone."""
    x = signal.join(degrees(links), ["zone", "idx"])
    part = x.groupBy("zone", "t").agg((F.sum(F.col("value") * F.sqrt("degree")) / F.sum("degree")).alias("c"))
    return x.join(part, ["zone", "t"]).select("zone", "t", "idx", (F.col("value") - F.col("c") * F.sqrt("degree")).alias("value"))


def local_residual(signal: DataFrame, links: DataFrame) -> DataFrame:
    """(zone, t, idx, residual): each node's value less the weighted mean of its neighbours'."""
    around = links.join(signal.select("zone", "t", F.col("idx").alias("dst"), "value"), ["zone", "dst"])
    mean = around.groupBy("zone", "t", F.col("src").alias("idx")).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("m"))
    return signal.join(mean, ["zone", "t", "idx"]).select("zone", "t", "idx", (F.col("value") - F.col("m")).alias("residual"))


# --- dense kernels, one zone at a time ---


def matrix(pdf: pd.DataFrame, n: int) -> np.ndarray:
    a = np.zeros((n, n))
    a[pdf["src"], pdf["dst"]] = pdf["weight"]
    return a


def normalised(a: np.ndarray) -> np.ndarray:
    d = a.sum(1)
    s = np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    m = np.diag((d > 0).astype(float)) - s[:, None] * a * s
    return (m + m.T) / 2


def eigh(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues; eigenvectors whose largest entry (the first such) is positive."""
    values, vectors = np.linalg.eigh(m)
    at = np.abs(vectors).round(12).argmax(0)
    return values, vectors * np.where(vectors[at, np.arange(len(m))] < 0, -1.0, 1.0)


def zero_tolerance(n: int, largest: float | None = None) -> float:
    return n * np.finfo(float).eps * max(abs(2.0 if largest is None else largest), 1.0)


def group_starts(values: np.ndarray) -> list[int]:
    """Where groups of equal eigenvalues begin; a group is measured from its first member."""
    starts = [0]
    tolerance = zero_tolerance(len(values), np.abs(values).max()) if len(values) else 0
    for i, v in enumerate(values):
        if v - values[starts[-1]] > tolerance:
            starts.append(i)
    return starts if len(values) else []


def band_cut(values: np.ndarray, ratio: float = 0.5) -> int:
    """First index of the high band: the group start nearest to ``ratio`` of the largest eigenvalue, not 0, ties to the lower."""
    edges = [i for i in group_starts(np.asarray(values)) if i]
    if not 0 < ratio < 1 or not edges:
        raise InvalidFilterParameter("no edge between groups of eigenvalues to cut at")
    goal = ratio * np.abs(values).max()
    return min(edges, key=lambda i: (abs(values[i] - goal), i))


def low_pass(values: np.ndarray, tau: float, largest: float | None = None, sign: int = -1) -> np.ndarray:
    top = float(np.abs(values).max()) if largest is None else largest
    if not np.isfinite(tau) or tau <= 0 or not np.isfinite(top) or top <= 0:
        raise InvalidFilterParameter("tau and the largest eigenvalue are finite and positive")
    with np.errstate(over="ignore"):
        return np.exp(sign * np.asarray(values) / (tau * top))


def _by_zone(links: DataFrame, fn, schema: str) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["src"].max(), pdf["dst"].max())) + 1
        out = fn(matrix(pdf, n))
        out.insert(0, "zone", pdf["zone"].iloc[0])
        return out

    return spread(links.select("zone", "src", "dst", "weight"), "zone").groupBy("zone").applyInPandas(kernel, f"zone string, {schema}")


def spectrum(links: DataFrame) -> DataFrame:
    """(zone, k, eigenvalue, eigenvector array) of each zone's normalised Laplacian."""

    def kernel(a: np.ndarray) -> pd.DataFrame:
        values, vectors = eigh(normalised(a))
        return pd.DataFrame({"k": np.arange(len(values)), "eigenvalue": values, "eigenvector": list(vectors.T)})

    return _by_zone(links, kernel, "k long, eigenvalue double, eigenvector array<double>")


def spectrum_report(links: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Per zone: largest eigenvalue, zero multiplicity, Fiedler value, band cut, multiplicities there and at most."""

    def kernel(a: np.ndarray) -> pd.DataFrame:
        values = np.linalg.eigvalsh(normalised(a))
        tolerance = zero_tolerance(len(values), np.abs(values).max())
        above = values[values > tolerance]
        starts = [*group_starts(values), len(values)]
        cut = band_cut(values, ratio)
        sizes = dict(zip(starts, np.diff(starts).tolist(), strict=False))
        return pd.DataFrame([{"largest": values[-1], "zeros": int((values <= tolerance).sum()), "fiedler": above[0] if len(above) else 0.0, "cut": cut, "cut_value": values[cut], "cut_multiplicity": sizes[cut], "max_multiplicity": max(sizes.values())}])

    return _by_zone(links, kernel, "largest double, zeros long, fiedler double, cut long, cut_value double, cut_multiplicity long, max_multiplicity long")


def complete(signal: DataFrame, points: DataFrame) -> DataFrame:
    """The instants of ``signal`` in which every node of the zone has a finite value."""
    n = points.groupBy("zone").agg(F.count(F.lit(1)).alias("__n"))
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    whole = signal.where(fine).groupBy("zone", "t").agg(F.count_distinct("idx").alias("__k")).join(n, "zone").where("__k = __n")
    return signal.join(whole.select("zone", "t"), ["zone", "t"], "left_semi")


def with_signal(links: DataFrame, signal: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(adjacency, instants, matrix (T, n))`` for each zone and block of ``BLOCK`` instants; the frame that it
    returns gets the zone in front.

    Only a zone's edges are whole in a task, never its history. Node numbers begin at 0; the largest in links or
    signal tells how many there are, so nodes without links count. A missing or non-finite value is an error: see
    ``complete``.
    """

    def kernel(edges: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(edges):
            return pd.DataFrame()
        n = int(max(edges["src"].max(), edges["dst"].max(), x["idx"].max())) + 1
        wide = x.pivot(index="t", columns="idx", values="value").sort_index().reindex(columns=range(n))
        values = wide.to_numpy(float)
        if not np.isfinite(values).all():
            t, idx = np.argwhere(~np.isfinite(values))[0]
            raise IncompleteSignal(f"zone {edges['zone'].iloc[0]}: node {idx} has no finite value at {wide.index[t]}")
        out = fn(matrix(edges, n), wide.index.to_numpy(), values)
        out.insert(0, "zone", edges["zone"].iloc[0])
        return out

    x = signal.select("zone", F.floor(F.col("t") / BLOCK).alias("__block"), "t", "idx", "value")
    parts = x.select(F.col("zone").alias("__zone"), F.col("__block").alias("__of")).distinct()
    left = links.join(parts, F.col("zone") == F.col("__zone")).select("zone", F.col("__of").alias("__block"), "src", "dst", "weight")
    left, x = (spread(rows, "zone", "__block").groupBy("zone", "__block") for rows in (left, x))
    return left.cogroup(x).applyInPandas(kernel, f"zone string, {schema}")


def _long(t: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"t": np.repeat(t, y.shape[1]), "idx": np.tile(np.arange(y.shape[1]), len(t)), "value": y.ravel()})


def gft(links: DataFrame, signal: DataFrame, inverse: bool = False) -> DataFrame:
    """(zone, t, idx, value): U'x, or U x̂ for the inverse; idx counts modes or nodes."""

    def kernel(a, t, x):
        u = eigh(normalised(a))[1]
        return _long(t, x @ (u.T if inverse else u))

    return with_signal(links, signal, kernel, "t long, idx long, value double")


def diffuse(links: DataFrame, signal: DataFrame, tau: float = 0.5, sign: int = -1) -> DataFrame:
    """The signal under g(λ) = exp(sign λ / (τ λmax))."""
    if not np.isfinite(tau) or tau <= 0:
        raise InvalidFilterParameter("tau is finite and positive")

    def kernel(a, t, x):
        values, u = eigh(normalised(a))
        return _long(t, (x @ u * low_pass(values, tau, sign=sign)) @ u.T)

    return with_signal(links, signal, kernel, "t long, idx long, value double")


def band_energy(links: DataFrame, signal: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Energy below and above the cut, total and high share; share of mode 0; Rayleigh quotient."""

    def kernel(a, t, x):
        values, u = eigh(normalised(a))
        cut = band_cut(values, ratio)
        e = (x @ u) ** 2
        low, high, total = e[:, :cut].sum(1), e[:, cut:].sum(1), e.sum(1)
        share = lambda p, q: np.divide(p, q, out=np.zeros_like(p), where=q > 0)
        return pd.DataFrame({"t": t, "low": low, "high": high, "total": total, "high_fraction": share(high, total), "mode_zero": share(e[:, 0], total), "high_without_mean": share(high, e[:, 1:].sum(1)), "rayleigh": share(e @ values, total)})

    return with_signal(links, signal, kernel, "t long, low double, high double, total double, high_fraction double, mode_zero double, high_without_mean double, rayleigh double")


def tau_sweep(links: DataFrame, signal: DataFrame, taus: tuple[float, ...], ratio: float = 0.5) -> DataFrame:
    """(zone, tau, retained, high_retained, low_retained): shares of Dirichlet, high-band and low-band energy that diffusion leaves."""

    def kernel(a, t, x):
        values, u = eigh(normalised(a))
        e, cut = ((x @ u) ** 2).sum(0), band_cut(values, ratio)
        g = [low_pass(values, s) ** 2 for s in taus]
        parts = {"d": e * values, "h": e * (np.arange(len(e)) >= cut), "l": e * (np.arange(len(e)) < cut)}
        return pd.DataFrame({"tau": taus} | {f"{k}_before": float(v.sum()) for k, v in parts.items()} | {f"{k}_after": [float((v * f).sum()) for f in g] for k, v in parts.items()})

    names = [f"{k}_{when}" for k in "dhl" for when in ("before", "after")]
    parts = with_signal(links, signal, kernel, "tau double, d_before double, h_before double, l_before double, d_after double, h_after double, l_after double")
    sums = parts.groupBy("zone", "tau").agg(*(F.sum(n).alias(n) for n in names))
    share = lambda k: F.when(F.col(f"{k}_before") > 0, F.col(f"{k}_after") / F.col(f"{k}_before")).otherwise(0.0)
    return sums.select("zone", "tau", share("d").alias("retained"), share("h").alias("high_retained"), share("l").alias("low_retained"))


def limits(links: DataFrame, signal: DataFrame, small: float = 1e-3, large: float = 1e3) -> DataFrame:
    """(zone, to_kernel, to_identity, error): of each zone's instants the least cosine of the filter's result with sqrt(degree) at a
    small tau, with the signal at a large one, and the largest relative error there."""

    def kernel(a, t, x):
        values, u = eigh(normalised(a))
        low, high = ((x @ u * low_pass(values, s)) @ u.T for s in (small, large))
        d, norm = np.sqrt(a.sum(1)), lambda y: np.linalg.norm(y, axis=-1)
        cos = np.abs(low @ d) / np.maximum(norm(low) * norm(d), 1e-300)
        same = (high * x).sum(1) / np.maximum(norm(high) * norm(x), 1e-300)
        return pd.DataFrame({"cos": [cos.min()], "same": [same.min()], "error": [(norm(high - x) / np.maximum(norm(x), 1e-300)).max()]})

    rows = with_signal(links, signal, kernel, "cos double, same double, error double")
    return rows.groupBy("zone").agg(F.min("cos").alias("to_kernel"), F.min("same").alias("to_identity"), F.max("error").alias("error"))


def top_mode_score(links: DataFrame, signal: DataFrame, modes: int = 3) -> DataFrame:
    """(zone, t, idx, value): each node's energy in the highest modes."""

    def kernel(a, t, x):
        u = eigh(normalised(a))[1][:, -modes:]
        return _long(t, ((x @ u)[:, None, :] * u[None]).__pow__(2).sum(2))

    return with_signal(links, signal, kernel, "t long, idx long, value double")
