"""Fits of small dense problems: one group at a time in NumPy, or sums over all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf_array


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-10, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: active sets, entering the steepest coordinate and stepping back to the boundary."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    for _ in range(rounds or 3 * n + 10):
        if free.all() or gradient[~free].max() <= tolerance:
            break
        free[np.where(~free, gradient, -np.inf).argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if not free.any() or trial[free].min() > tolerance:
                break
            low = free & (trial <= tolerance)
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x = x + step * (trial - x)
            free &= x > tolerance
            x[~free] = 0
        x = trial
        gradient = a.T @ (b - a @ x)
    return x


def signature_fit(counts: DataFrame, sample: str, bucket: str, count: str, signatures: dict[str, dict[str, float]]) -> DataFrame:
    """(sample, signature, allocation, percent) by non-negative least squares for each sample; buckets are a fixed list."""
    names = sorted(signatures)
    buckets = sorted({b for s in signatures.values() for b in s})
    matrix = np.array([[signatures[s].get(b, 0.0) for s in names] for b in buckets])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        by = group.groupby(bucket)[count].sum()
        got = nnls(matrix, np.array([float(by.get(b, 0.0)) for b in buckets]))
        total = float(group[count].sum()) or 1.0
        return pd.DataFrame({sample: group[sample].iloc[0], "signature": names, "allocation": got, "percent": got / total})

    kind = counts.schema[sample].dataType.simpleString()
    return counts.select(sample, bucket, count).groupBy(sample).applyInPandas(run, f"{sample} {kind}, signature string, allocation double, percent double")


def abundance(categories: DataFrame, group: str, members: str, count: str, rounds: int = 20, tolerance: float = 0.001) -> DataFrame:
    """(group, member, abundance): expectation-maximisation over counts of member sets, from a uniform start."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [list(m) for m in rows[members]]
        n = rows[count].to_numpy(float)
        names = sorted({m for s in sets for m in s})
        place = {m: i for i, m in enumerate(names)}
        index = [np.array([place[m] for m in s]) for s in sets]
        share = np.full(len(names), n.sum() / max(1, len(names)))
        for _ in range(rounds):
            new = np.zeros(len(names))
            for i, c in zip(index, n):
                whole = share[i].sum()
                new[i] += c * (share[i] / whole if whole else 1 / len(i))
            change = np.abs(new - share).sum() / max(1e-12, n.sum())
            share = new
            if change < tolerance:
                break
        return pd.DataFrame({group: rows[group].iloc[0], "member": names, "abundance": share})

    kind = categories.schema[group].dataType.simpleString()
    member = categories.schema[members].dataType.elementType.simpleString()
    return categories.select(group, members, count).groupBy(group).applyInPandas(run, f"{group} {kind}, member {member}, abundance double")


def nmf(v: np.ndarray, rank: int, rounds: int = 500, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """W and H, both >= 0, with W H near v: multiplicative updates of the squared error from a seeded start."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((v.shape[0], rank)) + 1e-3, rng.random((rank, v.shape[1])) + 1e-3
    for _ in range(rounds):
        h *= (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (v @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


def density(points: DataFrame, by: list[str], value: str, grid: list[float], bandwidth: float, precision: float = 0.001, weight: str | None = None) -> DataFrame:
    """(by, x, density): normal kernels at the grid's places. Values are first counted at ``precision``, which bounds what meets the grid."""
    binned = points.groupBy(*by, (F.round(F.col(value) / precision) * precision).alias("v")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("n"))
    places = points.sparkSession.createDataFrame([(float(x),) for x in grid], "x double")

    @F.pandas_udf("double")
    def kernel(x: pd.Series, v: pd.Series) -> pd.Series:
        d = x.to_numpy() - v.to_numpy()
        return pd.Series((normal_cdf_array((d + precision / 2) / bandwidth) - normal_cdf_array((d - precision / 2) / bandwidth)) / precision)

    return binned.join(F.broadcast(places), F.lit(True)).groupBy(*by, "x").agg((F.sum(F.col("n") * kernel("x", "v")) / F.sum("n")).alias("density"))


def peaks(curve: DataFrame, by: list[str]) -> DataFrame:
    """Strict local maxima of a density over its grid."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("x")
    sides = curve.withColumns({"__a": F.lag("density").over(order), "__b": F.lead("density").over(order)})
    return sides.filter((F.col("density") > F.coalesce("__a", F.lit(-1.0))) & (F.col("density") > F.coalesce("__b", F.lit(-1.0)))).drop("__a", "__b")


def umi_groups(reads: DataFrame, by: list[str], umi: str, count: str, edits: int = 1) -> DataFrame:
    """(by, umi, group): directional network of each position's identifiers.

    From the most frequent one on, an unused identifier within ``edits`` substitutions joins if the group's own count is at least twice its own less one, and may take
    others in turn. The number of identifiers at a position is bounded by their length.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.groupby(umi)[count].sum()
        names = sorted(n.index, key=lambda u: (-n[u], u))
        group: dict[str, str] = {}
        for seed in names:
            if seed in group:
                continue
            group[seed], queue = seed, [seed]
            while queue:
                u = queue.pop(0)
                for v in names:
                    if v not in group and len(u) == len(v) and sum(a != b for a, b in zip(u, v)) <= edits and n[u] >= 2 * n[v] - 1:
                        group[v] = seed
                        queue.append(v)
        out = pd.DataFrame({umi: names, "group": [group[u] for u in names]})
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, umi, "group"]]

    kinds = ", ".join(f"{k} {reads.schema[k].dataType.simpleString()}" for k in by)
    return reads.select(*by, umi, count).groupBy(*by).applyInPandas(run, f"{kinds}, {umi} string, group string")


def homozygous_runs(sites: DataFrame, by: list[str], position: str, heterozygous: str, window: int = 50, most: int = 5, least_sites: int = 50, least_length: int = 500_000) -> DataFrame:
    """(by, start, end, n, n_het): stretches in which no ``window`` sites at a stretch have more than ``most`` heterozygous ones.

    A region that would begin at a key's first site is not reported.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position)
        at, het = rows[position].to_numpy(), rows[heterozygous].to_numpy(bool)
        total = np.concatenate([[0], np.cumsum(het)])
        out, begin = [], None
        for i in range(len(at) + 1):
            if i < len(at):
                low = max(0 if begin is None else begin, i - window + 1)
                over = total[i + 1] - total[low] > most
                if begin is None and not het[i]:
                    begin = i
                if not over:
                    continue
            if begin is not None:
                last = i - 1
                while last > begin and het[last]:
                    last -= 1
                if begin > 0 and last - begin + 1 >= least_sites and at[last] - at[begin] + 1 >= least_length:
                    out.append((at[begin], at[last], last - begin + 1, int(total[last + 1] - total[begin])))
                begin = None
        found = pd.DataFrame(out, columns=["start", "end", "n", "n_het"])
        for k in by:
            found[k] = rows[k].iloc[0]
        return found[[*by, "start", "end", "n", "n_het"]]

    kinds = ", ".join(f"{k} {sites.schema[k].dataType.simpleString()}" for k in by)
    return sites.select(*by, position, heterozygous).groupBy(*by).applyInPandas(run, f"{kinds}, start long, end long, n long, n_het long")
