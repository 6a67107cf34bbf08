"""Fitted models: repeat jitter by an asymmetric Laplace, signatures within the noise of the counts, and signatures found in a cohort.

Counts are summed over all tasks first. What is fitted then is one row of lists for each unit or sample, many of them to a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import poisson_noise_one
from ..storage import stored
from .fits import nnls

# ---------------------------------------------------------------- jitter

#: Jitter considered; least and highest scale and skew, and the steps of the search below a bound; reads from which a fit of a count is taken; counts of the line; its slope where it can't be fitted; scales by unit length at 4, 5 and 6 copies.
WIDEST = 5
GRID_FROM, GRID_TO, GRID_STEPS = 0.05, 5.001, [(0.25, 0.01), (0.5, 0.02), (2.0, 0.05), (np.inf, 0.2)]
ENOUGH_READS = 20_000
SHORT, LINE = (4, 5, 6), range(7, 16)
SLOPE = 0.06
SCALES = {1: (0.1, 0.15, 0.2), 2: (0.15, 0.2, 0.25), 3: (0.2, 0.25, 0.3)}
FLOOR, SKEW_COST, SHARE, LEAST_SKEWED = 1e-4, 0.01, 0.2, 50


def laplace(scale, skew) -> np.ndarray:
    """Shares of jitter -WIDEST to WIDEST in the last axis; at scales under 1 the skew is drawn towards 1."""
    scale, skew = np.asarray(scale, float)[..., None], np.asarray(skew, float)[..., None]
    k = 1 + (skew - 1) * np.minimum(scale, 1)
    x = np.arange(-WIDEST, WIDEST + 1)
    raw = np.exp(-np.abs(x) * np.where(x >= 0, k, 1 / k) / scale)
    return raw / raw.sum(-1, keepdims=True)


@lru_cache(1)
def grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scales and skews that are tried, and the model's shares of each pair."""
    values, v = [], GRID_FROM
    while v <= GRID_TO:
        values.append(v)
        v += next(step for bound, step in GRID_STEPS if v < bound or (bound in (0.25, 2.0) and v <= bound))
    values = np.array(values)
    return values, values, laplace(values[:, None], values[None, :])


def losses(shares: np.ndarray, observed: np.ndarray, skew: np.ndarray, scale: np.ndarray, before: float | None) -> np.ndarray:
    """Of the model's shares: observed shares times the decibels between both, both at least FLOOR, jitter 0 left out; plus a cost of skew and, with a scale ``before``, of the square of the distance from it."""
    model, seen = np.maximum(shares, FLOOR), np.maximum(observed, FLOOR)
    each = 10 * np.abs(np.log10(model / seen)) * observed
    each[..., WIDEST] = 0
    out = each.sum(-1) + (np.maximum(skew, 1 / skew) - 1) * SKEW_COST
    return out if before is None else out + (scale - before) ** 2


def fit_count(counts: np.ndarray, before: float | None) -> tuple[float, float, float]:
    """(scale, skew, loss): the pair of the grid with the least loss, ties the first."""
    scales, skews, shares = grid()
    loss = losses(shares, counts / counts.sum(), skews[None, :], scales[:, None], before)
    k, m = np.unravel_index(int(loss.argmin()), loss.shape)
    return float(scales[k]), float(skews[m]), float(loss[k, m])


def fit_unit(rows: dict[int, np.ndarray], length: int) -> tuple[float, ...]:
    """(scale4, scale5, scale6, gradient, intercept, skew) from reads by jitter for each count of copies, of a unit of ``length`` bases."""
    fallback = dict(zip(SHORT, SCALES[min(length, 3)]))
    fits: dict[int, tuple[float, float]] = {}
    for n in (*SHORT, *LINE):
        if n in rows and rows[n].sum() > 0:
            before = fits[n - 1][0] if n - 1 in fits else 0.0
            scale, skew, _ = fit_count(rows[n], before if n >= LINE[0] else None)
            fits[n] = (fallback[n] if n in fallback and rows[n].sum() < ENOUGH_READS else scale, skew)
    own = [n for n in LINE if n in fits]
    total = float(sum(rows[n].sum() for n in own))
    gradient = intercept = skew = None
    if sum(rows[n].sum() >= ENOUGH_READS for n in own) > 1:
        w = np.array([min(rows[n].sum() / total, SHARE) for n in own])
        x = np.stack([np.array(own, float), np.ones(len(own))], 1)
        line = np.linalg.lstsq(x * w[:, None], w * np.array([fits[n][0] for n in own]), rcond=None)[0]
        if line[0] > 0:
            gradient, intercept = map(float, line)
            skew = float((w * np.array([fits[n][1] for n in own])).sum() / w.sum())
    if gradient is None:
        gradient, intercept = SLOPE, fallback[6] - 6 * SLOPE
    if skew is None:
        shorter = sum(float(r[:WIDEST].sum()) for n, r in rows.items() if n in fits)
        longer = sum(float(r[WIDEST + 1 :].sum()) for n, r in rows.items() if n in fits)
        skew = 1.0 if min(shorter, longer) < LEAST_SKEWED else max(float(np.log10(shorter / longer)) + 1, 0.01)
    at = {n: fits[n][0] if n in fits else fallback[n] for n in SHORT}
    return (*[at[n] for n in SHORT], gradient, intercept, skew)


def _rows_of_lists(rows: DataFrame, by: list[str], of: list[str], make, schema: str) -> DataFrame:
    """What ``make`` yields for each group of ``by``, whose rows of ``of`` stand in one row as a list."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(f"{keys}, {schema}")]
    lists = rows.groupBy(*by).agg(F.collect_list(F.struct(*of)).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*[row[k] for k in by], *r) for row in batch.to_pylist() for r in make(row["__v"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return lists.mapInArrow(run, f"{keys}, {schema}")


def jitter_models(reads: DataFrame, by: list[str], unit: str, count: str, jitter: str, weight: str | None = None) -> DataFrame:
    """(by, unit, scale4, scale5, scale6, gradient, intercept, skew) of reads with a repeat's unit, its copies and how many copies a read shows more or less; weight: how many reads a row stands for.

    Jitter beyond WIDEST and copies outside of 4 to 15 are left out, like rows with nulls.
    """
    n = F.sum(F.col(weight)) if weight else F.count("*")
    known = reads.filter(F.col(unit).isNotNull() & F.col(count).between(SHORT[0], LINE[-1]) & (F.abs(jitter) <= WIDEST))
    table = known.groupBy(*by, unit, F.col(count).cast("int").alias("__c"), F.col(jitter).cast("int").alias("__j")).agg(n.cast("double").alias("__n"))

    def make(rows):
        own: dict[int, np.ndarray] = {}
        for r in rows:
            own.setdefault(r["__c"], np.zeros(2 * WIDEST + 1))[r["__j"] + WIDEST] += r["__n"] or 0.0
        yield fit_unit(own, len(rows[0]["__u"]))

    return _rows_of_lists(table.withColumn("__u", F.col(unit).cast("string")), [*by, unit], ["__u", "__c", "__j", "__n"], make, "scale4 double, scale5 double, scale6 double, gradient double, intercept double, skew double")


# ---------------------------------------------------------------- signatures

#: Probability that a count lies beyond its noise; share of a sample under which a signature is dropped; how much of the fit's error a drop may add, in shares of the sample.
NOISE = 0.001
LEAST_SHARE, LOSS = 0.02, 0.005


@lru_cache(1 << 16)
def noise_of(count: int) -> float:
    """How far the mean of a count may lie above it: at the mean that far, so few or fewer are seen with probability NOISE."""
    return poisson_noise_one(float(count), NOISE) - count


def bounded_fit(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """x >= 0 with a x <= most that minimises |a x - b|.

    A least-distance problem after a change of variables, which non-negative least squares over its constraints solves.
    """
    n = a.shape[1]
    if not n:
        return np.zeros(0)
    x = nnls(a, b)
    if (a @ x <= most + 1e-9).all():
        return x
    # |a x - b| is the distance of z = r x - q'b from zero, but for what no x can reach.
    ridge = np.vstack([a, 1e-7 * np.eye(n)])
    q, r = np.linalg.qr(ridge)
    start = q.T @ np.concatenate([b, np.zeros(n)])
    inverse = np.linalg.inv(r)
    g = np.vstack([np.eye(n), -a]) @ inverse
    h = np.concatenate([np.zeros(n), -most]) - g @ start
    e = np.vstack([g.T, h[None, :]])
    u = nnls(e, np.append(np.zeros(n), 1.0), 1e-12, 50 * e.shape[1])
    rest = e @ u - np.append(np.zeros(n), 1.0)
    z = -rest[:n] / rest[n] if abs(rest[n]) > 1e-12 else np.zeros(n)
    x = np.maximum(inverse @ (z + start), 0)
    over = (a @ x - most)[most > 0] / most[most > 0]
    return x / (1 + max(0.0, over.max(initial=0.0)))


def refined(a: np.ndarray, b: np.ndarray, least: float = LEAST_SHARE, loss: float = LOSS) -> np.ndarray:
    """An allocation for each signature (column of a) that overshoots no count beyond its noise, by as few signatures as the fit allows.

    From all signatures on, the one is dropped, and the others fitted anew, whose loss adds least to the error (the sum of distances, in shares of all counts; ties: the first), as long as that is ``loss`` at most or
    its own share is under ``least``.
    """
    total = b.sum()
    if total <= 0:
        return np.zeros(a.shape[1])
    most = b + np.array([noise_of(int(round(v))) for v in b])
    error = lambda keep, x: float(np.abs(b - a[:, keep] @ x).sum() / total)
    keep = list(range(a.shape[1]))
    x = bounded_fit(a, b, most)
    while len(keep) > 1:
        trials = []
        for i in range(len(keep)):
            rest = keep[:i] + keep[i + 1 :]
            y = bounded_fit(a[:, rest], b, most)
            trials.append((error(rest, y) - error(keep, x), i, rest, y))
        added, i, rest, y = min(trials, key=lambda t: (round(t[0], 12), t[1]))
        small = int(np.argmin(x))
        if added <= loss:
            keep, x = rest, y
        elif x[small] < least * total:
            keep, x = trials[small][2], trials[small][3]
        else:
            break
    out = np.zeros(a.shape[1])
    out[keep] = x
    return out


def refined_signatures(counts: DataFrame, sample: str, bucket: str, count: str, signatures: dict[str, dict[str, float]]) -> DataFrame:
    """(sample, signature, allocation, percent) of samples' counts by bucket, by ``refined``; signatures that are dropped have zero. Buckets that no signature has are left to the noise, null counts are zero."""
    names = sorted(signatures)
    buckets = sorted({b for s in signatures.values() for b in s})
    matrix = np.array([[signatures[s].get(b, 0.0) for s in names] for b in buckets])
    summed = counts.groupBy(sample, bucket).agg(F.sum(count).cast("double").alias("__n"))

    def make(rows):
        by = {r[bucket]: r["__n"] or 0.0 for r in rows}
        got = refined(matrix, np.array([by.get(b, 0.0) for b in buckets]))
        total = sum(by.values()) or 1.0
        yield from ((n, float(x), float(x) / total) for n, x in zip(names, got))

    return _rows_of_lists(summed, [sample], [bucket, "__n"], make, "signature string, allocation double, percent double")


# ---------------------------------------------------------------- discovery

#: Fixed values of discovery: rounds, a round's least explained share of all counts, cosine of profiles alike, buckets that name a group, share of a sample that a signature must explain, deviations of noise.
ROUNDS, LEAST_GAIN, ALIKE, GROUP_BUCKETS, SAMPLE_SHARE, DEVIATIONS = 40, 0.003, 0.97, 5, 0.1, 3.0


def discovered(counts: DataFrame, sample: str, bucket: str, count: str, rounds: int = ROUNDS, alike: float = ALIKE, group: int = GROUP_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(signature, bucket, share) and (sample, signature, allocation): signatures behind samples' counts by bucket, found one a round.

    A round looks at what is left of each sample. Samples with the same ``group`` largest buckets are one group, and the group with most counts proposes the round's signature: the mean of its members' shares, drawn twice to
    the counts of all samples alike it by cosine. Every sample then gives as many counts to it as its least bucket permits within noise; where that is SAMPLE_SHARE of its counts at least, they are taken from what is left.
    Rounds end when one takes less than LEAST_GAIN of all counts.

    What is left is a row for each sample and bucket, written to the shared folder each round; only profiles, a row for each bucket, pass the driver. Null counts are zero; samples without counts get nothing.
    """
    spark = counts.sparkSession
    c = F.col
    kinds = {k: counts.schema[k].dataType.simpleString() for k in (sample, bucket)}
    summed = stored(counts.groupBy(sample, bucket).agg(F.sum(count).cast("double").alias("n")).filter("n > 0"), "counts")
    buckets = [r[0] for r in summed.select(bucket).distinct().orderBy(bucket).collect()]  # mutation contexts
    every = summed.select(sample).distinct().withColumn(bucket, F.explode(F.array(*[F.lit(b) for b in buckets]).cast(f"array<{kinds[bucket]}>"))) if buckets else summed.select(sample, bucket)
    left = stored(every.join(summed, [sample, bucket], "left").select(sample, bucket, F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("n", F.lit(0.0)).alias("all")), "left")
    total = summed.agg(F.sum("n")).first()[0] or 0.0
    table = lambda profile: F.broadcast(spark.createDataFrame(list(profile.items()), f"`{bucket}` {kinds[bucket]}, q double"))
    profiles, given = [], None
    for number in range(rounds if buckets else 0):
        whole = left.groupBy(sample).agg(F.sum("n").alias("rest"), F.sum("all").alias("whole"))
        able = whole.filter(c("rest") >= SAMPLE_SHARE * c("whole")).filter("rest > 0")
        shares = left.join(able, sample).withColumn("p", c("n") / c("rest"))
        largest = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-c("n")).alias("m"), c(bucket).alias("b")))), 1, group), lambda x: x["b"])
        keys = stored(shares.groupBy(sample).agg(F.array_sort(largest).alias("key"), F.first("rest").alias("rest")), "groups")
        top = keys.groupBy("key").agg(F.sum("rest").alias("s")).orderBy(F.desc("s"), "key").first()
        if top is None:
            break
        members = keys.filter(c("key") == F.array(*[F.lit(x) for x in top.key]).cast(f"array<{kinds[bucket]}>")).select(sample)
        profile = {r[bucket]: r.q for r in shares.join(members, sample, "left_semi").groupBy(bucket).agg(F.avg("p").alias("q")).collect()}
        for _ in range(2):
            norm = float(np.sqrt(sum(v * v for v in profile.values())))
            cosine = F.sum(c("p") * c("q")) / F.sqrt(F.sum(c("p") * c("p"))) / norm
            near = shares.join(table(profile), bucket).groupBy(sample).agg(cosine.alias("cosine")).filter(c("cosine") >= alike).select(sample)
            found = {r[bucket]: r.n for r in shares.join(near, sample, "left_semi").groupBy(bucket).agg(F.sum("n").alias("n")).collect()}
            if size := sum(found.values()):
                profile = {b: v / size for b, v in found.items()}
        met = left.join(table(profile), bucket, "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
        room = F.min(F.when(c("q") > 0, (c("n") + DEVIATIONS * F.sqrt(c("all") + 1)) / c("q")))
        takes = met.groupBy(sample).agg(F.least(room, F.sum("n")).alias("x"), F.sum("all").alias("whole")).filter(c("x") >= SAMPLE_SHARE * c("whole"))
        takes = stored(takes.select(sample, "x"), "taken")
        after = met.join(takes, sample, "left").withColumn("n", F.greatest(F.lit(0.0), c("n") - F.coalesce("x", F.lit(0.0)) * c("q"))).select(left.columns)
        after = stored(after, "left")
        gain = (left.agg(F.sum("n")).first()[0] or 0.0) - (after.agg(F.sum("n")).first()[0] or 0.0)
        if gain < LEAST_GAIN * total:
            break
        profiles += [(number, b, float(v)) for b, v in sorted(profile.items()) if v > 0]
        own = takes.select(sample, F.lit(number).alias("signature"), c("x").alias("allocation"))
        given = own if given is None else given.union(own)
        left = after
    if given is None:
        given = spark.createDataFrame([], f"`{sample}` {kinds[sample]}, signature int, allocation double")
    return spark.createDataFrame(profiles, f"signature int, `{bucket}` {kinds[bucket]}, share double"), given
