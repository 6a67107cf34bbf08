"""Probability functions over small keys of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..storage import table
from .registry import query

KEYS = "k AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q, l_linenumber::BIGINT AS n FROM lineitem)"


def keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n")).distinct()


@query(f"WITH {KEYS} SELECT q, n, round(list_sum(list_transform(generate_series(0, q), lambda i: exp(i * ln(4.0 * n) - 4.0 * n - lgamma(i + 1)))), 8) AS cdf, round(exp(q * ln(4.0 * n) - 4.0 * n - lgamma(q + 1)), 8) AS pmf FROM k")
def poisson_tail(spark, sf_dir):
    mean = 4.0 * F.col("n")
    return keys(spark, sf_dir).select("q", "n", F.round(S.poisson_cdf("q", mean), 8).alias("cdf"), F.round(S.poisson_pmf("q", mean), 8).alias("pmf"))


@query(f"""WITH {KEYS} SELECT q, n, round(CASE WHEN n >= q THEN 1 ELSE list_sum(list_transform(generate_series(0, n), lambda i: exp(lgamma(q + 1) - lgamma(i + 1) - lgamma(q - i + 1) + i * ln(0.2) + (q - i) * ln(0.8)))) END, 8) AS cdf FROM k""")
def binomial_tail(spark, sf_dir):
    return keys(spark, sf_dir).select("q", "n", F.round(S.binomial_cdf("n", "q", F.lit(0.2)), 8).alias("cdf"))


_BOUND = "list_sum(list_transform(generate_series(0, q), lambda i: exp(i * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(i + 1))))"


@query(f"""WITH RECURSIVE {KEYS}, b(q, lo, hi, step, ok) AS (SELECT q, 0.0::DOUBLE, greatest(10.0, 4.0 * (q + 1))::DOUBLE, 0, false FROM (SELECT DISTINCT q FROM k)
UNION ALL SELECT q, CASE WHEN ok OR c < 0.05 THEN lo ELSE m END, CASE WHEN c > 0.05 THEN hi ELSE m END, step + 1, abs(c - 0.05) < 1e-6 FROM (SELECT *, (lo + hi) / 2 AS m, {_BOUND} AS c FROM b WHERE NOT ok AND step < 200)),
f AS (SELECT q, lo, hi, step, ok, lag(lo) OVER w AS l, lag(hi) OVER w AS h FROM b WINDOW w AS (PARTITION BY q ORDER BY step)) SELECT k.q, k.n, round((l + h) / 2, 3) AS mean FROM k JOIN f USING (q) WHERE ok""")
def poisson_noise_bound(spark, sf_dir):
    return keys(spark, sf_dir).select("q", "n", F.round(S.poisson_noise("q", F.lit(0.05)), 3).alias("mean"))


@query(f"""WITH {KEYS}, t AS (SELECT q, n, q + n AS r, q + 9 AS c, q + n + 23 AS t FROM k), x AS (SELECT *, x FROM t, unnest(generate_series(greatest(0, r + c - t), least(r, c))) AS u(x)),
p AS (SELECT *, exp(lgamma(r + 1) + lgamma(t - r + 1) + lgamma(c + 1) + lgamma(t - c + 1) - lgamma(t + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(c - x + 1) - lgamma(t - r - c + x + 1)) AS p FROM x)
SELECT q, n, round(least(1, CASE WHEN any_value(q * t > r * c) THEN sum(p) FILTER (x >= q) ELSE sum(p) FILTER (x <= q) END), 8) AS p FROM p GROUP BY ALL""")
def fisher_strand(spark, sf_dir):
    return keys(spark, sf_dir).select("q", "n", F.round(S.fisher_exact("q", "n", F.lit(9), F.lit(14)), 8).alias("p"))


@query(f"""WITH {KEYS}, z AS (SELECT q, n, (q - 25) / n::DOUBLE AS z FROM k), s AS (SELECT q, n, z, list_sum(list_transform(generate_series(0, 2000), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(z * i / 2000.0, 2)))) * z / 2000 / 3 / sqrt(2 * pi()) AS a FROM z)
SELECT q, n, round(CASE WHEN z < -7 THEN 0 WHEN z > 7 THEN 1 ELSE 0.5 + a END, 8) AS p FROM s""")
def normal_tail(spark, sf_dir):
    return keys(spark, sf_dir).select("q", "n", F.round(S.normal_cdf((F.col("q") - 25) / F.col("n")), 8).alias("p"))
