"""Purity, ploidy and copy-number arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def adjusted_copy_number(purity: Column, norm: Column, tumor_ratio: Column, normal_ratio: Column, none_at_zero: bool = True) -> Column:
    """Copies from depth ratios; none_at_zero: a tumor ratio of 0 means no copies, whatever the normal's."""
    copies = 2 * normal_ratio + 2 * (tumor_ratio - normal_ratio * norm) / purity / norm
    return F.when(tumor_ratio == 0, 0.0).otherwise(copies) if none_at_zero else copies


def adjusted_ploidy(purity: Column, frequency: Column, copy_number: Column, normal_copy_number: Column, normal_ploidy: Column) -> Column:
    """Copies of an allele from its frequency."""
    return (frequency * (purity * copy_number + normal_copy_number * (1 - purity)) - normal_ploidy * (1 - purity)) / purity


def adjusted_vaf(purity: Column, frequency: Column, copy_number: Column, normal_copy_number: Column, normal_ploidy: Column, floor: float = 0.001) -> Column:
    copies = F.greatest(copy_number, F.lit(floor))
    return F.greatest(F.lit(0.0), adjusted_ploidy(purity, frequency, copies, normal_copy_number, normal_ploidy) / copies)


def norm_factor(average_ratio: Column, purity: Column, ploidy: Column) -> Column:
    return 2 * average_ratio / (2 - 2 * purity + ploidy * purity)


def event_penalty(major: Column, minor: Column, factor: float = 0.4) -> Column:
    """1 plus a cost for each step from a diploid, whole-genome doubled or lost state, whichever is cheapest."""
    single = F.abs(major - 1) + F.abs(minor - 1)
    doubled = 1 + F.abs(major - 2) + F.abs(minor - 2)
    return 1 + factor * F.least(single, doubled)


def cn_purity(slope: Column, ploidy: Column) -> Column:
    """Purity from the slope of observed against tumor copy number."""
    return clamp(2 * slope / (1 + (2 - ploidy) * slope), 0, 1)


def combined_estimate(a: Column, a_uncertainty: Column, b: Column, b_uncertainty: Column) -> tuple[Column, Column]:
    """Two estimates as one, weighted by inverse variance, with its uncertainty."""
    wa, wb = 1 / (a_uncertainty * a_uncertainty), 1 / (b_uncertainty * b_uncertainty)
    return (a * wa + b * wb) / (wa + wb), F.sqrt(1 / (wa + wb))


def tumor_fraction(frequency: Column, variant_copies: Column, copy_number: Column) -> Column:
    """2 AF / (VCN + 2 AF - CN AF), 1 at most."""
    return F.least(F.lit(1.0), 2 * frequency / (variant_copies + 2 * frequency - copy_number * frequency))


def telomere_length(reads: Column, duplicates: Column, read_length: Column, depth: Column, gc_adjustment: Column, ends: int = 46) -> Column:
    return reads * (1 - duplicates) * read_length / depth / gc_adjustment / ends


def telomere_reads(both: Column, one: Column, other: Column) -> Column:
    """Twice the pairs of two telomeric reads, plus pairs of one, minus interstitial ones; not below zero."""
    return F.greatest(F.lit(0), 2 * both + one - other)


def driver_probability(drivers: Column, passenger_rate: Column) -> Column:
    """pD / (pD + p (1 - pD)) with p = 1 - exp(-rate), the chance of a passenger or more."""
    p = 1 - F.exp(-passenger_rate)
    return drivers / (drivers + p * (1 - drivers))


#: Fixed thresholds of the sex-chromosome and trisomy calls, on median ratios.
X_FEMALE, Y_FEMALE, MOSAIC_X, KLINEFELTER, XYY, TRISOMY = 0.65, 0.05, 0.8, 0.65, 0.75, 1.35


def gender(x: Column, y: Column, y_windows: Column) -> Column:
    return F.when((x >= X_FEMALE) & ((y < Y_FEMALE) | (y_windows < 1000)), "FEMALE").otherwise("MALE")


def aberrations(sex: Column, x: Column, y: Column, least_autosome: Column, trisomies: dict[str, Column]) -> Column:
    """Names of all that hold, joined by ``;``, or NONE."""
    tests = {
        "MOSAIC_X": (sex == "FEMALE") & (x < F.least(F.lit(MOSAIC_X), least_autosome)),
        "KLINEFELTER": (sex == "MALE") & (x >= KLINEFELTER),
        "XYY": (sex == "MALE") & (y >= XYY),
    } | {f"TRISOMY_{k}": v >= TRISOMY for k, v in trisomies.items()}
    found = F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    return F.when(F.size(found) == 0, "NONE").otherwise(F.array_join(found, ";"))
