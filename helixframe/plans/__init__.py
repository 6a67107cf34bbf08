"""All queries over the driver's tables."""

from . import assembly_queries, category_queries, chain_queries, cohort_queries, depth_queries, effect_queries, feature_queries, fit_queries, fitted_queries, fragment_queries, haplotype_queries, impact_queries, interval_queries, model_queries, probability_queries, quality_queries, receptor_queries, rna_queries, sequence_queries, source_queries, stream_queries, sv_queries, tracking_queries, tumor_queries, variant_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assembly_queries", "category_queries", "chain_queries", "cohort_queries", "depth_queries", "effect_queries", "feature_queries", "fit_queries", "fitted_queries", "fragment_queries", "haplotype_queries", "impact_queries", "interval_queries", "model_queries", "probability_queries", "quality_queries", "receptor_queries", "rna_queries", "sequence_queries", "source_queries", "stream_queries", "sv_queries", "tracking_queries", "tumor_queries", "variant_queries"]
