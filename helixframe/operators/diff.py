"""Comparing two sources of the same records, and threshold tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A compared column; numbers may differ by ``absolute`` and by ``relative`` of the larger, where given (both must be exceeded)."""

    name: str
    absolute: float | None = None
    relative: float | None = None


def differs(a: Column, b: Column, absolute: float | None = None, relative: float | None = None) -> Column:
    """Whether two numbers differ beyond the given limits; strictly, and never when both are zero."""
    gap = F.abs(a - b)
    tests = []
    if absolute is not None:
        tests.append(gap > absolute)
    if relative is not None:
        tests.append(gap / F.greatest(F.abs(a), F.abs(b)) > relative)
    far = tests[0] if len(tests) == 1 else tests[0] & tests[1] if tests else a != b
    return F.coalesce(F.when((a == 0) & (b == 0), False).otherwise(far), ~a.eqNullSafe(b))


def compared(old: DataFrame, new: DataFrame, keys: list[str], fields: list[Field], matches: bool = False) -> DataFrame:
    """(keys, mismatch, fields): OLD_ONLY, NEW_ONLY, VALUE with the names of fields that differ, and with ``matches`` MATCH.

    Repeated keys pair in the order of their fields, the first with the first; what is left over is on one side only. One full outer join on the keys.
    """
    names = [f.name for f in fields]
    order = Window.partitionBy(*keys).orderBy(*names)
    a = old.select(*keys, *names).withColumn("__n", F.row_number().over(order)).withColumnsRenamed({n: f"__o_{n}" for n in names}).withColumn("__old", F.lit(True))
    b = new.select(*keys, *names).withColumn("__n", F.row_number().over(order)).withColumnsRenamed({n: f"__n_{n}" for n in names}).withColumn("__new", F.lit(True))
    both = a.join(b, [*keys, "__n"], "full_outer")
    tests = []
    for f in fields:
        x, y = F.col(f"__o_{f.name}"), F.col(f"__n_{f.name}")
        tests.append(F.when(differs(x, y, f.absolute, f.relative) if f.absolute is not None or f.relative is not None else ~x.eqNullSafe(y), f.name))
    found = F.when(F.col("__old").isNull() | F.col("__new").isNull(), "").otherwise(F.array_join(F.array_compact(F.array(*tests)), ";"))
    kind = F.when(F.col("__new").isNull(), "OLD_ONLY").when(F.col("__old").isNull(), "NEW_ONLY").when(found != "", "VALUE").otherwise("MATCH")
    out = both.select(*keys, kind.alias("mismatch"), found.alias("fields"))
    return out if matches else out.filter("mismatch != 'MATCH'")


#: For each category its keys, and its fields as (name, absolute limit, relative limit); a field without limits must be equal.
CATEGORIES: dict[str, tuple[list[str], list[Field]]] = {
    "purity": (
        ["SampleId"],
        [Field("qcStatus"), Field("gender"), Field("germlineAberration"), Field("fitMethod"), Field("msStatus"), Field("tmbStatus"), Field("tmlStatus"), Field("purity", 0.04),
         Field("ploidy", 0.1), Field("contamination", 0.005), Field("tmbPerMb", 0.1, 0.05), Field("msIndelsPerMb", 0.1, 0.05), Field("tml", 1, 0.05), Field("copyNumberSegments", 5, 0.2),
         Field("unsupportedCopyNumberSegments", 5, 0.2), Field("svTmb", 5, 0.05), Field("tincLevel", 0.1)],
    ),
    "somatic_variant": (
        ["SampleId", "Chromosome", "Position", "Ref", "Alt", "VariantType"],
        [Field("reported"), Field("filter"), Field("gene"), Field("canonicalEffect"), Field("canonicalCodingEffect"), Field("canonicalHgvsCodingImpact"), Field("canonicalHgvsProteinImpact"),
         Field("otherTranscriptEffects"), Field("tier"), Field("hotspot"), Field("biallelic"), Field("qual", 50, 0.2), Field("subclonalLikelihood", 0.6), Field("hasLPS"),
         Field("variantCopyNumber", 0.3, 0.3), Field("tumorSupportingReadCount", 1, 0.2), Field("tumorTotalReadCount", 1, 0.2), Field("purityAdjustedVaf", 0.2)],
    ),
    "germline_variant": (
        ["SampleId", "Chromosome", "Position", "Ref", "Alt", "VariantType"],
        [Field("reported"), Field("filter"), Field("gene"), Field("canonicalEffect"), Field("canonicalCodingEffect"), Field("canonicalHgvsCodingImpact"), Field("canonicalHgvsProteinImpact"),
         Field("otherTranscriptEffects"), Field("tier"), Field("hotspot"), Field("biallelic"), Field("qual", 20, 0.2), Field("variantCopyNumber", 0.3, 0.15),
         Field("tumorSupportingReadCount", 1, 0.2), Field("tumorTotalReadCount", 1, 0.2), Field("purityAdjustedVaf", 0.2)],
    ),
    "germline_amp_del": (
        ["SampleId", "Gene"],
        [Field("reported"), Field("germlineStatus"), Field("tumorStatus"), Field("germlineCopyNumber", 0.2, 0.1), Field("tumorCopyNumber", 0.2, 0.1), Field("chromosome"),
         Field("chromosomeBand")],
    ),
    "driver": (
        ["SampleId", "GeneId", "TranscriptId", "DriverType"],
        [Field("likelihoodMethod"), Field("driverLikelihood", 0.1), Field("minCopyNumber", 0.3, 0.15), Field("maxCopyNumber", 0.3, 0.15), Field("chromosome"), Field("chromosomeBand")],
    ),
    "fusion": (
        ["SampleId", "FusionName"],
        [Field("reported"), Field("reportedType"), Field("phased"), Field("likelihood"), Field("fusedExonUp"), Field("fusedTranscriptUp"), Field("fusedExonDown"),
         Field("fusedTranscriptDown"), Field("chainLinks"), Field("chainTerminated"), Field("domainsKept"), Field("domainsLost"), Field("junctionCopyNumber", 0.5, 0.2)],
    ),
    "disruption": (
        ["SampleId", "Gene", "Chromosome", "Position", "Orientation", "TranscriptId"],
        [Field("reported"), Field("regionType"), Field("codingType"), Field("nextSpliceExonRank")],
    ),
    "germline_sv": (
        ["SampleId", "Gene", "Chromosome", "Position", "Orientation", "TranscriptId"],
        [Field("reported"), Field("regionType"), Field("codingType"), Field("nextSpliceExonRank")],
    ),
    "tissue_of_origin": (
        ["SampleId", "ClassifierName", "DataType"],
        [Field("topCancerType"), Field("probability", 0.1)],
    ),
    "hr_deficiency": (
        ["SampleId"],
        [Field("BRCA1", 0.1), Field("BRCA2", 0.1), Field("status"), Field("type"), Field("hrdScore", 0.1)],
    ),
    "hla": (
        ["SampleId"],
        [Field("status"), Field("alleles"), Field("somaticMissense", 0.4, 0.1), Field("somaticNonsenseOrFrameshift", 0.4, 0.1), Field("somaticSplice", 0.4, 0.1),
         Field("somaticInframeIndel", 0.4, 0.1), Field("somaticSynonymous", 0.4, 0.1), Field("refTotalFragments", 10, 0.01), Field("tumorTotalFragments", 10, 0.01),
         Field("tumorCopyNumber", 0.5, 0.15), Field("totalFragments", 10, 0.01), Field("fittedFragments", 10, 0.01), Field("discardedAlignmentFragments", 10, 0.01),
         Field("discardedIndels", 10, 0.01), Field("hlaYAllele")],
    ),
    "pharmacogene": (
        ["SampleId", "Gene", "HaplotypeName"],
        [Field("alleleCount"), Field("function"), Field("drugs"), Field("prescriptionUrls")],
    ),
    "virus": (
        ["SampleId", "Name"],
        [Field("reported"), Field("integrations", None, 0.2), Field("meanCoverage", None, 0.15), Field("driverLikelihood")],
    ),
    "flagstat": (
        ["SampleId"],
        [Field("mappedProportion", 0.01)],
    ),
    "tumor_bam_metrics": (
        ["SampleId"],
        [Field("duplicatePercentage", 0.05), Field("percentage30X", 0.03), Field("percentage60X", 0.03)],
    ),
    "germline_bam_metrics": (
        ["SampleId"],
        [Field("duplicatePercentage", 0.05), Field("percentage10X", 0.03), Field("percentage20X", 0.03)],
    ),
    "snp_genotype": (
        ["SampleId", "Chromosome", "Position", "Ref"],
        [Field("alt"), Field("genotype")],
    ),
    "cdr3_sequence": (
        ["SampleId", "Cdr3AA", "Cdr3Seq"],
        [Field("Filter"), Field("Locus")],
    ),
    "cdr3_locus": (
        ["SampleId", "Locus"],
        [Field("passSequences", None, 0.05)],
    ),
    "telomere": (
        ["SampleId", "Type"],
        [Field("telomereLength", None, 0.05)],
    ),
    "hr_deficiency_image": (
        ["SampleId"],
        [Field("breastCancerHrdScore", 0.1), Field("ovarianCancerHrdScore", 0.1), Field("pancreaticCancerScore", 0.1), Field("prostateCancerScore", 0.1), Field("otherCancerScore", 0.1)],
    ),
    "signature": (
        ["SampleId", "Signature"],
        [Field("percent", 0.05)],
    ),
    "rna_summary": (
        ["SampleId"],
        [Field("QcStatus"), Field("TotalFragments", 10, 0.01), Field("DuplicateFragments", 10, 0.01), Field("SplicedFragmentPerc", 0.01, 0.05), Field("UnsplicedFragmentPerc", 0.01, 0.05),
         Field("AltFragmentPerc", 0.01, 0.05), Field("ChimericFragmentPerc", 0.01, 0.05), Field("SplicedGeneCount", 10, 0.01), Field("ReadLength"), Field("FragLength5th", None, 0.05),
         Field("FragLength50th", None, 0.05), Field("FragLength95th", None, 0.05), Field("EnrichedGenePercent", 0.01), Field("MedianGCRatio", 0.01), Field("ForwardStrandPercent", 0.01)],
    ),
    "gene_expression": (
        ["SampleId", "GeneName"],
        [Field("SplicedFragments", 10, 0.05), Field("UnsplicedFragments", 10, 0.05), Field("AdjTPM", None, 0.05)],
    ),
    "transcript_expression": (
        ["SampleId", "TranscriptName"],
        [Field("GeneName"), Field("AdjTPM", None, 0.05)],
    ),
    "splice_junction": (
        ["SampleId", "GeneName", "Chromosome", "JunctionStart", "JunctionEnd"],
        [Field("Type"), Field("FragCount", 5, 0.05), Field("RegionStart"), Field("RegionEnd")],
    ),
    "rna_fusion": (
        ["SampleId", "FusionName", "ChromosomeUp", "PositionUp", "ChromosomeDown", "PositionDown"],
        [Field("KnownFusionType"), Field("JuncTypeUp"), Field("JuncTypeDown"), Field("SplitFrags", 5, 0.05), Field("RealignedFrags", 5, 0.05), Field("DiscordantFrags", 5, 0.05)],
    ),
    "copy_number": (
        ["SampleId", "Chromosome", "StartPosition", "EndPosition"],
        [Field("copyNumber", 0.5, 0.15), Field("majorAlleleCopyNumber", 0.5, 0.15), Field("method")],
    ),
    "gene_copy_number": (
        ["SampleId", "Gene"],
        [Field("minCopyNumber", 0.5, 0.15), Field("maxCopyNumber", 0.5, 0.15)],
    ),
}


def compare_category(category: str, old: DataFrame, new: DataFrame, matches: bool = False) -> DataFrame:
    """A comparison by its category's keys and fields; fields that neither source has are left out."""
    keys, fields = CATEGORIES[category]
    return compared(old, new, keys, [f for f in fields if f.name in old.columns and f.name in new.columns], matches)
