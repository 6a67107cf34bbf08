"""Documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns what it keeps with the columns of docs; the last returns the packed pieces.
``run`` writes every stage's result into the shared folder and reads it again as the next one's documents, so that a lost executor
costs one stage's tasks and the next stage scans plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, ftrl, near_copies, packing, quality_classifier, toxicity
from helixframe.llm.common import discarded, fresh, scratch, stored, table

THRESHOLD = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least THRESHOLD; the model learns from the labelled ones among them, and all stay where they don't have both labels."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    if not len(model.index):
        return docs
    score = fresh(docs, "__score")[0]
    return ftrl.scored(docs, model, quality_classifier.features, score=score).filter(F.col(score) >= THRESHOLD).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under THRESHOLD; all of them where the labelled ones don't have both labels to learn from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not len(model.index):
        return docs
    score = fresh(docs, "__score")[0]
    return ftrl.scored(docs, model, toxicity.features, score=score).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, similar by 0.8 or more in words by five: that of the least id.

    Candidates come from multi-index hashing of SimHash fingerprints, and beyond its two bits from bands of least hashes too: texts of that similarity differ in about ten
    of 64 bits, and balls of that radius hold too many keys to enumerate. All are verified on whole sets. Components and survivors are those of the SimHash operator.
    """
    return near_copies.deduplicated(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: SQL can't express the trained models, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's intermediate tables, and the documents that it read, are deleted once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            out = stored(stage(spark, docs, sf_dir), name, outlives=True)
        discarded(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
