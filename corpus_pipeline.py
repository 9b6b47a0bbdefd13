"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of documents.

Defined results, of all stages: language ID rejects null texts and texts without a letter, and takes rows without a language
or doc_id like any other; line dedup leaves rows without a doc_id alone; near-dedup counts a null doc_id as the last one, and of
rows that repeat keeps one; in packing, a null doc_id stays null. Texts of any length go through whole. Further columns pass
through all stages but the last, also when their names are used inside. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm import decontaminate, language, lines, packing, simhash
from scryline.llm.common import documents, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the models know; those that are rejected go."""
    return language.accepted(docs, language.learn(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, or nearly stand, earlier in the corpus."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express language models, fingerprints or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
