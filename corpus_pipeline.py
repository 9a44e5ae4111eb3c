"""The corpus pipeline: five stages from documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last returns what the mix takes of each document.

Defined results for odd input: documents with null text, or without a letter, go in the
first stage, as no language can be told; those without doc_id are kept by the stages that
dedup and by the mix; without any lang nothing can be learned and all documents go; an
empty table gives an empty mix; extra columns, whatever their names, pass all stages but
the last; large groups of copies leave one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm.common import cut, table
from tidewave.llm.decontaminate import remove_contaminated
from tidewave.llm.langid import keep_languages
from tidewave.llm.line_dedup import drop_repeated_lines
from tidewave.llm.mixing import in_order_of_first_copy, mix_sources
from tidewave.llm.similar import near_dedup


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay."""
    return keep_languages(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them."""
    return drop_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in training order."""
    return in_order_of_first_copy(mix_sources(docs))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Language ID learns hyperdimensional profiles, which SQL can't express; the tests
#: hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
