"""A corpus from raw documents to a mix: five stages, each one operator of ``pitchlens.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.llm import leaks, mixing, privacy, simhash, toxicity
from pitchlens.llm.common import table
from pitchlens.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model of the labels does not reject.

    Null and blank texts have no toxic words and stay; without labels all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id. Null and blank texts are a group."""
    return simhash.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, edited copies included. Null texts stay."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data and of terms that give it away.

    ``n_chars``, where there is such a column, is that of the new text; null texts stay null.
    """
    done = privacy.sanitise(docs)
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        length = F.coalesce(F.char_length("clean"), F.col("doc").getField("n_chars"))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return done.select(*(value.alias(name) for name, value in columns.items()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts: how often (``copies``), how many words (``taken``).

    Documents that it takes no copy of are left out; those without words count as taken if their
    source is. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("privacy", hide_personal_data),
    ("mixing", mix_sources),
]

#: Models, hashes and dependent rounding are not expressible in SQL; the tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
