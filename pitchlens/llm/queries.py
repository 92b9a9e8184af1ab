"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchlens.llm import (
    htmltext,
    language,
    leaks,
    middle,
    mixing,
    privacy,
    repeats,
    scoring,
    simhash,
    toxicity,
    vectors,
    warc,
    whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.warc_query,
        "op2_near_vectors": vectors.vectors_query,
        "op3_scoring": scoring.scoring_query,
        "op4_simhash": simhash.simhash_query,
        "op5_leaks": leaks.leaks_query,
        "op6_privacy": privacy.privacy_query,
        "op7_mix": mixing.mixing_query,
        "op8_html": htmltext.html_query,
        "op9_toxicity": toxicity.toxicity_query,
        "op10_repeats": repeats.repeats_query,
        "op11_language": language.language_query,
        "op12_whitening": whitening.whitening_query,
        "op13_middle": middle.middle_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE,
        "op2_near_vectors": vectors.ORACLE,
        "op13_middle": middle.ORACLE,
    }
