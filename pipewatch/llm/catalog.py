"""The queries of the corpus operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pipewatch.llm import cascade, divergence, linedup, maxent, mixing, packing, pii, sketch, toxicity, variants, vptree, warc, wordpiece
from pipewatch.session import tune


def tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    run.__doc__ = query.__doc__
    return run


QUERIES = {
    name: tuned(query)
    for name, query in {
        "op1_nearest_vectors": vptree.query,
        "op2_toxicity": toxicity.query,
        "op3_mix_sources": mixing.query,
        "op4_language_model": maxent.query,
        "op5_warc_roundtrip": warc.query,
        "op6_quality_rules": cascade.query,
        "op7_token_counts": wordpiece.query,
        "op8_pack_sequences": packing.query,
        "op9_personal_data": pii.query,
        "op10_near_duplicates": sketch.query,
        "op11_line_dedup": linedup.query,
        "op12_spelling_variants": variants.query,
        "op13_source_divergence": divergence.query,
        "pipeline": corpus_pipeline.run,
    }.items()
}

ORACLE = {
    "op3_mix_sources": mixing.ORACLE,
    "op5_warc_roundtrip": warc.ORACLE,
    "op10_near_duplicates": sketch.ORACLE,
    "op11_line_dedup": linedup.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
