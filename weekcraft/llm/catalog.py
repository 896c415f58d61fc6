"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekcraft.llm import audit, exact, infill, jaccard, language, mixing, pieces, pitman_yor, private, toxicity, viterbi, warc, winnow


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_warc_revisits": warc.op3_warc_revisits,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language.op5_language_id,
    "op6_token_counts": pieces.op6_token_counts,
    "op7_pii": private.op7_pii,
    "op8_sentencepiece": viterbi.op8_sentencepiece,
    "op9_winnowing": winnow.op9_winnowing,
    "op10_mixing": mixing.op10_mixing,
    "op11_infill": infill.op11_infill,
    "op12_pitman_yor": pitman_yor.op12_pitman_yor,
    "op13_filter_audit": audit.op13_filter_audit,
    "pipeline": pipeline,
}

ORACLE = {**exact.ORACLE, **warc.ORACLE, **infill.ORACLE, **audit.ORACLE}
