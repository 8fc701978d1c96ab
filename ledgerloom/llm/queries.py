"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

import pathlib

import corpus_pipeline
from ledgerloom.llm import contamination, conversations, infill, jaccard, language, lm, mixing, pagetext, quality, substrings, tokencounts, topk, toxicity

ROOT = str(pathlib.Path(__file__).resolve().parents[2])


def _with_path(query):
    """Python workers find this package by the driver's path where it is not installed."""
    def run(spark, sf_dir):
        environment = spark.sparkContext.environment
        have = environment.get("PYTHONPATH", "")
        if ROOT not in have.split(":"):
            environment["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
        return query(spark, sf_dir)
    return run


QUERIES = {name: _with_path(query) for name, query in {
    "op1_quality": quality.op1,
    "op2_toxicity": toxicity.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_decontamination": contamination.op4,
    "op5_jaccard_join": jaccard.op5,
    "op6_lm_scores": lm.op6,
    "op7_source_mix": mixing.op7,
    "op8_top_k": topk.op8,
    "op9_language": language.op9,
    "op10_html_text": pagetext.op10,
    "op11_infill": infill.op11,
    "op12_token_counts": tokencounts.op12,
    "op13_conversation_repair": conversations.op13,
    "pipeline": corpus_pipeline.run,
}.items()}

ORACLES = {
    "op3_substring_dedup": substrings.ORACLE,
    "op4_decontamination": contamination.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
    "op7_source_mix": mixing.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op11_infill": infill.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
