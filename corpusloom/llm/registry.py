"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, huffman, language_models, near_dups, passages, pieces, quality, secrets, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_token_ids": huffman.op2_token_ids,
        "op3_sentence_pieces": pieces.op3_sentence_pieces,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_near_duplicates": near_dups.op5_near_duplicates,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_warc": warc.op7_warc,
        "op8_passages": passages.op8_passages,
        "op9_cross_entropy": language_models.op9_cross_entropy,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.ORACLE, "op7_warc": warc.ORACLE}
