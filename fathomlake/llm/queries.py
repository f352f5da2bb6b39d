"""The operators' queries and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

import public_tokenizers

from . import op10_minhash_dedup, op11_source_divergence, op12_hard_negatives, op13_source_mix, op1_packing, op2_decontamination, op3_token_counts, op4_lm_scoring, op5_toxicity, op6_line_dedup, op7_exact_dedup, op8_substring_dedup, op9_suffix_dedup
from .common import table


def packing(spark, sf_dir):
    return op1_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def decontamination(spark, sf_dir):
    return op2_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_counts(spark, sf_dir):
    return op3_token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def lm_scoring(spark, sf_dir):
    return op4_lm_scoring.language_model(table(spark, sf_dir, "documents"))


def toxicity(spark, sf_dir):
    return op5_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_dedup(spark, sf_dir):
    return op6_line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def exact_dedup(spark, sf_dir):
    return op7_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def substring_dedup(spark, sf_dir):
    return op8_substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def suffix_dedup(spark, sf_dir):
    return op9_suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def minhash_dedup(spark, sf_dir):
    return op10_minhash_dedup.near_dedup(table(spark, sf_dir, "documents"))


def source_divergence(spark, sf_dir):
    return op11_source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def hard_negatives(spark, sf_dir):
    return op12_hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def source_mix(spark, sf_dir):
    return op13_source_mix.source_mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": packing,
    "op2_decontamination": decontamination,
    "op3_token_counts": token_counts,
    "op4_lm_scoring": lm_scoring,
    "op5_toxicity": toxicity,
    "op6_line_dedup": line_dedup,
    "op7_exact_dedup": exact_dedup,
    "op8_substring_dedup": substring_dedup,
    "op9_suffix_dedup": suffix_dedup,
    "op10_minhash_dedup": minhash_dedup,
    "op11_source_divergence": source_divergence,
    "op12_hard_negatives": hard_negatives,
    "op13_source_mix": source_mix,
}
ORACLES = {
    "op2_decontamination": op2_decontamination.ORACLE,
    "op6_line_dedup": op6_line_dedup.ORACLE,
    "op7_exact_dedup": op7_exact_dedup.ORACLE,
    "op8_substring_dedup": op8_substring_dedup.ORACLE,
    "op10_minhash_dedup": op10_minhash_dedup.ORACLE,
    "op11_source_divergence": op11_source_divergence.ORACLE,
    "op12_hard_negatives": op12_hard_negatives.ORACLE,
    "op13_source_mix": op13_source_mix.ORACLE,
}
