"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import (
    exact_dedup,
    language_id,
    learned_partitions,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality_rules,
    recurrent_lm,
    spelling_variants,
    super_minhash,
    token_counts,
    url_filters,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_recurrent_lm": recurrent_lm.op2_recurrent_lm,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_language_id": language_id.op5_language_id,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_super_minhash": super_minhash.op10_super_minhash,
        "op11_spelling_variants": spelling_variants.op11_spelling_variants,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_learned_partitions": learned_partitions.op13_learned_partitions,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the other queries are tested against brute force."""
    return {
        "op3_url_filters": url_filters.ORACLE,
        "op4_token_counts": token_counts.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op10_super_minhash": super_minhash.ORACLE,
        "op11_spelling_variants": spelling_variants.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
    }
