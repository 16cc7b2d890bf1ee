"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, htmltext, langid, licences, ngram_join, packing, prefix_trie, repair, spelling, substring_dedup, tokens

_OPERATORS = [
    ngram_join.op1_ngram_jaccard_join,
    chat.op2_chat_formatting,
    repair.op3_token_id_output,
    packing.op4_best_fit_packing,
    htmltext.op5_html_extraction,
    decontaminate.op6_benchmark_decontamination,
    tokens.op7_token_counts,
    embeddings.op8_embedding_near_dedup,
    licences.op9_license_scan,
    langid.op10_language_id,
    spelling.op11_spelling_variants,
    prefix_trie.op12_conversation_prefix_trie,
    substring_dedup.op13_substring_dedup,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op6_benchmark_decontamination": decontaminate.ORACLE_SQL, "op8_embedding_near_dedup": embeddings.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_conversation_prefix_trie": prefix_trie.ORACLE_SQL, "op13_substring_dedup": substring_dedup.ORACLE_SQL}
