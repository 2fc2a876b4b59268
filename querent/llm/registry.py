"""The corpus queries and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from querent.llm import chat_format, exact_dedup, hilbert_shards, language_id, license_scan, line_dedup, mixing, packing, simhash, topk_search


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_hilbert_shards": hilbert_shards.op2_hilbert_shards,
        "op3_mixing": mixing.op3_mixing,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_simhash": simhash.op7_simhash,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_topk_search": topk_search.op9_topk_search,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.OP1_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op9_topk_search": topk_search.OP9_SQL,
    }
