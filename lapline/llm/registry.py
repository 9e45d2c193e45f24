"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lapline.llm import (
    alignment, bpe, jaccard, language, lines, neighbours, packing, positions, search, secrets, simhash, token_counts,
    urls,
)

QUERIES = {
    "op1_block_max_wand": search.op1_block_max_wand,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_url_rules": urls.op3_url_rules,
    "op4_bpe_automaton": bpe.op4_bpe_automaton,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_string_kernel": language.op7_string_kernel,
    "op8_packing": packing.op8_packing,
    "op9_multi_index": neighbours.op9_multi_index,
    "op10_secret_ledger": secrets.op10_secret_ledger,
    "op11_pointer_jumping": alignment.op11_pointer_jumping,
    "op12_simhash_ball": simhash.op12_simhash_ball,
    "op13_best_position": positions.op13_best_position,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": jaccard.OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op10_secret_ledger": secrets.OP10_SQL,
    "op13_best_position": positions.OP13_SQL,
}
