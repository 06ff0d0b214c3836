"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where it can express them."""

from __future__ import annotations

from lodestone.llm import decontamination, gif, lexical, licenses, line_dedup, mixing, repeats, sharding, simhash, token_counts, top_k, toxicity, vector_codes

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_licenses": licenses.op3_licenses,
    "op4_sharding": sharding.op4_sharding,
    "op5_simhash": simhash.op5_simhash,
    "op6_gif": gif.op6_gif,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_repeats": repeats.op8_repeats,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_lexical": lexical.op12_lexical,
    "op13_top_k": top_k.op13_top_k,
}

ORACLES = {
    "op3_licenses": licenses.OP3_SQL,
    "op8_repeats": repeats.OP8_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_top_k": top_k.OP13_SQL,
}
