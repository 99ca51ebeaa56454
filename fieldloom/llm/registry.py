"""The subpackage's queries and their SQL."""

from __future__ import annotations

from fieldloom.llm import byte_bpe, chat_template, embedding_dedup, minhash_dedup, mixing, periodic_runs, pii, sentencepiece_codec, substring_dedup, token_alignment, topk_search, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_chat_format": chat_template.op2_chat_format,
    "op3_minhash": minhash_dedup.op3_minhash,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_pii": pii.op7_pii,
    "op8_topk": topk_search.op8_topk,
    "op9_mix": mixing.op9_mix,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLES = {
    "op2_chat_format": chat_template.OP2_SQL,
    "op3_minhash": minhash_dedup.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op8_topk": topk_search.OP8_SQL,
    "op9_mix": mixing.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
