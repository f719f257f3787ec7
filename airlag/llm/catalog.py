"""Queries of the training-data operators and their plain-SQL twins."""

from __future__ import annotations

import corpus_pipeline
from airlag.llm import (
    language_id,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    ranked_search,
    sharding,
    substring_dedup,
    token_counts,
    tokenizer_alignment,
    url_filter,
    vector_search,
    warc,
)

QUERIES = {f.__name__: f for f in (
    packing.op1_pack_documents, sharding.op2_shard_documents, warc.op3_warc,
    substring_dedup.op4_substring_dedup, quality_rules.op5_quality_rules,
    ngram_join.op6_ngram_jaccard, vector_search.op7_top_k_search,
    language_id.op8_language_id, mixing.op9_mix_documents, url_filter.op10_url_filter,
    token_counts.op11_token_counts, ranked_search.op12_ranked_search, tokenizer_alignment.op13_tokenizer_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL = {
    "op7_top_k_search": vector_search.OP7_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
}
