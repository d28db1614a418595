"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from tenura.llm import (
    conversations,
    jaccard,
    langid,
    neardup,
    packing,
    pieces,
    quality,
    resampling,
    retrieval,
    sharding,
    template,
    topk,
    toxicity,
)

QUERIES = {
    "op1_exact_top_k": topk.query,
    "op2_toxicity": toxicity.query,
    "op3_language_id": langid.query,
    "op4_quality": quality.query,
    "op5_best_fit_packing": packing.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_html_main_text": template.query,
    "op8_sentencepiece": pieces.query,
    "op9_embedding_near_dedup": neardup.query,
    "op10_hilbert_sharding": sharding.query,
    "op11_conversation_repair": conversations.query,
    "op12_importance_resampling": resampling.query,
    "op13_retrieval_packing": retrieval.query,
}
ORACLES = {"op1_exact_top_k": topk.SQL, "op11_conversation_repair": conversations.SQL}
