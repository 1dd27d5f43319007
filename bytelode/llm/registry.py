"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from bytelode.llm.bestfit import op11_best_fit_pack
from bytelode.llm.chat import OP2_SQL, op2_chat_format
from bytelode.llm.decontaminate import OP3_SQL, op3_decontaminate
from bytelode.llm.embeddings import OP6_SQL, op6_embedding_dedup
from bytelode.llm.language import op9_language_id
from bytelode.llm.lines import OP10_SQL, op10_line_dedup
from bytelode.llm.minhash import OP1_SQL, op1_minhash_forest
from bytelode.llm.packing import op5_mixture_pack
from bytelode.llm.resampling import OP12_SQL, op12_importance_resample
from bytelode.llm.ring import op4_hash_ring
from bytelode.llm.spelling import OP13_SQL, op13_spelling_variants
from bytelode.llm.suffixes import op7_suffix_dedup
from bytelode.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_hash_ring": op4_hash_ring,
    "op5_mixture_pack": op5_mixture_pack,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_best_fit_pack": op11_best_fit_pack,
    "op12_importance_resample": op12_importance_resample,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL = {
    "op1_minhash_forest": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_importance_resample": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
