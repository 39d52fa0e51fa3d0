"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from assaygrid.llm.op01_tokens import op1_token_counts
from assaygrid.llm.op02_repeats import op2_repeated_strings
from assaygrid.llm.op03_embeddings import OP3_SQL, op3_embedding_near_duplicates
from assaygrid.llm.op04_language import op4_language_id
from assaygrid.llm.op05_html import op5_main_text
from assaygrid.llm.op06_toxicity import op6_toxicity
from assaygrid.llm.op07_decontaminate import op7_benchmark_decontamination
from assaygrid.llm.op08_minhash import op8_minhash_near_duplicates
from assaygrid.llm.op09_mixing import op9_mix_sources, op9_sql
from assaygrid.llm.op10_secrets import op10_secret_scan
from assaygrid.llm.op11_conversations import op11_conversation_repair, op11_sql
from assaygrid.llm.op12_merkle import op12_merkle_manifest, op12_sql
from assaygrid.llm.op13_quality import op13_quality_classifier

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_repeated_strings,
        op3_embedding_near_duplicates,
        op4_language_id,
        op5_main_text,
        op6_toxicity,
        op7_benchmark_decontamination,
        op8_minhash_near_duplicates,
        op9_mix_sources,
        op10_secret_scan,
        op11_conversation_repair,
        op12_merkle_manifest,
        op13_quality_classifier,
    )
}
SQL: dict[str, str] = {
    "op3_embedding_near_duplicates": OP3_SQL,
    "op9_mix_sources": op9_sql(),
    "op11_conversation_repair": op11_sql(),
    "op12_merkle_manifest": op12_sql(),
}
