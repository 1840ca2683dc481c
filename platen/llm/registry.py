"""The corpus queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from platen.llm.byte_bpe import op5_byte_bpe
from platen.llm.conversations import op13_conversation_repair
from platen.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from platen.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from platen.llm.fingerprints import op4_fingerprints
from platen.llm.language_id import op6_language_id
from platen.llm.nearest import op11_nearest
from platen.llm.packing import op2_best_fit_packing
from platen.llm.quality import op3_quality
from platen.llm.simhash_dedup import op7_simhash_near_dedup
from platen.llm.suffix_dedup import op1_suffix_dedup
from platen.llm.toxicity import op9_toxicity
from platen.llm.url_filters import op10_url_filters

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_url_filters": op10_url_filters,
    "op11_nearest": op11_nearest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op8_exact_dedup": OP8_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
