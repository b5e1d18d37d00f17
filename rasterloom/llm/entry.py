"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from rasterloom.llm.bpe import op1_bpe
from rasterloom.llm.chat import OP7_SQL, op7_chat_format
from rasterloom.llm.conversations import OP11_SQL, op11_conversation_repair
from rasterloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from rasterloom.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from rasterloom.llm.language_model import op13_language_model
from rasterloom.llm.media import op10_ogg_media
from rasterloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from rasterloom.llm.packing import op4_best_fit_packing
from rasterloom.llm.quality import op2_quality
from rasterloom.llm.sharding import op5_ring_shards
from rasterloom.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from rasterloom.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ring_shards": op5_ring_shards,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ogg_media": op10_ogg_media,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_model": op13_language_model,
}
ORACLES = {"op3_jaccard_join": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
