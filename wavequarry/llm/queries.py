"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from wavequarry.llm.byte_bpe import op5_byte_bpe
from wavequarry.llm.media_webp import op1_webp
from wavequarry.llm.packing import op2_packing
from wavequarry.llm.pii import op10_personal_data
from wavequarry.llm.quality import op9_quality
from wavequarry.llm.rank_array_bpe import op11_rank_array_bpe
from wavequarry.llm.sharding import op3_shards
from wavequarry.llm.simhash import op6_near_duplicates
from wavequarry.llm.source_divergence import OP13_SQL, op13_source_divergence
from wavequarry.llm.suffix_dedup import op8_repeats
from wavequarry.llm.token_alignment import op12_token_alignment
from wavequarry.llm.token_counts import op4_token_counts
from wavequarry.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_lossless_webp": op1_webp,
    "op2_bound_certified_packing": op2_packing,
    "op3_lpt_shards": op3_shards,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_url_filter": op7_url_filter,
    "op8_suffix_dedup": op8_repeats,
    "op9_quality_rules": op9_quality,
    "op10_information_pii": op10_personal_data,
    "op11_rank_array_bpe": op11_rank_array_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {"op13_source_divergence": OP13_SQL}
