"""The subpackage's registered queries and the SQL that states them, where SQL can."""

from __future__ import annotations

from .alignment import op11_alignment
from .embedding_dedup import op8_embedding_dedup
from .language_model import op10_language_model
from .line_dedup import ORACLE_OP4, op4_line_dedup
from .mixing import ORACLE_OP3, op3_mixing
from .nearest import op6_nearest
from .packing import op9_packing
from .sharding import op7_sharding
from .simhash import op5_simhash
from .suffix_index import op12_suffix_dedup
from .token_counts import op1_token_counts
from .toxicity import op2_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_nearest": op6_nearest,
    "op7_sharding": op7_sharding,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_packing": op9_packing,
    "op10_language_model": op10_language_model,
    "op11_alignment": op11_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op3_mixing": ORACLE_OP3, "op4_line_dedup": ORACLE_OP4}
