"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_format
from .decontamination import op8_decontamination
from .language_id import op3_language_id
from .lm_scoring import op2_lm_scoring
from .neighbours import op9_nearest_neighbours
from .secrets import OP7_SQL, op7_secret_scan
from .sentencepiece_bpe import op4_sentencepiece
from .sharding import op10_sharding
from .simhash import op5_simhash_neardup
from .token_records import op6_token_records

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash_neardup": op5_simhash_neardup,
    "op6_token_records": op6_token_records,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op7_secret_scan": OP7_SQL,
}
