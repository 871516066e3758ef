"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op4_byte_bpe
from .chat_format import OP3_SQL, op3_chat_format
from .embeddings import op11_embedding_duplicates
from .fingerprints import op6_fingerprints
from .licenses import op7_license_scan
from .near_duplicates import op9_near_duplicates
from .packing import op1_pack
from .phrases import OP12_SQL, op12_phrases
from .pii import op8_personal_data
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_rules import op5_quality_rules
from .secrets import op10_secret_scan
from .token_counts import op2_token_counts

QUERIES = {f.__name__: f for f in (op1_pack, op2_token_counts, op3_chat_format, op4_byte_bpe, op5_quality_rules, op6_fingerprints, op7_license_scan, op8_personal_data, op9_near_duplicates, op10_secret_scan, op11_embedding_duplicates, op12_phrases, op13_prefix_trie)}
SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op12_phrases": OP12_SQL, "op13_prefix_trie": OP13_SQL}
