"""The text operators as queries over whole tables, and their SQL where SQL can express them."""
from __future__ import annotations

from coldwatch.llm import prefix_trie, resampling, sharding
from coldwatch.llm.fingerprints import op9_fingerprints
from coldwatch.llm.languages import op10_language_id
from coldwatch.llm.minhash import op2_minhash
from coldwatch.llm.mixing import op1_mixing
from coldwatch.llm.pieces import op7_pieces
from coldwatch.llm.secrets import op6_secret_scan
from coldwatch.llm.suffixes import op8_suffix_dedup
from coldwatch.llm.token_counts import op5_token_counts
from coldwatch.llm.token_records import op4_token_records
from coldwatch.llm.vectors import op3_vectors

QUERIES = {f.__name__: f for f in (op1_mixing, op2_minhash, op3_vectors, op4_token_records, op5_token_counts, op6_secret_scan, op7_pieces, op8_suffix_dedup, op9_fingerprints, op10_language_id,
                                   resampling.op11_resampling, prefix_trie.op12_prefix_trie, sharding.op13_sharding)}

ORACLES: dict[str, str] = {"op11_resampling": resampling.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_sharding": sharding.ORACLE}
