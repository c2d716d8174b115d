"""The thin queries of this subpackage's operators."""

from __future__ import annotations

from threadloom.llm import divergence, mixing, prefix_trie, top_k
from threadloom.llm.divergence import op11_divergence
from threadloom.llm.language_model import op8_language_model
from threadloom.llm.media import op9_media
from threadloom.llm.mixing import op3_mixing
from threadloom.llm.packing import op4_packing
from threadloom.llm.prefix_trie import op12_prefix_trie
from threadloom.llm.quality import op5_quality
from threadloom.llm.sharding import op1_sharding
from threadloom.llm.simhash import op7_simhash
from threadloom.llm.substrings import op10_substrings
from threadloom.llm.token_counts import op2_token_counts
from threadloom.llm.top_k import op6_top_k
from threadloom.llm.url_filter import op13_url_filter

QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_mixing, op4_packing, op5_quality, op6_top_k, op7_simhash, op8_language_model, op9_media, op10_substrings, op11_divergence, op12_prefix_trie, op13_url_filter)}
ORACLES: dict[str, str] = {"op3_mixing": mixing.SQL.format(documents="documents"), "op6_top_k": top_k.SQL, "op11_divergence": divergence.SQL, "op12_prefix_trie": prefix_trie.SQL}
