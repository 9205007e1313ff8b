"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from wayloom.llm.bpe import op3_bpe
from wayloom.llm.conversations import OP12_SQL, op12_conversations
from wayloom.llm.decontaminate import OP1_SQL, op1_decontaminate
from wayloom.llm.html_text import op7_html
from wayloom.llm.language_id import op9_language
from wayloom.llm.minhash_dedup import OP4_SQL, op4_minhash_dedup
from wayloom.llm.mixing import op11_mixing
from wayloom.llm.sharding import op6_sharding
from wayloom.llm.suffix_dedup import op8_suffix_dedup
from wayloom.llm.toxicity import op2_toxicity
from wayloom.llm.url_filter import OP10_SQL, op10_url_filter
from wayloom.llm.vector_dedup import OP5_SQL, op5_vector_dedup
from wayloom.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_bpe, op4_minhash_dedup, op5_vector_dedup, op6_sharding, op7_html, op8_suffix_dedup, op9_language, op10_url_filter, op11_mixing, op12_conversations, op13_whitening)}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op4_minhash_dedup": OP4_SQL, "op5_vector_dedup": OP5_SQL, "op10_url_filter": OP10_SQL, "op12_conversations": OP12_SQL}
