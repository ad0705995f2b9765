"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from folioscope.llm.byte_bpe import op6_byte_bpe
from folioscope.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from folioscope.llm.language_id import op5_language_id
from folioscope.llm.mixing import op7_mixing
from folioscope.llm.pii import op2_pii
from folioscope.llm.sharding import op4_sharding
from folioscope.llm.simhash import op8_simhash
from folioscope.llm.token_files import op3_token_files
from folioscope.llm.topk import OP10_SQL, op10_topk
from folioscope.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_token_files, op4_sharding, op5_language_id, op6_byte_bpe, op7_mixing, op8_simhash, op9_toxicity, op10_topk)}

#: The others can't be expressed in SQL; tests hold them against brute force, round trips or held-out accuracy.
SQL = {"op1_exact_dedup": OP1_SQL, "op10_topk": OP10_SQL}
