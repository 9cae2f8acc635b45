"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from memspark.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from memspark.llm.mixing import op10_mixing
from memspark.llm.packing import op3_best_fit_packing
from memspark.llm.quality import op8_quality
from memspark.llm.search import OP5_SQL, op5_topk_search
from memspark.llm.sharding import op9_sharding
from memspark.llm.simhash import op1_simhash_dedup
from memspark.llm.substring_dedup import op6_substring_dedup
from memspark.llm.token_counts import op4_token_counts
from memspark.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_topk_search": op5_topk_search,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op5_topk_search": OP5_SQL,
}
