"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm.html_text import op5_tree_scoring
from pagelake.llm.langid import op6_hyperdimensional
from pagelake.llm.near_dups import op7_bottom_k
from pagelake.llm.nearest import op9_learned_partitions
from pagelake.llm.packing import op10_nnls_packing
from pagelake.llm.pieces import op3_streaming_pieces
from pagelake.llm.quality import op8_boosted_gam
from pagelake.llm.sharding import op1_hash_tree
from pagelake.llm.simhash import op2_simhash
from pagelake.llm.token_counts import op4_prefix_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree": op1_hash_tree,
    "op2_simhash": op2_simhash,
    "op3_streaming_pieces": op3_streaming_pieces,
    "op4_prefix_tokens": op4_prefix_tokens,
    "op5_tree_scoring": op5_tree_scoring,
    "op6_hyperdimensional": op6_hyperdimensional,
    "op7_bottom_k": op7_bottom_k,
    "op8_boosted_gam": op8_boosted_gam,
    "op9_learned_partitions": op9_learned_partitions,
    "op10_nnls_packing": op10_nnls_packing,
}

ORACLE_SQL: dict[str, str] = {}
