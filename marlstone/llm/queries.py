"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import oracles
from marlstone.llm.bpe import op9
from marlstone.llm.cross_polytope import op13
from marlstone.llm.embedding_links import op7
from marlstone.llm.html_text import op10
from marlstone.llm.jaccard_join import op6
from marlstone.llm.language_crf import op1
from marlstone.llm.packing import op4
from marlstone.llm.prefix_trie import op12
from marlstone.llm.quality_fm import op8
from marlstone.llm.quality_rules import op3
from marlstone.llm.secrets import op2
from marlstone.llm.toxicity import op5
from marlstone.llm.whitening import op11

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_language": op1,
    "op2_credential_linking": op2,
    "op3_line_first_cleaning": op3,
    "op4_exact_complement_packing": op4,
    "op5_noisy_channel_toxicity": op5,
    "op6_multi_order_jaccard": op6,
    "op7_rotated_codes": op7,
    "op8_factorisation_machine": op8,
    "op9_duckdb_bpe": op9,
    "op10_tag_path_ratios": op10,
    "op11_welford_whitening": op11,
    "op12_prefix_trie": op12,
    "op13_cross_polytope": op13,
}
ORACLES: dict[str, str] = oracles.sql()
