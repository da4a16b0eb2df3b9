"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from surveyloom.llm.balanced_shards import op9_balanced_shards
from surveyloom.llm.compression_quality import op2_compression_quality
from surveyloom.llm.decontaminate import OP3_SQL, op3_benchmark_decontamination
from surveyloom.llm.language_mixture import op7_language_mixture
from surveyloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from surveyloom.llm.ngram_join import OP6_SQL, op6_ngram_jaccard_join
from surveyloom.llm.packing import op4_best_fit_packing
from surveyloom.llm.personal_data import op10_personal_data
from surveyloom.llm.quality_rules import OP8_SQL, op8_quality_rules
from surveyloom.llm.token_counts import op5_token_counts

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_compression_quality": op2_compression_quality,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_mixture": op7_language_mixture,
    "op8_quality_rules": op8_quality_rules,
    "op9_balanced_shards": op9_balanced_shards,
    "op10_personal_data": op10_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
}
