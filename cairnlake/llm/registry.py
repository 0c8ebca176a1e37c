"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from cairnlake.llm.byte_bpe import op3_byte_bpe
from cairnlake.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from cairnlake.llm.html_extract import op6_html_extract
from cairnlake.llm.imatch import op8_imatch
from cairnlake.llm.line_dedup import OP1_SQL, op1_line_dedup
from cairnlake.llm.mixing import op7_mixing
from cairnlake.llm.packing import op12_packing
from cairnlake.llm.quality_rules import OP4_SQL, op4_quality_rules
from cairnlake.llm.recompression import op9_recompression
from cairnlake.llm.resampling import op13_importance_resampling
from cairnlake.llm.simhash import op2_simhash
from cairnlake.llm.suffix_array import op5_suffix_array
from cairnlake.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_array": op5_suffix_array,
    "op6_html_extract": op6_html_extract,
    "op7_mixing": op7_mixing,
    "op8_imatch": op8_imatch,
    "op9_recompression": op9_recompression,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op11_hard_negatives": OP11_SQL,
}
