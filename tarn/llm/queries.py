"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op5_multiprobe
from .bpe import op4_byte_bpe
from .decontaminate import OP6_SQL, op6_decontaminate
from .langid import op7_language
from .lines import OP10_SQL, op10_line_dedup
from .ngram_lm import op9_deleted_interpolation
from .partenum import OP1_SQL, op1_partenum
from .quality import op3_rule_ensemble
from .shards import op8_sampled_splitters
from .substrings import OP2_SQL, op2_suffix_trees

QUERIES = {
    "op1_partenum": op1_partenum,
    "op2_suffix_trees": op2_suffix_trees,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_multiprobe": op5_multiprobe,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_sampled_splitters": op8_sampled_splitters,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {"op1_partenum": OP1_SQL, "op2_suffix_trees": OP2_SQL, "op6_decontaminate": OP6_SQL, "op10_line_dedup": OP10_SQL}
