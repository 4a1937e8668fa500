"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op4_nearest
from .bpe import op2_bpe
from .dedup import op7_near_duplicates
from .html import op3_html
from .lexical import OP12_SQL, op12_lexical_search
from .lines import OP13_SQL, op13_line_dedup
from .mixing import OP8_SQL, op8_source_mix
from .pii import op5_pii
from .ppm import op6_lm_score
from .quality import OP10_SQL, op10_quality_rules
from .suffixes import op9_suffix_dedup
from .toxicity import op1_toxicity
from .variants import op11_spelling_variants

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_html": op3_html,
    "op4_nearest": op4_nearest,
    "op5_pii": op5_pii,
    "op6_lm_score": op6_lm_score,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_source_mix": op8_source_mix,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE = {
    "op8_source_mix": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
