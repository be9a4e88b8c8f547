"""The queries of this package, by name, and their SQL where there is one."""

from __future__ import annotations

from .fingerprints import op3_fingerprints
from .line_dedup import op5_line_dedup
from .main_text import op2_main_text
from .mixing import OP7_SQL, op7_mixing
from .near_dups import op4_near_duplicates
from .neighbours import op6_nearest
from .periodic_runs import OP12_SQL, op12_periodic_runs
from .repeats import op1_repeats
from .simhash_dups import op11_simhash_near_duplicates
from .token_alignment import op13_token_alignment
from .token_counts import op9_token_counts
from .toxicity import op8_toxicity
from .unigram import op10_sentencepiece

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_main_text": op2_main_text,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_nearest": op6_nearest,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_simhash_near_duplicates": op11_simhash_near_duplicates,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {"op7_mixing": OP7_SQL, "op12_periodic_runs": OP12_SQL}
