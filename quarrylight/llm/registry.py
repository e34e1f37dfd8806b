"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .decontaminate import OP5_SQL, op5_contamination
from .hamming import OP10_SQL, op10_exact_topk
from .hpylm import op6_lm_score
from .jaccard import op8_ngram_jaccard
from .langid import op1_language
from .maintext import op2_main_text
from .secrets import OP4_SQL, op4_secrets
from .tokenfile import op3_token_file
from .toxicity import op9_toxicity

QUERIES = {
    "op1_language": op1_language,
    "op2_main_text": op2_main_text,
    "op3_token_file": op3_token_file,
    "op4_secrets": op4_secrets,
    "op5_contamination": op5_contamination,
    "op6_lm_score": op6_lm_score,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_exact_topk": op10_exact_topk,
}

ORACLES = {
    "op4_secrets": OP4_SQL,
    "op5_contamination": OP5_SQL,
    "op10_exact_topk": OP10_SQL,
}
