"""Queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op6
from .chat import op7
from .decontaminate import op4
from .embedding_dedup import op5
from .ngram_lm import op2
from .oracles import ORACLES
from .quality import op8
from .simhash import op9
from .store import op10
from .substring_dedup import op3
from .toxicity import op1

QUERIES = {
    "op1_toxicity": op1,
    "op2_ngram_lm": op2,
    "op3_substring_dedup": op3,
    "op4_decontaminate": op4,
    "op5_embedding_dedup": op5,
    "op6_byte_bpe": op6,
    "op7_chat": op7,
    "op8_quality": op8,
    "op9_simhash": op9,
    "op10_store": op10,
}

__all__ = ["ORACLES", "QUERIES"]
