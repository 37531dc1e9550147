"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op5_bpe
from .decontaminate import op1_decontaminate
from .linededup import OP2_SQL, op2_lines
from .phrases import op7_substrings
from .quality import op10_quality
from .rans import op8_rans
from .secrets import op3_secrets
from .simhash import op9_simhash
from .toxicity import op4_toxicity
from .urlfilter import OP6_SQL, op6_urls

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lines": op2_lines,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_urls": op6_urls,
    "op7_substrings": op7_substrings,
    "op8_rans": op8_rans,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op2_lines": OP2_SQL,
    "op6_urls": OP6_SQL,
}
