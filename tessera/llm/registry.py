"""The queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.collocations import SQL as COLLOCATIONS
from tessera.llm.collocations import op13_collocations
from tessera.llm.hard_negatives import SQL as HARD_NEGATIVES
from tessera.llm.hard_negatives import op12_hard_negatives
from tessera.llm.html_text import op6_html_text
from tessera.llm.mixing import op8_mixing
from tessera.llm.packing import op11_packing
from tessera.llm.pieces import op1_pieces
from tessera.llm.piecewise import op9_piecewise
from tessera.llm.pii import op7_pii
from tessera.llm.quality_model import op5_quality_model
from tessera.llm.quality_rules import op4_quality_rules
from tessera.llm.simhash import op10_simhash
from tessera.llm.token_files import op2_token_files
from tessera.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_model": op5_quality_model,
    "op6_html_text": op6_html_text,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_piecewise": op9_piecewise,
    "op10_simhash": op10_simhash,
    "op11_packing": op11_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": HARD_NEGATIVES, "op13_collocations": COLLOCATIONS}
