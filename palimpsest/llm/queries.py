"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chaining import op8_substring_dups
from .decontaminate import op1_decontamination
from .hard_negatives import op11_hard_negatives
from .html_text import op6_html_text
from .language import op5_language
from .lexical import op12_lexical
from .near_dups import op2_near_duplicates
from .neighbours import op10_neighbours
from .oracles import ORACLES
from .packing import op7_packing
from .secrets import op4_secrets
from .simhash import op13_simhash
from .token_ids import op3_token_ids
from .toxicity import op9_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [op1_decontamination, op2_near_duplicates, op3_token_ids, op4_secrets, op5_language, op6_html_text, op7_packing, op8_substring_dups, op9_toxicity, op10_neighbours, op11_hard_negatives, op12_lexical, op13_simhash]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
