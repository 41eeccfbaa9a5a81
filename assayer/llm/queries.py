"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import jaccard_join, near_dedup, substring_dedup, top_k, treap_search, warc
from assayer.llm.alignment import op11_alignment
from assayer.llm.brown import op10_brown
from assayer.llm.decontaminate import op1_decontaminate
from assayer.llm.jaccard_join import op13_jaccard_join
from assayer.llm.language_id import op2_language_id
from assayer.llm.licences import op6_licences
from assayer.llm.near_dedup import op7_near_dedup
from assayer.llm.packing import op9_packing
from assayer.llm.substring_dedup import op5_substring_dedup
from assayer.llm.top_k import op3_top_k
from assayer.llm.toxicity import op4_toxicity
from assayer.llm.treap_search import op12_treap_search
from assayer.llm.warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_top_k": op3_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_licences": op6_licences,
    "op7_near_dedup": op7_near_dedup,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_brown": op10_brown,
    "op11_alignment": op11_alignment,
    "op12_treap_search": op12_treap_search,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op3_top_k": top_k.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_near_dedup": near_dedup.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op12_treap_search": treap_search.ORACLE_SQL,
    "op13_jaccard_join": jaccard_join.ORACLE_SQL,
}
