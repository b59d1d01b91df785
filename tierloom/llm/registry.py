"""Queries of the training-data operators and their DuckDB oracles.

No SQL: op2 (alignment), op7 (disclosure and match positions), op9 (a trained
model), op10 (compression) and op12 (an approximate search). Those are tested
against brute force.
"""

from __future__ import annotations

from tierloom.llm.chat_format import OP3_SQL, op3_chat_format
from tierloom.llm.decontamination import op2_decontamination
from tierloom.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tierloom.llm.license_scan import op10_license_scan
from tierloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from tierloom.llm.mixing import OP8_SQL, op8_mixing
from tierloom.llm.near_dedup import OP4_SQL, op4_near_dedup
from tierloom.llm.neighbours import op12_neighbours
from tierloom.llm.pii import op7_pii
from tierloom.llm.quality_classifier import op9_quality_classifier
from tierloom.llm.quality_rules import OP6_SQL, op6_quality_rules
from tierloom.llm.ranked_search import OP13_SQL, op13_ranked_search
from tierloom.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_neighbours": op12_neighbours,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
