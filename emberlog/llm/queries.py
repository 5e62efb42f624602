"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module of this package that has it.
MODULES = {
    "op1_importance_resampling": "importance",
    "op2_quality_rules": "quality_rules",
    "op3_piece_sampling": "pieces",
    "op4_cost_balanced_packing": "packing",
    "op5_suffix_tree": "suffix_tree",
    "op6_chat_parts": "chat",
    "op7_url_sweep": "url_rules",
    "op8_matroska": "matroska",
    "op9_simhash_pigeonring": "simhash",
    "op10_byte_gru": "language",
    "op11_line_dedup": "line_dedup",
    "op12_conversation_repair": "repair",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"emberlog.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: hashed models, networks, samplers and repairs are tested in tests/llm."""
    from emberlog.llm import chat, filter_audit, line_dedup, url_rules

    return {"op6_chat_parts": chat.OP6_SQL, "op7_url_sweep": url_rules.OP7_SQL, "op11_line_dedup": line_dedup.OP11_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
