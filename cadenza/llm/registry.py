"""The queries of this folder, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module of this folder.
_MODULES = {
    "op1_warc": "warc",
    "op2_decontamination": "decontamination",
    "op3_ngram_jaccard": "ngram_jaccard",
    "op4_token_counts": "token_counts",
    "op5_ann": "ann",
    "op6_toxicity": "toxicity",
    "op7_line_dedup": "line_dedup",
    "op8_sharding": "sharding",
    "op9_pii": "pii",
    "op10_mixing": "mixing",
    "op11_spelling": "spelling",
    "op12_sentencepiece": "sentencepieces",
    "op13_collocations": "collocations",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"cadenza.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"cadenza.llm.{module}"), "ORACLE", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
