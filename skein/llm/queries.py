"""Queries and oracle SQL of the training-data operators, for __spark_entry__."""

from __future__ import annotations

import importlib

#: query: module of this package that defines it.
QUERIES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_sharding": "sharding",
    "op3_packing": "packing",
    "op4_byte_bpe": "byte_bpe",
    "op5_suffix_dedup": "suffix_dedup",
    "op6_pitman_yor": "lm",
    "op7_toxicity": "toxicity",
    "op8_imatch": "imatch",
    "op9_token_files": "token_files",
    "op10_near_dedup": "near_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"skein.llm.{at}"), name) for name, at in QUERIES.items()}


def oracle_sql() -> dict:
    out: dict = {}
    for at in dict.fromkeys(QUERIES.values()):
        out |= getattr(importlib.import_module(f"skein.llm.{at}"), "SQL", {})
    return out
