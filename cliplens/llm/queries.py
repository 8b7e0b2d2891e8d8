"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

PARTS = ["q_decontaminate", "q_tokens", "q_chat", "q_sharding", "q_language", "q_lines",
         "q_simhash", "q_bpe", "q_linkgraph", "q_topk", "q_merkle", "q_ranked", "q_packing"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in PARTS:
        found.update(getattr(importlib.import_module(f"cliplens.llm.{name}"), attribute))
    return found


def queries() -> dict:
    return {**_collect("QUERIES"), "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
