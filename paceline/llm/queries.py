"""The queries that the operators of this subpackage register."""

from __future__ import annotations

from importlib import import_module

MODULES = ["alignment", "collocations", "decontaminate", "html_text", "jaccard_join", "language_id", "language_model", "mixing", "packing", "quality", "token_files", "toxicity", "url_filter"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"paceline.llm.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
