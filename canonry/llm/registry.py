"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import bpe, chat, fingerprints, html, jaccard, packing, phrases, quality, rules, runs, substrings, topk, urls

_MODULES = (urls, jaccard, chat, bpe, packing, phrases, quality, substrings, topk, html, fingerprints, phrases, rules, runs)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
