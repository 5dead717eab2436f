"""Operators for text collections that train language models. Nothing outside this subpackage imports it."""

from importlib import import_module

NAMES = ("queries_tokens", "queries_text", "queries_spans", "queries_cards")


def query_modules() -> list:
    return [import_module(f"{__name__}.{name}") for name in NAMES]
