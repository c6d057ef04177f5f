"""Conversational product-search analytics as Spark jobs over tables of items, messages and sessions."""

from parley.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
