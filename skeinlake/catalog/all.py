"""Gathers every named query."""

from . import diffs, extraction, extras, graphs, inventory, queries, rendering, rules, streams, trends  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
