"""Imports every module that registers queries."""

from . import clauses, combining, grouping, indexing, matching, ranked, scores, similar, spans, tokens, upkeep  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
