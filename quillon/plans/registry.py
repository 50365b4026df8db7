"""All queries over the operators, and the SQL that checks them."""

from __future__ import annotations

from . import codec_queries, payload_queries, source_queries, study_queries, table_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
