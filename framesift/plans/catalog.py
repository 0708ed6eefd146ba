"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import q_plans, q_rank, q_runs, q_state, q_text, q_time
from .tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "q_plans", "q_rank", "q_runs", "q_state", "q_text", "q_time"]
