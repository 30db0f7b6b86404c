"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL`` of ``cairn.llm.pipeline``, registered as ``pipeline``."""

from __future__ import annotations

from cairn.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
