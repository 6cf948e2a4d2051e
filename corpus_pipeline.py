"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, mixing."""

from __future__ import annotations

from sparsewing.llm.stages import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
