"""A training corpus from the table documents: STAGES, run and ORACLE_SQL, as odlake.llm.pipeline defines them."""

from __future__ import annotations

from odlake.llm.pipeline import ORACLE_SQL, STAGES, encoded, leaked, masked, near_duplicates, run, toxic

__all__ = ["ORACLE_SQL", "STAGES", "encoded", "leaked", "masked", "near_duplicates", "run", "toxic"]
