"""The corpus pipeline: its stages, its run, and its SQL (none), as nearfield.llm has them."""

from nearfield.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
