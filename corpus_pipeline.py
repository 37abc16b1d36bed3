"""The document pipeline: its stages, how to run them, and their SQL."""

from phrasegraph.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
