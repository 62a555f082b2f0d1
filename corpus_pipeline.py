"""The corpus pipeline, as ``STAGES``, ``run`` and ``ORACLE_SQL``; its stages are in ``siftlake.llm.pipeline``."""

from siftlake.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
