"""Queries over the benchmark tables, one for each operator, with the SQL each is held against."""

from . import code, findings, logs, paths, scalars
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "findings", "logs", "paths", "scalars"]
