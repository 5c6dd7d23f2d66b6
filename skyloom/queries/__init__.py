"""Every operator as a runnable query; see ``base.query``."""

from skyloom.queries import analysis, catalog, ingest, spatial, streams  # noqa: F401
from skyloom.queries.base import OPERATORS, ORACLES, QUERIES

__all__ = ["OPERATORS", "ORACLES", "QUERIES"]
