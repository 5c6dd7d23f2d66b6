"""Operators of a training-data pipeline over large text tables, with their queries."""

from skyloom.llm import query_op1, query_op2, query_op3, query_op4, query_op5, query_op6, query_op7, query_op8, query_op9, query_op10, query_op11, query_op12, query_op13  # noqa: F401
from skyloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
