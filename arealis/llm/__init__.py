"""Operators for large training corpora, their queries and their SQL."""

from arealis.llm.oracle import ORACLE
from arealis.llm.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
