"""The query catalogue: every operator on the test tables, and the SQL it must agree with."""

from arealis.plans.catalogue import QUERIES
from arealis.plans.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]
