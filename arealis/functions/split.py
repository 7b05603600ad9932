"""Deterministic row hash for splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# The "minimal standard" multiplicative generator of Park and
# Miller, with the multiplier they recommended later.
MODULUS = 2_147_483_647
MULTIPLIER = 48_271


def row_hash(df: DataFrame, id_cols: Sequence[str], seed: int = 1) -> Column:
    """A number in ``0..MODULUS-1`` that depends only on the id columns and the seed.

    Every id is folded in with one step of the generator and three more steps
    mix the result.  All products stay far below 2**63, and the same integer
    arithmetic can be written in any SQL dialect.
    """
    if not id_cols:
        raise ValueError("at least one id column is needed")
    state: Column = F.lit(seed % MODULUS).cast("bigint")
    for name in id_cols:
        value = F.col(name)
        if not isinstance(df.schema[name].dataType, IntegralType):
            value = F.xxhash64(value)
        state = F.pmod((state + F.pmod(value.cast("bigint"), F.lit(MODULUS))) * MULTIPLIER, F.lit(MODULUS))
    for _ in range(3):
        state = F.pmod(state * MULTIPLIER, F.lit(MODULUS))
    return state


def split_percentile(df: DataFrame, id_cols: Sequence[str]) -> Column:
    """The row hash as a number in ``0..99``."""
    return F.floor(row_hash(df, id_cols) * 100 / MODULUS).cast("int")
