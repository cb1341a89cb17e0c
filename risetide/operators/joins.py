"""Join helpers for keys that may be heavily skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32


def salted_lookup(
    left: DataFrame, right: DataFrame, on: str, spread_by: Column, how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join `left` to `right` on one column whose values may be hot on the left side.

    `right` holds at most one row per key and is narrow. Every left row gets a salt from
    `spread_by` (a column that differs between rows sharing a key), every right row is repeated
    once per salt, so one hot key is spread over `salts` tasks. There is no broadcast hint:
    Spark broadcasts the right side only if its measured size is under the threshold. Null left
    keys match nothing; the salt spreads them too.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    lhs = left.withColumn("_salt", salt)
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [on, "_salt"], how).drop("_salt")
