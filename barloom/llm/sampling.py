"""A bounded sample of rows, the same in every run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame


def first_by_hash(df: DataFrame, k: int, hashed: Column, *ties: Column) -> DataFrame:
    """The first ``k`` rows by a 64-bit hash, then by ``ties``.

    Rows above a hash that about ``k`` rows lie below are left out first, so what meets in
    one task follows ``k`` and not ``k`` times the number of tasks. The rows are the same as
    without that step. Of more rows with one hash, as many copies have, each task hands
    on ``k`` at most.
    """
    total = df.count()
    share = (k + 6 * math.sqrt(k) + 10) / max(total, 1)
    while share < 1:
        below = df.where(hashed < int(share * 2**64) - 2**63)
        if below.count() >= k:
            df = below
            break
        share *= 2
    return df.orderBy(hashed, *ties).limit(k)
