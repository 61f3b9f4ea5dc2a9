"""The rows of greatest count of a large table, without a gather that grows with its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 12


def greatest(df: DataFrame, count: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of greatest ``count``, greatest first, ties to the smaller ``key`` (both long, not
    null, counts not negative; all rows, if fewer). The place of the cut is found first, by histograms of
    at most 2^12 groups over the leading bits of the counts and then, among equal counts, of the
    keys; so the last task sorts at most twice ``limit`` rows, however many partitions ``df`` has.
    ``df`` is read a few times: let it be a written table."""
    ordered = [F.desc(count), F.col(key)]
    top, tied, need = F.lit(False), F.lit(True), limit
    most = df.agg(F.max(count)).first()[0]
    if most is None or limit < 1:
        return df.limit(0)
    for value, bits in ((F.col(count), int(most).bit_length()), (F.bitwise_not(F.col(key)), 64)):
        shifts = list(range(bits - _BITS, 0, -_BITS)) + [0]
        for shift in shifts:
            digit = F.shiftright(value, shift)
            sizes = {r["d"]: r["n"] for r in df.filter(tied).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
            cut = None
            for d in sorted(sizes, reverse=True):
                if sizes[d] > need:
                    cut = d
                    break
                need -= sizes[d]
            if cut is None:
                return df.filter(top | tied).orderBy(*ordered)
            top, tied = top | (tied & (digit > cut)), tied & (digit == cut)
            if sizes[cut] <= limit:
                return df.filter(top | tied).orderBy(*ordered).limit(limit)
    return df.filter(top | tied).orderBy(*ordered).limit(limit)  # rows equal in both
