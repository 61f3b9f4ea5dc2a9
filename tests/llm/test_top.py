"""The cut of greatest counts against a sort in Python."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm._top import greatest


@pytest.mark.parametrize("most", [1, 7, 5_000, 2**40])
def test_greatest_equals_a_sort(spark, most):
    rng = random.Random(most)
    rows = [(rng.randrange(-2**63, 2**63), rng.randint(1, most)) for _ in range(3_000)]
    rows += [(-2**63, 1), (2**63 - 1, most), (0, 1)]
    df = spark.createDataFrame(rows, "w long, c long").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for limit in (1, 40, 3_002, 10_000):
        assert [tuple(r) for r in greatest(df, "c", "w", limit).collect()] == want[:limit]


def test_greatest_of_nothing_and_of_equal_rows(spark):
    df = spark.range(0).select(F.col("id").alias("w"), F.col("id").alias("c"))
    assert greatest(df, "c", "w", 5).collect() == []
    same = spark.range(50).select(F.lit(3).cast("long").alias("w"), F.lit(2).cast("long").alias("c"))
    assert greatest(same, "c", "w", 8).count() == 8 and greatest(same, "c", "w", 0).count() == 0
