"""cohortlens: A/B-test funnel analytics as composable Spark DataFrame transformations.

Layers
------
sources/    readers (test-data fixture, parquet tables) and sinks (overwrite / append / materialize)
functions/  column-level helpers (epoch seconds, local time, event labels, p-values)
operators/  DataFrame -> DataFrame operators: quality checks, cleaning, sessionizing,
            validity checks, funnel, significance
plans/      end-to-end compositions of the operators and the DuckDB oracle SQL
"""

from cohortlens import params  # noqa: F401

__all__ = ["params"]
