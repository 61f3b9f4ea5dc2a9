from cohortlens.operators import (  # noqa: F401
    cleaning, funnel, quality, significance, timeline, validity,
)
