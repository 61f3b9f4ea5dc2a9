from cohortlens.plans.pipeline import Pipeline  # noqa: F401
