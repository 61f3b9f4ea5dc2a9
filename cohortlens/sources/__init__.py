from cohortlens.sources.fixture import country_timezone, raw_events, read_table  # noqa: F401
from cohortlens.sources.sinks import append, materialize, overwrite, replace_batch, replace_table  # noqa: F401
