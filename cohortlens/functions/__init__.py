from cohortlens.functions.columns import (  # noqa: F401
    epoch_micros, epoch_seconds, event_label, local_time, seconds_between, zone_or_default,
)
