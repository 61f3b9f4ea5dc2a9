"""Small-frame builders and comparison helpers for the tests."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.fixture import LOOKUP_SCHEMA, RAW_SCHEMA

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def ev(event_id, seconds, user="u1", name="Homepage_Viewed", action=None, page_type=None,
       country="PT", cohort="Control", version="9.80.1", language="en", login="guest",
       platform="android", when=None):
    ts = when if when is not None else T0 + dt.timedelta(seconds=seconds)
    return (event_id, ts.date(), name, action, page_type, ts, platform, user, login, language,
            version, country, cohort)


def raw_df(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, RAW_SCHEMA)


def lookup_df(spark: SparkSession, rows=(("PT", "Europe/Lisbon"),)) -> DataFrame:
    return spark.createDataFrame(list(rows), LOOKUP_SCHEMA)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def digest(cols, rows) -> tuple[str, int]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines)
