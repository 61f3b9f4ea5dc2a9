"""Input tables.

The analysed pipeline reads two warehouse tables, raw events and a country -> time zone lookup.
Real deployments point :func:`read_events` / :func:`read_lookup` at those tables. For the test
data in ``/root/testdata/sf*/`` the same shape is derived from the generic ``events`` and
``nation`` tables (see FIXTURES.md §3), with quirks that exercise every cleaning rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("page_type", T.StringType()),
    T.StructField("event_datetime", T.TimestampNTZType()),
    T.StructField("platform", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("login_status", T.StringType()),
    T.StructField("app_language", T.StringType()),
    T.StructField("release_version", T.StringType()),
    T.StructField("ip_country", T.StringType()),
    T.StructField("cohort", T.StringType()),
])

LOOKUP_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("timezone", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw events stored in the warehouse layout (columns of ``RAW_SCHEMA``)."""
    return spark.read.format(fmt).schema(RAW_SCHEMA).load(path)


def read_lookup(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(LOOKUP_SCHEMA).load(path)


def _case(value: Column, mapping: list[tuple[object, object]], default=None) -> Column:
    out = None
    for k, v in mapping:
        cond = value == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default) if default is not None else F.lit(None))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw A/B-test events derived from ``events`` (FIXTURES.md §3) in one scan.

    Every event yields itself, an exact duplicate when event_id % 50 = 0 and a same-instant
    'Homepage_Viewed' echo (event_id + 1e9) when event_id % 25 = 1, via ``explode``: one pass,
    no shuffle, partitioned like the scan.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    # k parsed once per row (a separate projection, so it is not inlined at every use)
    ev = ev.withColumn("_k", F.regexp_extract("props", r"([0-9]+)", 1).cast("int"))
    k = F.col("_k")
    uid = F.col("user_id")
    eid = F.col("event_id")
    et = F.col("event_type")
    click = et == F.lit("click")
    d = ev.select(
        F.col("event_id"),
        F.col("ts").cast("date").alias("event_date"),
        _case(et, [("signup", "Homepage_Viewed"), ("click", "Search_Event"),
                   ("error", "Destination_Search_Page_Viewed"), ("view", "view_item")],
              "purchase").alias("event_name"),
        F.when(click & (k % 2 == 0), F.lit("Search Activated"))
         .when(click, F.lit("Search Submitted")).alias("action"),
        F.when(click & (k % 10 == 7), F.lit(None).cast("string"))
         .when(click & (k % 10 == 9), F.lit("Homepage"))
         .when(click, F.lit("Destination Search")).alias("page_type"),
        F.when(eid % 307 != 11, F.col("ts")).alias("event_datetime"),
        F.lit("android").alias("platform"),
        F.when(eid % 211 != 5, F.concat(F.lit("u"), uid.cast("string"))).alias("user_id"),
        F.when(uid % 2 == 0, F.lit("logged_in")).otherwise(F.lit("guest")).alias("login_status"),
        _case(uid % 5, [(0, "en"), (1, "pt"), (2, "es"), (3, "fr")], "de").alias("app_language"),
        F.when(k == 50, F.lit(None).cast("string")).otherwise(F.concat(
            F.when(k == 13, F.lit("staging-")).otherwise(F.lit("")), F.lit("9."),
            (F.lit(79) + uid % 3).cast("string"), F.lit("."), (k % 4).cast("string")))
         .alias("release_version"),
        F.when(eid % 97 != 3, F.concat(
            F.lit("NATION_"), ((uid + F.when(k == 0, F.lit(1)).otherwise(F.lit(0))) % 25).cast("string")))
         .alias("ip_country"),
        F.when(eid % 173 == 9, F.lit(None).cast("string"))
         .when(uid % 4 == 0, F.lit("Control"))
         .when((uid % 10 == 7) & (k >= 90), F.lit("Control"))
         .otherwise(F.lit("Variation")).alias("cohort"),
    )
    # copy kind: 0 = the event, 1 = exact duplicate, 2 = same-instant echo. Only the kind is
    # exploded, so columns a query does not use still prune down to the scan.
    kinds = F.array(F.lit(0), F.when(eid % 50 == 0, F.lit(1)), F.when(eid % 25 == 1, F.lit(2)))
    x = d.select("*", F.explode(F.filter(kinds, lambda c: c.isNotNull())).alias("_kind"))
    echo = F.col("_kind") == F.lit(2)
    none = F.lit(None).cast("string")
    return x.select(
        F.when(echo, eid + F.lit(1_000_000_000)).otherwise(eid).alias("event_id"), "event_date",
        F.when(echo, F.lit("Homepage_Viewed")).otherwise(F.col("event_name")).alias("event_name"),
        F.when(echo, none).otherwise(F.col("action")).alias("action"),
        F.when(echo, none).otherwise(F.col("page_type")).alias("page_type"), "event_datetime",
        "platform", "user_id", "login_status", "app_language", "release_version", "ip_country",
        "cohort")


def country_timezone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country -> IANA zone lookup from ``nation``: padded, null and missing zones included."""
    n = read_table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.filter(key % 6 != 5).select(
        F.col("n_name").alias("country"),
        _case(key % 4, [(0, "Europe/Lisbon"), (1, " America/New_York "), (2, "Asia/Tokyo")])
        .cast("string").alias("timezone"))
