"""Stored tables: bucketed layout without exchanges, atomic replacement by name, repeat-safe batches,
profiles from file footers."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import funnel, quality
from cohortlens.plans import Pipeline
from cohortlens.plans.pipeline import RESULT_BATCH
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources import sinks
from helpers import SF_SMALL, ev, lookup_df, raw_df
from test_plans import plan_nodes


def fresh(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kinds(df):
    return [n.getClass().getSimpleName() for n in plan_nodes(df)]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def under_exchanges(df):
    """Physical operators between each exchange and what it reads."""
    out = []
    for n in plan_nodes(df):
        if n.getClass().getSimpleName() == "ShuffleExchangeExec":
            names, n = [], n.child()
            while n.children().size() == 1 and n.getClass().getSimpleName() != "ShuffleExchangeExec":
                names.append(n.getClass().getSimpleName())
                n = n.children().apply(0)
            out.append(names + [n.getClass().getSimpleName()])
    return out


def recorded_run(p, out, monkeypatch, **kw):
    """``run`` with the data frames behind the tables it overwrites."""
    seen = {}
    plain = sinks.overwrite
    monkeypatch.setattr(sinks, "overwrite", lambda df, path, **k: (seen.update({path.split("/")[-1]: (df, kinds(df), under_exchanges(df))}),
                                                                   plain(df, path, **k)))
    return p.run(out, **kw), seen


def test_run_stages_read_the_layout_without_exchange(spark, monkeypatch):
    p = Pipeline.from_testdata(spark, SF_SMALL, run_date="2024-02-01")
    paths, seen = recorded_run(p, fresh(spark, "run"), monkeypatch, buckets=5)
    for name in ("sessions", "session_funnel"):
        assert "ShuffleExchangeExec" not in seen[name][1]
        assert same(spark.read.parquet(paths[name]), getattr(p, name))
    files = {f.split("_")[-1].split(".")[0] for f in spark.read.parquet(paths["clean_events"]).inputFiles()}
    assert files == {f"{k:05d}" for k in range(5)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cohortlens_")]


def test_sessions_of_users_all_split_into_small_slices(spark, monkeypatch):
    """Slices of two rows: the tasks that cut them are a shuffle's, not one per slice, a list of split users
    without a proven bound is not forced into a broadcast, and the sessions are the plain ones."""
    rows = [ev(k, 900 * (k * k % 701), user=f"u{k % 3}", name=f"E{k % 7}") for k in range(300)]
    plain = Pipeline(raw_df(spark, rows), lookup_df(spark))
    split = Pipeline(raw_df(spark, rows), lookup_df(spark), slice_opts=dict(rows_per_slice=2, max_hot_users=10**9))
    parts = []
    monkeypatch.setattr(sinks, "recorder", lambda name, df: name == "hot_rows" and parts.append((kinds(df), df.rdd.getNumPartitions())))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = split.sessions
        assert same(got, plain.sessions) and got.count() > 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(parts) == 1 and parts[0][1] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "BroadcastExchangeExec" not in parts[0][0]


def test_split_user_and_endless_session_in_the_layout(spark, monkeypatch):
    """A user of one endless session: no bucket holds the session, no exchange carries its events, and
    its string is put together from the parts."""
    rows = [ev(k, 60 * k, user="bot", name=f"E{k % 7}") for k in range(400)]
    rows += [ev(1000 + k, 4000 * k, user=f"u{k % 9}") for k in range(60)]
    opts = dict(rows_per_slice=50, max_hot_users=10**9)
    plain = Pipeline(raw_df(spark, rows), lookup_df(spark), run_date="2024-02-01")
    split = Pipeline(raw_df(spark, rows), lookup_df(spark), run_date="2024-02-01", slice_opts=opts)
    assert same(plain.sessions, split.sessions)
    paths, seen = recorded_run(split, fresh(spark, "run"), monkeypatch, buckets=4)
    for name in ("sessions", "session_funnel"):
        assert same(spark.read.parquet(paths[name]), getattr(plain, name))
        assert seen[name][2] and all(any("Aggregate" in op for op in ops) for ops in seen[name][2]), seen[name][2]
    bot = spark.read.parquet(paths["clean_events"]).filter("user_id = 'bot'")
    assert bot.select("session_id").distinct().count() == 1
    assert bot.groupBy(F.input_file_name()).count().count() > 1 and bot.select("_piece").distinct().count() >= 6
    seq = spark.read.parquet(paths["sessions"]).filter("user_id = 'bot'").first().session_seq
    assert seq == "|*|".join(f"E{k % 7}" for k in range(400))


def test_replace_table_keeps_old_rows_until_the_new_are_complete(spark):
    name = f"t_{uuid.uuid4().hex}"
    sinks.replace_table(spark.range(10), name)
    began = spark.table(name)  # a reader that began before
    boom = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(boom, name)
    assert spark.table(name).count() == 10 and len(sinks.versions(spark, name)) == 1
    sinks.replace_table(spark.range(25), name)
    assert spark.table(name).count() == 25 and began.count() == 10
    sinks.replace_table(spark.range(3).withColumn("extra", F.lit("x")), name, layout=sinks.Layout(("id",), 2))
    assert spark.table(name).columns == ["id", "extra"] and len(sinks.versions(spark, name)) == 2
    sinks.drop_table(spark, name)
    assert not spark.catalog.tableExists(name) and not sinks.versions(spark, name)


def test_readers_during_replacement_see_old_or_new(spark):
    name, sizes = f"t_{uuid.uuid4().hex}", {10, 20, 30, 40}
    sinks.replace_table(spark.range(10), name, keep=5)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(spark.table(name).count())
            except Exception as e:  # noqa: BLE001  a moment without the table
                seen.append(repr(e)[:200])

    reader = threading.Thread(target=read)
    reader.start()
    for n in (20, 30, 40):
        sinks.replace_table(spark.range(n), name, keep=5)
    stop.set()
    reader.join()
    assert set(seen) <= sizes and seen == sorted(seen)
    sinks.drop_table(spark, name)


def test_replace_table_refuses_a_plain_table(spark):
    name = f"t_{uuid.uuid4().hex}"
    spark.range(1).write.saveAsTable(name)
    with pytest.raises(ValueError):
        sinks.replace_table(spark.range(2), name)
    spark.sql(f"DROP TABLE {name}")


def test_tables_of_the_chain_by_name(spark):
    db = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db}")
    p = Pipeline.from_testdata(spark, SF_SMALL, run_date="2024-02-01")
    for _ in range(2):
        names = p.run_tables(db)
    for n in ("sessions", "session_funnel", "funnel_report"):
        assert same(spark.table(names[n]).select(*getattr(p, n).columns), getattr(p, n))
    assert spark.table(names["significance_results"]).count() == p.significance_results.count()
    assert "ShuffleExchangeExec" not in kinds(funnel.build_session_funnel(spark.table(names["clean_events"])))
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_batches_are_repeat_safe(spark):
    path = fresh(spark, "batches")

    def batch(day, test, n):
        return spark.range(n).select("id", F.lit(day).cast("date").alias("run_date"), F.lit(test).alias("test_name"))

    for _ in range(3):
        sinks.replace_batch(batch("2024-02-01", "a / b", 4), path, RESULT_BATCH)
    sinks.replace_batch(batch("2024-02-01", "other", 2), path, RESULT_BATCH)
    sinks.replace_batch(batch("2024-02-02", "a / b", 5), path, RESULT_BATCH)
    assert spark.read.parquet(path).count() == 11
    half = batch("2024-02-02", "a / b", 9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_batch(half.repartition(9), path, RESULT_BATCH)
    assert spark.read.parquet(path).count() == 11  # the batch before stands
    sinks.replace_batch(batch("2024-02-02", "a / b", 9), path, RESULT_BATCH)
    assert spark.read.parquet(path).count() == 15


def test_run_replaces_its_batch_when_asked(spark):
    out = fresh(spark, "run")
    p = Pipeline.from_testdata(spark, SF_SMALL, run_date="2024-02-01")
    for _ in range(2):
        paths = p.run(out, on_repeat="replace")
    assert spark.read.parquet(paths["significance_results"]).count() == p.significance_results.count()
    with pytest.raises(ValueError):
        p.run(out, on_repeat="sometimes")


def test_stored_profile_reads_footers(spark):
    rows = [ev(k, k * 90_000, user=None if k % 3 else "u", page_type=None) for k in range(20)]
    raw, path = raw_df(spark, rows), fresh(spark, "events")
    raw.repartition(3).write.parquet(path)
    out = quality.stored_profile(spark, path, raw.schema, cols=["user_id", "page_type", "event_datetime"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(event_date), MAX(event_date), COUNT(*), COUNT(user_id)" in plan
    got = out.first()
    want = raw.agg(F.min("event_date"), F.max("event_date")).first()
    assert tuple(got) == (want[0], want[1], 20, 13, 20, 0)
    raw.limit(0).write.mode("overwrite").parquet(path)
    assert tuple(quality.stored_profile(spark, path, raw.schema, cols=["user_id"]).first()) == (None, None, 0, 0)
