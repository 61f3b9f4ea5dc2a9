"""End-to-end compositions: raw events → clean events → session funnel → report → tests.

``Pipeline`` holds the inputs and parameters and builds each stage lazily as a DataFrame;
``run`` persists the stages as tables (create-or-replace, results appended), cutting lineage
at each persisted table as the warehouse pipeline does.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cohortlens import params as P
from cohortlens.operators import cleaning, funnel, profile, significance
from cohortlens.sources import fixture, sinks

#: One run of one test on one day is one batch of results.
RESULT_BATCH = ("run_date", "test_name")


@dataclass
class Pipeline:
    raw: DataFrame
    lookup: DataFrame
    gap_seconds: int = P.SESSION_GAP_SECONDS
    sep: str = "#"
    gap_basis: str = "utc"
    experiment: str = P.EXPERIMENT
    test_name: str = P.TEST_NAME
    alpha: float = P.ALPHA
    run_date: dt.date | str | None = None
    slice_opts: dict = field(default_factory=dict)
    # persist intermediate tables read by several consumers of one result (deduplicated
    # events, base, the session table under the tests); ``run`` persists every stage
    materialize: bool = True

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Pipeline":
        return cls(fixture.raw_events(spark, sf_dir), fixture.country_timezone(spark, sf_dir), **kw)

    @cached_property
    def base(self) -> DataFrame:
        """CL1 + CL3 + CL4 (the profiling table before sessions)."""
        return cleaning.build_base(self.raw, self.materialize)

    @cached_property
    def user_facets(self) -> DataFrame:
        """The distinct facts per user that DQ3, DQ5, DQ12 and V1–V3 ask for, made in one pass."""
        return self._keep(profile.user_facets(self.raw), "user_facets")

    @cached_property
    def report_bitmaps(self) -> DataFrame:
        """The report with users as bitmaps, for exact roll-ups (``funnel.roll_up``)."""
        sf = self._keep(self.session_funnel, "session_funnel")
        return self._keep(funnel.report_bitmaps(sf, self.experiment), "report_bitmaps")

    @cached_property
    def clean_events(self) -> DataFrame:
        return cleaning.build_clean_events(self.raw, self.lookup, gap_seconds=self.gap_seconds,
                                           sep=self.sep,
                                           gap_basis=self.gap_basis,
                                           **self.slice_opts)

    @cached_property
    def sessions(self) -> DataFrame:
        return funnel.build_sessions(self.clean_events)

    @cached_property
    def session_funnel(self) -> DataFrame:
        return funnel.build_session_funnel(self.clean_events)

    @cached_property
    def funnel_report(self) -> DataFrame:
        return self._report(self.session_funnel)

    @cached_property
    def significance_results(self) -> DataFrame:
        # two consumers (z and t tests): persist the session table once
        return self._results(self._keep(self.session_funnel, "session_funnel"))

    @property
    def _unique_sessions(self) -> bool:
        """Session ids cannot repeat across users: the key separator holds a character that a
        session number cannot hold and user ids do not end in it and digits."""
        return any(not c.isdigit() for c in self.sep)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return sinks.materialize(df, name) if self.materialize else df

    def _layout(self, spark: SparkSession, buckets: int | None) -> sinks.Layout:
        """Clean events as stored: a session's events lie in one bucket, so the session groupings need
        no exchange; where users are split, its events of one timeline part do, so that neither a
        split user nor an endless session is one bucket, and only its parts' sums are exchanged."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        piece = (cleaning.PIECE,) if cleaning.in_pieces(self.clean_events) else ()
        return sinks.Layout(("user_id", "session_id", *piece), n, ("user_id", "session_id", "event_ts"))

    def run(self, out_dir: str, buckets: int | None = None, on_repeat: str = "append") -> dict[str, str]:
        """Persist every table under ``out_dir`` (a shared location on a cluster).

        Each stage reads the table written before it, so a lost executor only recomputes
        the current stage. The clean table keeps event_id / UTC time / session number beside
        the public columns for deterministic ordering downstream; it is stored in ``buckets``
        (default: the shuffle partitions) by user and session, which the sessions and funnel
        stages read without shuffling events. ``on_repeat='append'`` adds a batch of results on
        every run, ``'replace'`` keeps one batch per run date and test.
        """
        if on_repeat not in ("append", "replace"):
            raise ValueError("on_repeat must be 'append' or 'replace'")
        out = out_dir.rstrip("/")
        paths = {n: f"{out}/{n}" for n in
                 ("clean_events", "sessions", "session_funnel", "funnel_report",
                  "significance_results")}
        spark = self.raw.sparkSession
        with sinks.intermediates(spark):
            clean = sinks.overwrite_bucketed(self.clean_events, paths["clean_events"], self._layout(spark, buckets))
            sinks.overwrite(funnel.build_sessions(clean), paths["sessions"])
            sinks.overwrite(funnel.build_session_funnel(clean), paths["session_funnel"])
            sf = spark.read.parquet(paths["session_funnel"])
            sinks.overwrite(self._report(sf), paths["funnel_report"], partition_by=["session_start_date"])
            if on_repeat == "append":
                sinks.append(self._results(sf), paths["significance_results"], partition_by=["run_date"])
            else:
                sinks.replace_batch(self._results(sf), paths["significance_results"], RESULT_BATCH)
        return paths

    def run_tables(self, database: str = "default", buckets: int | None = None) -> dict[str, str]:
        """The chain as catalog tables of ``database``, each replaced under its name without a moment
        in which it is missing (``sinks.replace_table``); results as in ``run(on_repeat='replace')``,
        in a table partitioned by batch. Returns the names."""
        names = {n: f"{database}.{n}" for n in
                 ("clean_events", "sessions", "session_funnel", "funnel_report", "significance_results")}
        spark = self.raw.sparkSession
        with sinks.intermediates(spark):
            sinks.replace_table(self.clean_events, names["clean_events"], layout=self._layout(spark, buckets))
            clean = spark.table(names["clean_events"])
            sinks.replace_table(funnel.build_sessions(clean), names["sessions"])
            sinks.replace_table(funnel.build_session_funnel(clean), names["session_funnel"])
            sf = spark.table(names["session_funnel"])
            sinks.replace_table(self._report(sf), names["funnel_report"], partition_by=["session_start_date"])
            sinks.replace_batch_table(self._results(sf), names["significance_results"], RESULT_BATCH)
        return names

    def _report(self, sf: DataFrame) -> DataFrame:
        return funnel.build_funnel_report(sf, self.experiment, unique_sessions=self._unique_sessions)

    def _results(self, sf: DataFrame) -> DataFrame:
        return significance.significance(sf, test_name=self.test_name, alpha=self.alpha, run_date=self.run_date)
