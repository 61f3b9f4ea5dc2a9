"""Stages of the pipeline return the input's own columns."""

from pyspark.sql import functions as F
from test_joins import SF

from cohortlens.llm import queries as Q


def test_columns_named_like_the_helpers_keep_their_values(spark):
    import corpus_pipeline as P

    docs = Q.read(spark, SF, "documents").limit(200)
    mine = docs.withColumns({c: F.col("doc_id") for c in ("Score", "lang_pred", "_lang_pred", "n_lines", "n_dropped")})
    for stage in (P.identify_language, P.dedup_lines):
        out, plain = stage(spark, mine, SF), stage(spark, docs, SF)
        assert out.columns == mine.columns
        rows = out.collect()
        assert rows and all({r[c] for c in ("Score", "lang_pred", "_lang_pred", "n_lines", "n_dropped")} == {r.doc_id} for r in rows)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
