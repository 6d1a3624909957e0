"""Every query of the package over whole small tables."""

import pytest

from textloom.llm import oracle, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.SQL)))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, DIR)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    assert len(rows) > 0


def test_shares_meet_their_targets(spark):
    """What is taken of a source differs from the water-filled plan by less than one record."""
    from pyspark.sql import functions as F

    from textloom.llm import mixture
    from textloom.sources.tables import table

    tokens = mixture.counted(table(spark, DIR, "documents"), "doc_id", "text", "source").cache()
    targets = table(spark, DIR, "mix_targets")
    plan = mixture.plan(tokens, targets)
    largest = {r.source: r.n for r in tokens.groupBy("source").agg(F.max("n_tokens").alias("n")).collect()}
    got = {r.source: r for r in queries.p7_shares(spark, DIR).collect()}
    most = {r.source: r.max_repeats for r in targets.collect()}
    assert set(got) == {r.source for r in targets.collect()}
    for source, x in plan.items():
        assert abs(got[source].tokens - x["take"]) <= largest.get(source, 0) + 1
    assert all(r.repeats <= most[r.source] for r in queries.p7_mixture(spark, DIR).collect())
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
