import pytest
from pyspark.sql import functions as F

from rowsmith.operators.workflow import Workflow, provided


def test_steps_fill_only_blanks_and_unknown_names_fail(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "own")], "k int, v string")
    w = Workflow()
    w.fill("v", "k", "v", lambda c: F.concat(F.lit("n"), c.cast("string")))
    w.fill("new", "v", "w", F.upper)
    assert sorted(map(tuple, w.run(df, ["v", "new"]).collect())) == [(1, "n1", "N1"), (2, "n2", "N2"), (3, "own", "OWN")]
    with pytest.raises(KeyError):
        w.run(df, ["none"])


def test_provider_is_not_asked_for_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    got = provided(df, "v", "answer", lambda texts: [t * 2 for t in texts])
    assert sorted(map(tuple, got.collect())) == [(1, "a", "aa"), (2, None, None), (3, "b", "bb")]
    assert provided(df.limit(0), "v", "answer", lambda texts: texts).count() == 0
