"""Findings of the second round: each test failed before its fix."""

import numpy as np

from caseloom.operators import search as se


def test_queries_never_live_in_the_plan(spark):
    """Once a loop of blocks on the driver; now one plan, of the same shape however many queries or chunks there are."""
    rows = [(n, np.random.default_rng(n).normal(size=4).tolist()) for n in range(60)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    several, one = se.nearest(queries, items, 3, "l2", 7), se.nearest(queries, items, 3, "l2")
    few = se.nearest(queries.limit(2), items, 3, "l2")
    steps = [df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for df in (several, one, few)]
    assert steps == [3, 3, 3]  # assign, ask, meet: no step per block of queries
    assert sorted(map(tuple, several.collect())) == sorted(map(tuple, one.collect()))
