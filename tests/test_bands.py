"""Pairs of queries and vectors, counted by their points."""

import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import matching as mt
from plumbline.plans.registry import QUERIES
from tests.conftest import SMALL


def test_semantic_bands_makes_no_row_of_a_pair(spark):
    plan = QUERIES["semantic_bands"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("most", [7, 16_384])
def test_band_counts_are_those_of_all_pairs_on_odd_rows(spark, monkeypatch, kind, most):
    """Sums that depend on their order, sums at a border, vectors that are null, hold nulls, NaN or infinity, are very
    long, empty or of other lengths, repeated and null ids; in one cell and in many."""
    monkeypatch.setattr(mt, "SLICE_ROWS", most)
    nan, inf, big = float("nan"), float("inf"), 3e38 if kind == "float" else 1.7e308
    odd = [None, [], [None, 1.0, 0.0], [nan, 1.0, 0.0], [inf, 1.0, 0.0], [-inf, inf, 1.0], [big, big, -big], [-big, big, 0.5], [1.0, -1.0, 1e-30], [1.0], [0.85], [1.0, 1.0], [0.0, 0.0, 0.0], [1e16, 1.0, -1e16], [1.0, 0.85, 1.0]]
    at = [x for a, _ in mt.BANDS for x in ([a, 0.0, 0.0], [a - 1e-16, 1e-16, 0.0], [a / 3] * 3, [a, 1e-17, -1e-17])]
    draw = random.Random(3)
    some = [[draw.uniform(-1, 1) for _ in range(3)] for _ in range(40)]
    ids = [*range(0, 40, 2), 0, 0, 20, 20, None, None]
    data = [(ids[i % len(ids)], v) for i, v in enumerate([*odd, [1.0, 1.0, 1.0], [1.0, 0.0, 0.0], *at, *some, *odd, *at])]
    e = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>")
    asked = e.filter("vec_id % 20 = 0")
    pairs = e.join(asked.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), F.col("a") != F.col("vec_id"))
    want = pairs.groupBy(tx.banded(tx.dot("u", "embedding"), mt.BANDS).alias("points")).count()
    assert sorted(map(tuple, mt.band_counts(asked, e).collect())) == sorted(map(tuple, want.collect()))
    assert mt.band_counts(asked.limit(0), e).count() == mt.band_counts(asked, e.limit(0)).count() == 0


def test_levels_of_sums_that_rounding_carries_over_a_border():
    """Vectors so made that their products lie within rounding of 0.85: each must be on the side that adding up in order gives."""
    draw = np.random.default_rng(5)
    u, v = draw.standard_normal((1, 64)), draw.standard_normal((70, 64))
    v[:, 0] = 0
    v[:, 0] = (0.85 - v @ u[0]) / u[0, 0]
    want = [reduce(lambda s, x: s + x, (u[0] * w).tolist(), 0.0) >= 0.85 for w in v]
    got = mt._levels(u, v, np.zeros(1, int), np.arange(1, 71), [0.85])
    assert 0 < sum(want) < 70 and got.tolist() == [0, sum(want)]
