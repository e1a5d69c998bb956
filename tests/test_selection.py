"""The exact k smallest against sorting, with ties, nulls and numbers that doubles can't tell apart."""

import random

import pytest
from pyspark.sql import functions as F

from proselake.operators import grading, selection


@pytest.fixture(autouse=True)
def many_rounds(monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)


@pytest.mark.parametrize("kind", ["long", "double", "ties", "close"])
def test_kth_smallest(spark, kind):
    draw = random.Random(2)
    make = {"long": lambda: draw.randrange(-(1 << 62), 1 << 62), "double": lambda: draw.gauss(0, 1) ** 5, "ties": lambda: draw.randrange(4), "close": lambda: (1 << 62) + draw.randrange(200)}[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)] + [(None, 10_000)], f"v {'double' if kind == 'double' else 'long'}, k long").repartition(5)
    for k in (1, 2, 777, 2999, 3000, 5000):
        assert selection.kth_smallest(df, "v", k) == sorted(values)[min(k, 3000) - 1]
        got = {r["k"] for r in df.where(selection.among_smallest(df, k, "v", "k")).collect()}
        assert got == {i for _, i in sorted((v, i) for i, v in enumerate(values))[:k]}


def test_hold_out_is_exact_and_stable(spark):
    df = spark.range(1003).select(F.when(F.col("id") < 1000, F.col("id")).alias("key"), "id")
    found = [{r["id"] for r in selection.held_out_exactly(df.repartition(n), "key", 0.2, 5).where("held_out").collect()} for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 200 and max(found[0]) < 1000
    assert found[0] != {r["id"] for r in selection.held_out_exactly(df, "key", 0.2, 6).where("held_out").collect()}
    assert selection.held_out_exactly(df, "key", 0.2).count() == 1003
    assert selection.held_out_exactly(df.where("false"), "key").collect() == []
    assert selection.seeded_head(df, "key", 10, 5).count() == 10 and selection.seeded_head(df, "key", 0, 5).count() == 0


def test_floor_of_nothing(spark):
    assert grading.under_floor(spark.createDataFrame([], "trial long, value double")).collect() == []
