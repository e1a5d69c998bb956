"""Versions of a matrix: what each stores, what it restores, and what is found when stored columns are damaged."""

import pytest

from proselake.operators import versions


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "m")
    rows = [(r, c, float(r + 10 * c)) for r in range(4) for c in range(6)]
    frame = lambda rows: spark.createDataFrame(rows, "row int, col long, val double").repartition(3)
    one = [(r, c, -v if c == 2 else v) for r, c, v in rows]
    two = [(r, c, v) for r, c, v in one if c != 5] + [(0, 9, 1.0)]
    versions.save(frame(rows), folder, 0)
    versions.save(frame(one), folder, 1, 0)
    versions.save(frame(two), folder, 2, 1)
    versions.save(frame(rows), folder, 3, 2)  # back to the first contents: only what differs from version 2
    for k, want in enumerate((rows, one, two, rows)):
        assert sorted(tuple(r) for r in versions.restore(spark, folder, k).collect()) == sorted(want)
        assert versions.damaged(spark, folder, k).count() == 0
    assert {r["version"]: (r["n_columns"], r["n_values"]) for r in versions.stored(spark, folder).collect()} == {0: (6, 24), 1: (1, 4), 2: (1, 1), 3: (2, 8)}
    with pytest.raises(ValueError):
        versions.save(frame(rows), folder, 3, 2)
    frame([(0, 2, 7.0)]).write.mode("overwrite").parquet(f"{folder}/columns/version=1")
    assert [r["col"] for r in versions.damaged(spark, folder, 1).collect()] == [2] and versions.damaged(spark, folder, 0).count() == 0


def test_order_and_repeats_of_values(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0), (0, 2, 2.0), (1, 2, 1.0), (1, 3, 2.0), (0, 3, 1.0)], "row int, col long, val double")
    d = {r["col"]: r["digest"] for r in versions.digests(m).collect()}
    assert d[1] == d[3] != d[2]
