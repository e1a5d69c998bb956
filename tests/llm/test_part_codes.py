"""Operator 11: the partial-distance search against all distances, and whole rounds against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.llm import part_codes


@pytest.mark.parametrize("wide", [1, 3, 4])
def test_nearest_is_the_lowest_of_the_nearest(wide):
    draw = np.random.default_rng(wide)
    x, book = draw.integers(-6, 7, (9000, wide)), draw.integers(-6, 7, (64, wide))  # small numbers, so that ties abound
    index, distance = part_codes.nearest(x, book)
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: [int(np.floor(256 * np.float64(c))) for c in r[1]] for k, r in enumerate(kept)}
    wide = len(kept[0][1]) // parts
    order = sorted(x, key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))[:entries]
    books = [[x[k][p * wide : (p + 1) * wide] for k in order] for p in range(parts)]

    def best(k, p):
        own = x[k][p * wide : (p + 1) * wide]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            of = {}
            for k in x:
                of.setdefault(best(k, p)[1], []).append(x[k][p * wide : (p + 1) * wide])
            moved.append([[sum(c) // len(of[j]) for c in zip(*of[j])] if j in of else e for j, e in enumerate(books[p])])
        books = moved
    found = {k: [best(k, p) for p in range(parts)] for k in x}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = {k: sum(d for d, _ in f) for k, f in found.items()}
    total = {}
    for k in x:
        total[kept[k][2]] = total.get(kept[k][2], 0) + errors[k]
    return sorted(((kept[k][0], kept[k][2], bytes(j for _, j in found[k]), errors[k], total[kept[k][2]], digest) for k in x), key=repr)


def got(df):
    return sorted(((r["id"], r["label"], bytes(r["code"]), r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, error int")


def test_equals_plain_loops(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in draw.normal(0, 0.3, 32).astype(np.float32)], int(draw.integers(0, 3)) if i % 7 else None) for i in draw.permutation(400)]
    rows += [(500, None, 1), (501, [float("nan")] * 32, 1), (502, [None] * 32, 1), (503, [float("inf")] * 32, 2), (504, [0.0] * 32, 2), (505, [-0.001] * 32, 2)]
    rows += [rows[0], rows[0]]  # repeated rows
    assert got(part_codes.compressed(frame(spark, rows).repartition(5))) == plain(rows)


def test_fewer_rows_than_entries_and_odd_lengths(spark):
    rows = [(1, [1.0] * 16, 0), (2, [2.0] * 16, 0), (3, [1.0] * 15, 0), (4, [], 0), (5, [1.0] * 32, 0)]
    found = got(part_codes.compressed(frame(spark, rows)))
    assert [(r[0], r[3]) for r in found] == [(1, 0), (2, 0)]


def test_empty_and_unusable(spark):
    for rows in ([], [(1, None, 0)]):
        assert part_codes.compressed(frame(spark, rows)).collect() == []


def test_extreme_components(spark):
    rows = [(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0), (3, [0.0] * 16, 0)]
    assert [r[3] for r in got(part_codes.compressed(frame(spark, rows)))] == [0, 0, 0]


def test_many_labels_go_by_shuffle(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("label"), F.lit(2).cast("long").alias("error"), "id")
    few = {(r["id"], r["label_error"]) for r in part_codes.with_group_error(rows, "label").collect()}
    many = {(r["id"], r["label_error"]) for r in part_codes.with_group_error(rows, "label", most_labels=10).collect()}
    assert few == many and len(few) == 3000 and (0, 2000) in few
