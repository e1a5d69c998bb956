import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselake.llm import forest, hash_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=700, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    for k in range(0, 90):  # near copies of the first ones
        x[n - 1 - k] = x[k % 20] + rng.standard_normal(d).astype(np.float32) * 0.05
    for k in range(200, 260):
        x[k] = x[199]
    return x


def rows_of(x, labels):
    return [(k, [float(v) for v in r], labels[k]) for k, r in enumerate(x)]


ODD = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, [float("inf")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [], 1), (9006, [1.0] * 3, 1), (9100, [0.0] * 16, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("x"), "id": F.lit(1), "vec": F.lit(None).cast("string"), "n_links": F.lit("y")}).repartition(3)


def test_nearest(spark):
    x = vectors()
    df = frame(spark, rows_of(x, [1] * len(x)) + ODD + [(None, [1.0] * 16, 1), (100, [float(v) for v in x[100]], 1)])
    for shard in (8192, 150):
        got = hash_index.search(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=5, bits=128, enough=64).collect()
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append(r)
        assert set(by) == set(range(0, len(x), 50))
        hits = total = 0
        for q, rs in by.items():
            rs.sort(key=lambda r: r["rank"])
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            want = sorted((d[k], k) for k in range(len(x)) if k != q)[:10]
            assert [r["rank"] for r in rs] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in rs] == sorted((r["score"], r["vec_id"]) for r in rs)
            assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in rs)
            hits += len({r["vec_id"] for r in rs} & {k for _, k in want})
            total += 10
        assert hits >= 0.9 * total
        assert [r["vec_id"] for r in by[200]] == [199, *range(201, 210)]


def test_few_candidates(spark):
    df = frame(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [3.0, 2.0], None)])
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hash_index.search(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 2.0)]
    assert hash_index.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hash_index.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_radius_is_whole():
    """Probing finds every code of its radius, and the radius that holds enough of them where that is within it."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    q = rng.integers(0, 256, 16, dtype=np.uint8)
    for k in range(60):  # some near the query
        codes[k] = q ^ np.packbits(rng.permutation(np.arange(128) < k // 2))
    index = hash_index.SubstringIndex(codes)
    d = np.bitwise_count(codes ^ q).sum(1)
    hit = np.zeros(500, bool)
    for s in range(4):
        index.probe(q, s, hit)
        assert set(np.flatnonzero(d < 8 * (s + 1))) <= set(np.flatnonzero(hit))
        parts = np.bitwise_count((codes ^ q).view(">u2").astype(np.uint16))
        assert set(np.flatnonzero(hit)) == set(np.flatnonzero((parts <= s).any(1)))
    for enough in (1, 7, 40):
        at, probed = index.nearest(q, enough)
        assert set(at) == set(np.flatnonzero(d <= np.sort(d)[enough - 1])) and probed < 400
    at, probed = index.nearest(q, 500)
    assert len(at) == probed == 500


def test_probing_prunes_clusters():
    """Few codes are probed where queries have near neighbours, and they are found."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((200, 64))
    x = centres[np.arange(20_000) % 200] + rng.standard_normal((20_000, 64)) * 0.15
    model = hash_index.learn(x[:5000])
    index, shares, hits = hash_index.SubstringIndex(model.codes(x)), [], 0
    for k in range(0, 20_000, 500):
        at, probed = index.nearest(model.codes(x[k : k + 1])[0], 100)
        shares.append(probed / len(x))
        near = np.argsort(((x - x[k]) ** 2).sum(1))[:11]
        hits += len(set(near) & set(at))
    assert np.mean(shares) < 0.1 and hits >= 0.95 * 11 * 40


def brute(rows, least=0.93):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    unit = {id(r): np.array(r[1], float) / np.linalg.norm(r[1]) for r in good}
    links, parent = {}, {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[id(a)] @ unit[id(b)] >= least:
                for x, y in ((a, b), (b, a)):
                    links[x[0]] = links.get(x[0], 0) + 1
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    return {r[0]: (links.get(r[0], 0), find(r[0])) for r in rows}


def test_forest(spark):
    x = vectors(500)
    rows = rows_of(x, [k % 2 for k in range(len(x))]) + ODD + [(9007, [float(v) for v in x[1]], None)]
    for how in ({}, {"cell_rows": 60, "block_rows": 40, "least_rows": 8, "trees": 10}, {"cell_rows": 100, "broadcast_cells": 0, "sample_rows": 80}):
        got = forest.near_duplicates(frame(spark, rows), **how).collect()
        assert len(got) == len(rows)
        want = brute(rows)
        right = sum((r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got)
        assert right >= 0.97 * len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
        assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    assert forest.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    only_bad = forest.near_duplicates(frame(spark, ODD[:3])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in only_bad) == [(k, 0, k, True) for k in (9000, 9001, 9002)]


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(frame(spark, rows)).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, False)]


def test_clusters_stay_whole():
    """A cluster denser than links is one leaf, so that all its pairs meet; other vectors are split."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 32))
    x[:400] = x[0] + rng.standard_normal((400, 32)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    how = forest.Splitter(32, 0.05, 0.6 * 0.14**0.5 / 32**0.5, 32, 512, 5)
    rows, leaves = how.grow(x, 0, 1)
    assert len(np.unique(leaves)) > 20
    sizes = {leaf: int((rows[leaves == leaf] < 400).sum()) for leaf in np.unique(leaves)}
    assert max(sizes.values()) > 300


def test_forest_recall(spark):
    """One label of 24,000 vectors, split in rounds: links of near copies and of pairs right at the threshold."""
    rng = np.random.default_rng(8)
    n, d = 24_000, 32
    x = rng.standard_normal((n, d)).astype(np.float32)
    for k in range(3000):  # cosines from 0.9 to 1
        x[n - 1 - k] = x[k // 3] + rng.standard_normal(d).astype(np.float32) * (0.1 + 0.4 * rng.random()) * np.linalg.norm(x[k // 3]) / d**0.5
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.zeros(n, int)
    for at in range(0, n, 2000):
        want[at : at + 2000] = (unit[at : at + 2000] @ unit.T >= 0.93).sum(1) - 1
    assert want.sum() > 4000
    table = pa.table([pa.array(np.arange(n)), pa.array(list(x), pa.list_(pa.float32())), pa.array(np.ones(n, np.int32))], names=["vec_id", "embedding", "label"])
    df = spark.createDataFrame(table)
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(df, cell_rows=4096).select("vec_id", "n_links").collect()}
    found = np.array([got[k] for k in range(n)])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_dense_cluster_in_bounded_memory():
    """Ten million pairs of near-equal vectors, nine in ten of them linked: counted and joined without being listed."""
    import tracemalloc

    from proselake.llm import forest
    from proselake.llm.common import local_components

    draw = np.random.default_rng(1)
    x = draw.standard_normal(64) + 0.22 * draw.standard_normal((4500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = draw.integers(1, 4, len(x))
    held = [[1, 5] if k % 3 else [0, 1] for k in range(len(x))]  # every third vector met its like in an earlier leaf
    tracemalloc.start()
    of_x, of_y, u, v = forest._links(1, x, x, True, held, held, 0.93, n, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    early = np.arange(len(x)) % 3 == 0
    counted = linked & ~(early[:, None] & early[None, :])
    assert linked.sum() > 8_000_000 and (of_x + of_y == counted @ n).all()
    assert peak < 500e6
    both = np.arange(len(x))
    label = local_components(2 * len(x), np.concatenate([u, both]), np.concatenate([v, both + len(x)]))
    i, j = np.nonzero(linked)
    assert (label[: len(x)] == local_components(len(x), i, j)).all()


@pytest.mark.parametrize("share", [0.002, 0.2])
def test_stars_hold_the_components(share):
    from proselake.llm import forest
    from proselake.llm.common import local_components

    mask = np.random.default_rng(5).random((300, 400)) < share
    rows, cols = np.arange(300), 300 + np.arange(400)
    i, j = np.nonzero(mask)
    u, v = forest._stars(mask, rows, cols)
    assert (local_components(700, u, v) == local_components(700, rows[i], cols[j])).all()
