import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from proselake.llm import simhash
from proselake.llm.components import connected_components

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def brute_components(n, linked):
    label = list(range(n))
    for _ in range(n):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 700)] + [(900, k) for k in range(901, 1000)]
    e = spark.createDataFrame(edges + [(5, 5), (None, 3), (3, None)] + edges[:3], "src long, dst long").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    want = brute_components(1000, edges)
    assert got == {k: want[k] for k in {x for p in edges for x in p if p[0] != p[1]}}
    assert connected_components(e.limit(0)).count() == 0


def test_fingerprints_and_groups(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(40)) for _ in range(60)) for _ in range(40)]
    texts = base + [b.replace(b.split()[30], "zz", 1) for b in base[:20]] + base[:5] + [None, "", "  ", "one", "One two", "Ä B c"] + ["w " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"fp": F.lit("x"), "component_id": F.lit(1), "id": F.lit(2)})
    got = {r["id"]: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len(texts)
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[k]["fp"] % (1 << 64) for k in range(len(texts))] == fps
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[k]["component_id"] for k in range(len(texts))] == brute_components(len(texts), links)


def test_shingles_at_chunk_ends():
    """A text of over two chunks, of which a shingle lost at each chunk's end changes a bit."""
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(1000)) for _ in range(140_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_dense_shards(spark):
    """Codes in one ball, dealt to bounded shards, against all pairs."""
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 30, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 300).astype(np.uint64)), rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    order = np.sort(codes.view(np.int64))
    links = [(i, j) for i in range(len(order)) for j in range(i) if int(order[i] ^ order[j]).bit_count() <= 2]
    want = brute_components(len(order), links)
    for limit in (8, 40, 512):
        assert simhash.shards(df, shard_codes=limit).groupBy("mask", "value").count().agg(F.max("count")).first()[0] <= limit
        got = {r["node"]: r["component"] for r in connected_components(simhash.shard_links(df, shard_codes=limit)).collect()}
        assert [got.get(int(c), int(c)) for c in order] == [int(order[w]) for w in want]


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "x y z q")], DOCS)
    rows = sorted(((r["id"], r["component_id"], r["n_same"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 7, 3), (7, 7, 3), (7, 7, 3), (None, None, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
