"""Operator 13 against scoring every document."""

import math
import random
import re

import pytest

from proselake.llm import block_max

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=50):
    every = [(i, split(t)) for i, t in docs]
    n_docs, length = sum(1 for _, t in every if t), sum(len(t) for _, t in every)
    df = {}
    for _, t in every:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in every:
            score = 0
            for w in set(split(text)):
                tf = t.count(w)
                if tf:
                    m = 50 + (50 * len(t) * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["Élan", "ÀB", "naïve", "3x", "日本"]
    docs = [(k, " ".join(draw.choice(words[: draw.choice([10, 60, 305])]) for _ in range(draw.randrange(0, 80)))) for k in range(1200)]
    docs += [(2000 + k, "w1 w2 w3") for k in range(90)]  # more equal scores than places
    docs += [(3000, None), (3001, ""), (3002, "--- !!"), (None, "w1 w2 w3"), (7, "w9 w9 W9"), (7, "w9 w9 W9"), (3003, "w250 " * 50_000)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 40)))) for k in range(12)]
    items += [(50, "w1 w2 W3"), (51, None), (52, "unheard"), (53, "élan|ÉLAN"), (50, "w250"), (None, "w7 w7")]
    return docs, items


@pytest.mark.parametrize("k,block", [(50, 128), (3, 8), (1, 1)])
def test_equals_scoring_all(spark, corpus, k, block):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, ids string").repartition(6)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(block_max.search(d, i, k, block_docs=block)) == plain(docs, items, k)


def test_items_in_chunks(spark, corpus, monkeypatch):
    docs, items = corpus
    whole = block_max.chunks
    monkeypatch.setattr(block_max, "chunks", lambda *a: whole(*a, chunk_bytes=300, chunk_items=4))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(block_max.search(d, i, 5)) == plain(docs, items, 5)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in zip(corpus, ("doc_id", "item_id")))
    assert block_max.search(docs.where("false"), items).collect() == []
    assert block_max.search(docs, items.where("false")).collect() == []


def test_blocks_are_pruned(spark, corpus):
    """The bound skips most of the blocks that hold a query's terms."""
    docs = spark.createDataFrame([(k, f"common {'rare ' if k % 1000 == 3 else ''}w{k % 97}") for k in range(20_000)], "doc_id long, text string").repartition(4)
    q = next(block_max.chunks(spark.createDataFrame([(1, "common rare")], "item_id long, text string"), "item_id", "text"))
    texts = block_max._texts(docs, "doc_id", "text")
    n, length, df = block_max.statistics(texts, q.vocabulary)
    index = block_max.forward_index(texts, q.vocabulary, n, length)
    weights = block_max.np.array([block_max.weight(n, d) for d in df.tolist()])
    least = block_max.thresholds(index, q, weights, 4)
    blocks = [r["maxima"] for r in index.select("maxima").collect()]
    needed = (block_max._bounds(blocks, q, weights[q.flat])[0] >= least[0]).sum()
    assert 4 <= needed <= 20 < len(blocks)
