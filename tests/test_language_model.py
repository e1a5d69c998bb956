"""The Kneser-Ney model against plain dictionaries, and its probabilities against their sum."""

import math
import random
from collections import Counter

import pytest

from proselake.operators import language_model as L


def plain(train, order):
    grams = Counter()
    for t in train:
        w = ["<s>"] * (order - 1) + t.split()
        grams.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one else 0.5

    def p(g):
        k = len(g)
        c, d = counts[k], discount(counts[k])
        if k == 1:
            total = sum(c.values())
            return max(c[g] - d, 0) / total + d * len(c) / total / (len(c) + 1)
        own = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:])

    return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_dictionaries(spark, order):
    draw, words = random.Random(order), "a b c d e f g h".split()
    text = lambda: " ".join(draw.choice(words[: draw.choice([2, 5, 8])]) for _ in range(draw.randrange(0, 20)))
    train, test = [text() for _ in range(60)], [text() for _ in range(20)] + ["z a b", "z z z", ""]
    model = L.fit(spark.createDataFrame([(t,) for t in [*train, None]], "text string"), order)
    got = {(r["k"], r["at"]): r["loss"] for r in L.losses(model, spark.createDataFrame(list(enumerate(test)), "k int, text string"), ["k"]).collect()}
    p, want = plain(train, order), {}
    for k, t in enumerate(test):
        w = ["<s>"] * (order - 1) + t.split()
        want |= {(k, i): -math.log(p(tuple(w[i : i + order]))) for i in range(len(w) - order + 1)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    seen = {w for t in train for w in t.split()}
    asked = [" ".join([*["a"] * (order - 1), w]) for w in [*seen, "unseen"]]
    total = sum(r["p"] for r in L.probabilities(model, spark.createDataFrame([(a,) for a in asked], "gram string")).collect())
    assert abs(total - 1) < 1e-9


def test_nothing_to_learn(spark):
    assert L.fit(spark.createDataFrame([(None,), ("",)], "text string")) is None


def test_tokens_are_not_shuffled(spark):
    """Groups of texts exchange packed grams: no row of a token is made before the losses."""
    texts = spark.createDataFrame([(k, "a b c a b") for k in range(50)], "k int, text string")
    found = L.losses(L.fit(texts, 2), texts, ["k"])
    assert found.count() == 250
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
