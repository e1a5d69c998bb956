"""The automaton against trying every variant on every sentence."""

import random
import re

from proselake.functions import text as T
from proselake.operators import phrase_bank


def plain(sentence, groups, threshold):
    t = re.findall(T.PHRASE_TOKEN, sentence.lower())
    out = []
    for k, group in enumerate(groups):
        if isinstance(group, dict) and group.get("kind") == "regex":
            m = re.search(group["pattern"], sentence, re.IGNORECASE)
            text = m.group(0).strip() if m else ""
            if text and not phrase_bank.BOUNDARY.search(text):
                out.append((k, text, 1.0))
            continue
        best = (0.0, None)
        for v in group["variants"] if isinstance(group, dict) else group:
            w = re.findall(T.PHRASE_TOKEN, v.lower())
            if len(w) == 1:
                score = float(bool(re.search(rf"\b{re.escape(v)}\b", sentence.lower())))
            elif len(w) <= 3:
                score = float(bool(w) and " ".join(w) in " ".join(t))
            else:
                grams = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
                wide = min(len(w) + 2, len(t))
                score = max((len(grams & {tuple(t[j : j + 3]) for j in range(s, s + wide - 2)}) / len(grams) for s in range(len(t) - wide + 1)), default=0.0)
                score = score if score >= threshold else 0.0
            if score > best[0]:
                best = (score, v)
        if best[1]:
            out.append((k, best[1], best[0]))
    return sorted(out)


def test_equals_trying_all(spark):
    draw, words = random.Random(4), "a b c d ab don't e5 é_x Ab".split()
    line = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", ",", "."]) for _ in range(n))
    groups = [[line(draw.randrange(1, 9)) for _ in range(draw.randrange(0, 5))] for _ in range(60)]
    groups += [{"kind": "literal", "variants": ["a b", "d"]}, {"kind": "regex", "pattern": "(a|b) c.*d"}, {"kind": "regex", "pattern": "("}, ["...", ""], ["a", "a b c d"], []]
    sentences = [line(draw.randrange(0, 25)) for _ in range(400)] + ["", "a. B c d", "A b, c d!"]
    good = [g if not (isinstance(g, dict) and g.get("pattern") == "(") else [] for g in groups]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sentences)] + [(-1, None)], "id long, sentence string").repartition(3)
    want = sorted((k, *hit) for k, s in enumerate(sentences) for hit in plain(s, good, 0.4))
    for most in (1 << 20, 200):  # at once, and in parts
        got = sorted((r["id"], r["grp"], r["phrase"], r["score"]) for r in phrase_bank.found(df, groups, 0.4, most).collect())
        assert got == want
    assert phrase_bank.found(df, []).collect() == []


def test_plan_does_not_grow(spark):
    df = spark.createDataFrame([(1, "a b c d e")], "id long, sentence string")
    size = lambda n: len(phrase_bank.found(df, [[f"w{k} x y z"] for k in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert size(5000) < size(1) + 50
