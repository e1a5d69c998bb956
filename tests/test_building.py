import json

import pytest
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import building as B
from proselake.operators import evaluation as E
from proselake.operators import grading as G


def test_axes_and_weights():
    a = B.register_axis(B.Axis("calm", {"worsen": ("s", "{orig}", 0.5)}))
    assert B.AXES["calm"] is a and not a.improves()
    assert B.weights(None, ["x", "y"]) == {"x": 1.0, "y": 1.0} and B.weights("2,0.5", ["x", "y"]) == {"x": 2.0, "y": 0.5}
    with pytest.raises(ValueError):
        B.weights("1", ["x", "y"])


def test_pairs_take_good_rewrites(spark):
    rows = [("f", "The lamp was on the table.", "worsen", '"The old lamp glowed softly there."'), ("f", "The lamp was on the table.", "worsen", "too short"), ("f", "A long chair stood by the wall.", "improve", "A chair stood there.")]
    got = B.Axis("x", {}, {"light": 100}).pairs(spark.createDataFrame(rows, "source string, seed string, direction string, made string")).collect()
    assert [(r["neg"], r["pos"], r["real"], r["intensity"]) for r in got] == [("The lamp was on the table.", "The old lamp glowed softly there.", "neg", "light"), ("A chair stood there.", "A long chair stood by the wall.", "pos", "better")]


def test_splits_keep_sides_apart(spark):
    pool = spark.createDataFrame([(f"Sentence number {k}.", k % 2, "p", f"g{k}", True, 0, k) for k in range(200)], "text string, label int, source string, group_id string, is_real boolean, prio int, idx long")
    human = spark.createDataFrame([(f"Sentence number {k}.", 0, "h", f"h{k}", True, 0, k) for k in range(190, 300)], pool.schema)
    got = B.splits(pool, human).collect()
    assert len(got) == 300
    assert {r["source"] for r in got if r["split"] in ("train", "val")} == {"p"} and {r["source"] for r in got if r["split"] in ("calibration", "test")} == {"h"}


def test_threshold_file(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "threshold.json").write_text(json.dumps({"threshold": 0.66, "n": 3}, indent=1))
    assert B.read_threshold(spark, str(tmp_path / "x"), str(tmp_path / "m")) == 0.66 and B.read_threshold(spark, str(tmp_path)) == 0.5


def test_scorers(spark):
    rows = spark.createDataFrame([(k, "warm lamp light" if k % 2 else "cold rain fell", k % 2) for k in range(40)], "doc_id long, text string, label int")
    fitted = E.logistic_scorer(rows, features=64)(rows).select("label", "score").collect()
    assert all((r["score"] > 0.5) == (r["label"] == 1) for r in fitted)
    s = E.scored(rows, E.lexical_scorer(["lamp"])).where("score > 0").count()
    assert s == 20
    d = E.detect(rows, E.lexical_scorer(["lamp"]), 0.5).where("doc_id = 1").first()
    assert d["n_flagged"] == 1 and d["sentences"][0]["text"] == "warm lamp light"


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "doc_id long, text string, label int, score double")
    assert E.confusion(e, 0.5).first()["f1"] == 0.0
    assert E.sweep(e).count() == 1
    assert G.under_floor(spark.createDataFrame([], "trial long, value double")).count() == 0
    r = spark.range(1).select(F.size(T.sentences(F.lit(None).cast("string"))).alias("n"), T.count_sentences(F.lit("  ")).alias("c"), T.density(F.lit(None).cast("string"), ["a"]).alias("d")).first()
    assert (r["n"], r["c"], r["d"]) == (0, 0, 0.0)
