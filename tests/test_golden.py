"""Hand-worked cases of the operators, in neutral words."""

import pytest
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import audit, building, dataset, detectors, evaluation, grammar, markup, objective, vectors


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('He left. "Stay." She sat.', ["He left.", '"Stay.', "She sat."]),
        ("One.\n\nTwo", ["One.", "Two"]),
        ("Wait… (yes.) No", ["Wait…", "(yes.", "No"]),
        ("", []),
        (None, []),
        ("  \n \n ", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences("t"), t=text) == want
    assert grammar.sentences_of(text or "") == want


@pytest.mark.parametrize("text, want", [('She said "go" and left.', "She said and left."), ("A “b ‘c” d", "A d"), ('x"y', "x"), ("it’s on", "it s on")])
def test_narration(spark, text, want):
    assert one(spark, T.narration("t"), t=text) == want


def test_asides_and_questions(spark):
    assert one(spark, T.squeeze(T.strip_asides("t")), t="a [b [c] d] e") == "a e"
    assert one(spark, T.ends_with_question("t"), t='Who?!" ') and not one(spark, T.ends_with_question("t"), t="Who? He.")
    assert grammar.asks('Who?!" ') and not grammar.asks("Who? He.")


def test_opening_monotony(spark):
    df = spark.createDataFrame([(1, "He ran. He hid. He sat. He slept. Dawn came.")], "doc_id long, text string")
    r = detectors.opening_monotony(df).first()
    assert (r["opener"], r["count"], r["max_run"], r["fraction"], r["score"]) == ("he", 4, 4, 0.8, 0.8)


def test_opener_repeat(spark):
    df = spark.createDataFrame([(1, "Rain fell. Rain stopped. Birds sang."), (2, "One only.")], "doc_id long, text string")
    assert [tuple(r) for r in detectors.opener_repeat(df, "doc_id").collect()] == [(1, 0.5)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("She ran. She hid. She sat. She slept.", 1.0),
        ("Rain fell. Birds sang. Wind rose. Leaves turned.", 0.0),
        ("He ran. She hid. They sat. We slept.", 0.0),
        ("She ran. She hid. Rain fell.", 0.5),
        ("", 0.0),
    ],
)
def test_opener_collapse(spark, text, want):
    r = building.rollout_summary(spark.createDataFrame([("v", text)], "variant string, text string"), ["variant"], lambda s: F.lit(0.0))
    assert r.first()["opener"] == want


def test_pool_counts(spark):
    rows = spark.createDataFrame([("Tea is hot.", 1, 0, 0), (" tea IS  hot. ", 0, 0, 1), ("a\nb", 0, 0, 2)], "text string, label int, prio int, idx int")
    assert dataset.dedupe_counts(rows).first().asDict() == {"kept": 1, "dup": 1, "bad": 1, "conflict": 1}


def test_bucket(spark):
    assert one(spark, dataset.md5_bucket("val", F.col("k")), k="7") == 736


def test_weights_and_thresholds(spark):
    rows = lambda d: spark.createDataFrame(d, "label int, score double")
    w = {r["label"]: round(r["weight"], 4) for r in evaluation.class_weights(rows([(0, 0.0)] * 3 + [(1, 0.0)])).collect()}
    assert w == {0: 0.6667, 1: 2.0}
    p = evaluation.pick_threshold(evaluation.sweep(rows([(0, 0.2), (1, 0.4), (0, 0.6), (1, 0.8)]))).first()
    assert tuple(p) == (0.8, 1.0, 0.5, True)
    p = evaluation.pick_threshold(evaluation.sweep(rows([(0, 0.5), (1, 0.5)]))).first()
    assert tuple(p) == (0.5, 0.5, 1.0, False)
    assert evaluation.calibrate(rows([]))["status"] == "empty"
    assert evaluation.calibrate(rows([(1, 0.5)]))["status"] == "single_class"


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("It is not a lamp, but a lantern.", ("DET NOUN", "DET NOUN", True)),
        ("It is not only warm but also bright.", None),
        ("The chair isn't old, it is new.", ("NOUN", "NOUN", True)),
        ("Not now.", None),
        ("Is it not a lamp, but a lantern?", None),
        ("They don't spend money, they send gifts.", ("VERB NOUN", "VERB", False)),
        ("He doesn't spend, but send.", None),
        ("He doesn't spend, he sends.", ("VERB", "", False)),
        ("The lamp is not hers but bright.", ("VERB", "NOUN", False)),
        ("The lamp is not his but bright.", None),
        ("It does not rain, it shines on hills.", ("NOUN", "NOUN VERB", False)),
        ("It does not rain, and it shines.", None),
        ("The wall hasn't fallen; it has grown old.", ("NOUN", "NOUN NOUN", False)),
        ("The wall hasn't fallen; it has begun anew.", ("NOUN", "NOUN", True)),
        ("She isn't cold, it is warm.", None),
        ("The tea isn't cold, that is warm!", ("NOUN", "NOUN", True)),
        ("He's not a guest, he's a host.", ("DET NOUN", "DET NOUN", True)),
        ("He asked me not to go, but to stay.", None),
        ("It was not the long and very old stone road, but mud.", None),
        ("Not red; the door wasn't red but is blue.", ("VERB NOUN DET NOUN NEG VERB", "VERB NOUN", False)),
    ],
)
def test_contrast(sentence, want):
    assert grammar.contrast_of(sentence) == want


def test_tags():
    words = "spend send hers goes won't gently station walked glass boss news hopeful chair my".split()
    assert [grammar.tag_of(w) for w in words] == "VERB VERB VERB VERB NEG ADV NOUN VERB NOUN NOUN VERB ADJ NOUN PRON".split()


def test_echo():
    said = 'I said "the blue lamp is broken" today.'
    assert grammar.echoes_of('"The blue lamp?" she asked.', said) == [("The blue lamp?", "the blue lamp", 3)]
    assert grammar.echoes_of('"Who?" she asked.', said) == []
    assert grammar.echoes_of(None, said) == grammar.echoes_of("Who?", None) == []


def test_structures():
    assert grammar.signature_of('"Hi." He sat.') == ["SPEECH:1", "NARRATION:1"]
    assert grammar.structures_of(['"Hi." He sat.'] * 2)["repetitive"]
    assert not grammar.structures_of(["He sat."] * 2)["repetitive"]
    assert grammar.structures_of([])["least"] == 0.0


def test_templates():
    got = grammar.templates_of("The cat sat down. The cat sat up. The cat sat still. Rain fell on us.")
    assert got["flagged"][0][:2] == ("the cat sat", 3) and got["unique"] == 2 and got["score"] == 0.75


def test_markup():
    assert markup.style_of('*He waves.* "Hello."') == ("quoted", "asterisk")
    target = ("quoted", "bare")
    assert markup.rewritten('*He waves* "Hello."', markup.style_of('*He waves* "Hello."'), target) == 'He waves. "Hello."'
    text, changed, note = markup.normalized_of('He waves. "Hello."', ['*She nods.* "Yes."'] * 2)
    assert (text, changed, note) == ('*He waves.* "Hello."', True, "normalized")
    assert markup.normalized_of("```*x*```", []) == ("```*x*```", False, "no baseline")
    assert "".join(p[s:e] for p in ['a *b* "c" d'] for _, s, e in grammar.block_spans_of(p)) == 'a *b* "c" d'


def test_objective(spark):
    assert round(one(spark, objective.excess(F.lit(0.5), F.lit(0.1), (2.0, 8.0))), 8) == 2.08
    curve = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.3)], "u int, turn int, value double")
    assert round(objective.late_weighted(curve, ["u"]).first()["late_weighted"], 4) == 0.2333
    k = one(spark, vectors.kernel(F.lit(5), F.lit(1.0), F.lit(0.5), F.lit(0.2), F.lit(0.5)))
    assert [round(x, 6) for x in k] == [0.2, 0.6, 1.0, 0.6, 0.2]


def test_distinct_phrases(spark):
    rows = [(1, p.split(), p, n, m) for p, n, m in (("tight ring", 2, [0, 1]), ("the tight ring", 2, [0, 1]), ("ring of muscle", 2, [0, 1]), ("six centuries", 3, [0, 1, 2]), ("for six centuries", 2, [0, 2]))]
    p = spark.createDataFrame(rows, "conv_id int, gram array<string>, phrase string, n_messages int, messages array<int>")
    assert {r["phrase"] for r in detectors.distinct_phrases(p).collect()} == {"ring of muscle", "six centuries"}


def test_audit_toggles_and_report(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hello there."), (1, 1, "assistant", "He ran. He hid. He sat. He slept."), (2, 0, "user", "x"), (3, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    s = {r["conv_id"]: r for r in audit.summary(turns).collect()}
    assert s[1]["openers"] == 1 and s[3]["is_clean"]
    off = audit.findings(turns, toggles=dict.fromkeys(audit.SCANNERS[1:-1], False) | {"openers": True})
    assert {r["scanner"] for r in off.collect()} == {"openers"}
    text = {r["conv_id"]: r["report"] for r in audit.report(audit.findings(turns), turns).collect()}
    assert "he" in text[1] and text[2] == "No issues found."
