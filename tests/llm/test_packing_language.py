import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proselake.llm import language_id, packing

P = pytest.importorskip("public_tokenizers")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", "Hello there's <|endoftext|> x", "<|endoftext|> hi", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|", "x  <|endoftext|>  y <|ENDOFTEXT|>", "ß é  \n\n\t tab nb", "日本語テキスト 123 4567!!", "a" * 3000, "'ll 've don't\r\n  ", " 　x\x85y\x1cz", "🙂🙃 ok", " ".join(f"w{k}" for k in range(5000))]


def test_ids_equal_tokenizers():
    encode = packing.encoder(packing.VOCABULARY)
    assert [[*encode(t), 2] for t in TEXTS] == reference_ids(TEXTS)


@given(st.lists(st.lists(st.one_of(st.text(), st.just("<|endoftext|>"))).map("".join), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_ids_equal_tokenizers_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    encode = packing.encoder(packing.VOCABULARY)
    assert [[*encode(t), 2] for t in texts] == reference_ids(texts)


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_bins_and_bound(lengths):
    order = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, room = packing.best_fit_decreasing(order, 64)
    for b in range(len(room)):
        own = bins == b
        assert order[own].sum() == 64 - room[b] and sorted(offsets[own]) == list(np.cumsum([0, *order[own][np.argsort(offsets[own])]])[:-1])
    assert -(-sum(lengths) // 64) <= packing.lower_bound(order, 64) <= len(room)


def test_round_trip(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice(TEXTS[1].split() + ["der", "zug"]) for _ in range(rng.randrange(900)))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(7, "again"), (None, "no id"), (200, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"piece": F.lit(9), "offset": F.lit("x"), "row": F.lit(1)}).repartition(5)
    rows = packing.packed_documents(df).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    want = {}
    for k, t in docs:
        ids = reference_ids([t or ""])[0]
        for p, (s, n) in enumerate(packing.cuts(len(ids))):
            want.setdefault(k, []).append((p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    lengths = np.array([r["length"] for r in rows])
    assert len(by_seq) <= packing.lower_bound(lengths, 1024) + 2
    seqs = packing.sequences(spark.createDataFrame(docs[:70], "doc_id long, text string")).collect()
    assert sorted(i for s in seqs for i in s["ids"]) == sorted(i for _, t in docs[:70] for i in reference_ids([t or ""])[0])
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_cuts():
    assert packing.cuts(1024) == [(0, 1024)] and packing.cuts(1025) == [(0, 1), (1, 1024)] and packing.cuts(2048) == [(0, 1024), (1024, 1024)]


WORDS = {"en": "the of and to in that is was for on", "de": "der die und das nicht ein eine mit auf für", "fr": "le la les des et une dans pour qui être"}


def language_rows(n=240):
    rng = random.Random(4)
    out = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40))), lang))
    return out


def test_language(spark):
    rows = language_rows() + [(900, None, "en"), (901, "", "en"), (902, "1234 %%% 5", "de"), (903, "das ist nicht gut " * 20000, "de"), (None, "une dans pour", "fr"), (5, language_rows()[5][1], "de"), (904, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("zz"), "score": F.lit("x"), "places": F.lit(1)})
    model = language_id.train(df, max_rows=120, landmarks=40)
    assert model.languages == ["de", "en", "fr"]
    got = language_id.predict(df.withColumn("held", language_id.held_out()), model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["lang_pred"] for k in (900, 901, 902)} == {"und"} and by[903]["lang_pred"] == "de" and by[904]["lang_pred"] in model.languages
    held = [r for r in got if r["held"] and r["lang"] and r["lang_pred"] != "und" and r["doc_id"] < 240]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    for r in got:
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert language_id.predict(df.limit(0), model).count() == 0
    assert language_id.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def test_held_out_teaches_nothing(spark):
    rows = language_rows(90)
    wrong = [(k, t, "en" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (language_id.train(spark.createDataFrame(r, schema), landmarks=30) for r in (rows, wrong))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def brute_places(text):
    """Places of a text's n-grams, one n-gram at a time."""
    raw = "".join(chr(b) if b >= 128 or 97 <= b <= 122 else " " for b in text.lower().encode())
    raw = (" " + " ".join(raw.split(" ")) + " ").encode("latin-1")
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    out = set()
    for n in (1, 2, 3):
        for k in range(len(raw) - n + 1):
            v = int.from_bytes(raw[k : k + n], "big")
            out.add(v if n == 1 else ((v * 40503 + 977) % 2**32 >> 3) % 65536 if n == 2 else v * 2654435761 % 2**32 >> 16)
    return out


def brute_scores(train, texts, landmarks=256, ridge=1e-3):
    """Kernel ridge regression on the landmarks' kernel by least squares; train: (text, language)."""
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    train = sorted((lang, np.array(sorted(p), "<u2").tobytes(), p) for t, lang in train for p in [brute_places(t)])
    languages = sorted({lang for lang, *_ in train})
    queues = {lang: [k for k, r in enumerate(train) if r[0] == lang] for lang in languages}
    z = [q[turn] for turn in range(len(train)) for q in queues.values() if turn < len(q)][:landmarks]
    k_nm = np.array([[kernel(r[2], train[m][2]) for m in z] for r in train])
    k_mm = k_nm[z]
    val, vec = np.linalg.eigh(k_mm)
    keep = val > 1e-6 * val.max()
    w = np.array([len(train) / (len(languages) * len(queues[r[0]])) for r in train])
    out = []
    for lang in languages:
        y = np.array([1.0 if r[0] == lang else -1.0 for r in train])
        y = y - (y * w).sum() / w.sum()
        basis = vec[:, keep]
        penalty = (ridge * len(train)) ** 0.5 * np.sqrt(val[keep])[:, None] * np.eye(keep.sum())
        a = np.vstack([np.sqrt(w)[:, None] * (k_nm @ basis), penalty])
        beta = np.linalg.lstsq(a, np.concatenate([np.sqrt(w) * y, np.zeros(keep.sum())]), rcond=None)[0]
        out.append(basis @ beta)
    k = np.array([[kernel(brute_places(t), train[m][2]) for m in z] for t in texts])
    return languages, k @ np.array(out).T


def test_op4_by_brute_force(spark, tmp_path):
    """The registered query against kernels computed from sets of n-grams, text by text."""
    from proselake.llm import queries

    rows = [(k, t, None if k % 17 == 0 else lang) for k, t, lang in language_rows(200)] + [(900, None, "en"), (901, " 12 ", "de"), (902, "Über das Ende der Straße", None), (903, "the " * 3000, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, str(tmp_path)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, *_ in rows}
    told = {k: t for k, t, _ in rows if t and any(c.isalpha() for c in t)}
    languages, scores = brute_scores([(told[k], lang) for k, _, lang in rows if k in told and lang and not held[k]], list(told.values()))
    for k, f in zip(told, scores):
        e = np.exp(4 * (f - f.max()))
        assert got[k]["lang_pred"] == languages[int(f.argmax())] and abs(got[k]["score"] - e.max() / e.sum()) < 1e-3
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in got if k not in told)
    assert {k: r["held_out"] for k, r in got.items()} == held


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 700_000 + "b " + " " * 1_000_001 + "c <|endoftext|>"])
def test_long_white_space(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)).encode(text, add_special_tokens=False).ids
    assert packing.encoder(packing.VOCABULARY)(text) == want
    docs = spark.createDataFrame([(1, text), (2, "word"), (3, None)], "doc_id long, text string")
    rows = packing.packed_documents(docs).collect()
    assert sum(r["length"] for r in rows if r["id"] == 1) == len(want) + 1
    ids = np.array([*want, packing.END_ID], "<u4")
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows if r["id"] == 1)


def test_rows_without_letters_take_no_place(spark):
    """A language of which nearly all rows are empty is learned from the rest."""
    german = [(k, "der alte mann geht langsam durch den wald" if k % 2000 == 0 else (None if k % 2 else "123 --"), "de") for k in range(40_000)]
    english = [(100_000 + k, f"the old man walks slowly through wood number {k}", "en") for k in range(2_000)]
    model = language_id.train(spark.createDataFrame(german + english, "doc_id long, text string, lang string"))
    assert sorted(model.languages) == ["de", "en"]
