"""Operator 12 against the untouched tokenizer: ids, digests and decoded texts must be equal."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proselake.llm import queries, word_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(word_table.VOCABULARY))


def check(rows, texts, whole):
    assert sorted(r["id"] for r in rows) == sorted(texts)
    for r in rows:
        want = whole.encode(texts[r["id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want), texts[r["id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded"] == whole.decode(want, skip_special_tokens=False)


def test_every_plain_character(spark, whole):
    texts = {c: f"a{chr(c)}b {chr(c)}{chr(c)} 's{chr(c)}'s X{chr(c)}" for c in range(0x250)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(word_table.decode(word_table.encode(docs, block_bytes=3000, buckets=7)).collect(), texts, whole)


def test_any_text(spark, whole):
    draw, alphabet = random.Random(1), "aZ'sé  \n\t09.,!<|>ÄßIİſK日本ー한각́̇J̌Σσς½² \u0085​\x1c\x00_ŉǆ😀"
    texts = dict(enumerate("".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(1500)))
    odd = ["a <|endoftext|> B<|startoftext|><|endoftext|>x", "<|ENDOFTEXT|>", "", None, " " * 1_000_000, "\n" * 300_000, "a" * 100_000, "it's we'll don't 'S", "x " * 200_000]
    texts |= {10_000 + k: t for k, t in enumerate(odd)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check(word_table.decode(word_table.encode(docs, block_bytes=2000, buckets=5)).collect(), texts, whole)


def test_repeats_nulls_and_clashing_columns(spark, whole):
    rows = [(1, "a b", 0, 9), (1, "a b", 1, 9), (None, "c", 2, 9), (2, None, 3, 9), (None, None, 4, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, ids int")
    got = word_table.decode(word_table.encode(docs)).collect()
    want = lambda t: whole.encode(t or "", add_special_tokens=False).ids
    assert sorted(((r["id"] or 0), tuple(r["ids"])) for r in got) == sorted(((r[0] or 0), tuple(want(r[1]))) for r in rows)


def test_empty_table(spark):
    assert word_table.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decode_any_ids(spark, whole):
    rows = [(1, [320, 343]), (2, []), (3, None), (4, [320, None, 99_999_999, -1, 49407])]
    got = {r["k"]: r["decoded"] for r in word_table.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert got == {1: whole.decode([320, 343], skip_special_tokens=False), 2: "", 3: None, 4: whole.decode([320, 49407], skip_special_tokens=False)}


def test_query_on_whole_table(spark, whole):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_word_table(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
