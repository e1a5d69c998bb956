"""BPE encoding and decoding with a table of distinct words (operator 12).

Texts are split into words, and a block of documents keeps each of its words once: a document is then a row of places in
its block's list. The lists are dealt by the words' hash, so that all askers of a word meet where it is encoded, once; its
ids go back to the blocks and are joined to the documents by place. Decoding joins ids with the vocabulary's pieces.

Only lists of distinct words are shuffled, never texts or documents: their packed places are written once, bucketed by
block, and ids come to them. Blocks and buckets grow with the input, so that both the number of messages and each one's size
stay in bounds.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from proselake.llm.common import bucketed, shuffle_partitions

VOCABULARY = "word_bpe_49k.json"
#: Words of a lower-case text as this vocabulary's public tokenizer splits them (fixed value), for characters below U+0250:
#: there every Unicode version agrees, composition changes nothing, and lower case goes letter by letter.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\u0085 \p{L}\p{N}]+"
BEYOND = r"[^\x00-ɏ]|İ"
CHUNK_WORDS = 1 << 18
OUT_ROWS = 512
SPLIT = "block long, bucket int, ids array<long>, counts array<int>, places binary, words binary"


@lru_cache(maxsize=4)
def _spec(vocabulary: str) -> dict:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        return json.load(f)


def added_tokens(vocabulary: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in _spec(vocabulary).get("added_tokens", [])}


@lru_cache(maxsize=4)
def pieces(vocabulary: str) -> pa.Array:
    """The pieces in order of their ids: the table that decoding joins with, bounded by the vocabulary."""
    spec = _spec(vocabulary)
    known = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in added_tokens(vocabulary).items()}
    return pa.array([known.get(i, "") for i in range(max(known) + 1)], pa.string())


@lru_cache(maxsize=4)
def _whole(vocabulary: str):
    """The vocabulary's tokenizer, and the pattern that finds its added tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    marks = "|".join(re.escape(t) for t in sorted(added_tokens(vocabulary), key=len, reverse=True))
    return Tokenizer.from_file(public_tokenizers.path(vocabulary)), re.compile(f"({marks})" if marks else "(?!)")


@lru_cache(maxsize=4)
def word_encoder(vocabulary: str):
    """From a list of distinct words to the ids of each: merges alone, as the words are normal and split already."""
    from tokenizers import Tokenizer, pre_tokenizers

    added = added_tokens(vocabulary)
    bare = Tokenizer(_whole(vocabulary)[0].model)
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(words: list[str]) -> list[list[int]]:
        found = [e.ids for e in bare.encode_batch(words, add_special_tokens=False)]
        return [[added[w]] if w in added else ids for w, ids in zip(words, found)]

    return encode


def split_text(text: str, vocabulary: str = VOCABULARY) -> list[str]:
    """Words of any text, by the vocabulary's own rules; an added token in the text is a word of its own."""
    tokenizer, marks = _whole(vocabulary)
    words: list[str] = []
    for k, part in enumerate(marks.split(text)):
        if k % 2:
            words.append(part)
        elif part:
            words.extend(w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part)))
    return words


def _unmapped(vocabulary: str):
    """The words that pre_tokenize_str gives bear stand-ins for bytes; this gives the characters back."""
    from proselake.llm.packing import _byte_of_char

    back, added = _byte_of_char(), added_tokens(vocabulary)
    return lambda w: w.encode() if w in added else bytes(back[c] for c in w)


def _packed(n: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(n, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(at: list[int], words: list[bytes]) -> bytes:
    """Words with their places in the block's list, which ascend."""
    head = np.array([len(words), *np.diff(at, prepend=0), *map(len, words)], "<u4")
    return zstandard.compress(head.tobytes() + b"".join(words))


def _unpack_words(b: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(b)
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, "<u4", 2 * n, 4)
    ends = np.cumsum(head[n:], dtype=np.int64) + 4 + 8 * n
    starts = ends - head[n:]
    return np.cumsum(head[:n], dtype=np.int64), [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def split_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, buckets: int, vocabulary: str) -> DataFrame:
    """Blocks of documents: rows of documents as places in the block's list of words (bucket -1), and that list, by bucket.

    Plain texts are split by Spark's own expressions, the rest by the vocabulary's tokenizer.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    odd = F.regexp_like(text, F.lit(BEYOND))
    for mark in added_tokens(vocabulary):
        odd = odd | F.contains(text, F.lit(mark))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), odd.alias("odd"))
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), "\n")  # no word holds white space
    rows = rows.select("id", F.when(F.col("odd"), F.col("text")).alias("text"), F.when(~F.col("odd"), words.cast("binary")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        plain = _unmapped(vocabulary)
        at: dict[bytes, int] = {}
        chunk: list[tuple] = []  # (id, places)
        held = size = n_blocks = 0
        block = TaskContext.get().partitionId() << 32

        def document_rows() -> pa.RecordBatch:
            ids, places = [c[0] for c in chunk], [c[1] for c in chunk]
            cols = [[block], [-1], [ids], [[len(p) for p in places]], [_packed(np.concatenate(places))], [None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def word_rows() -> Iterator[pa.RecordBatch]:
            by: dict[int, tuple[list[int], list[bytes]]] = {}
            for w, k in at.items():
                places, words = by.setdefault(zlib.crc32(w) % buckets, ([], []))
                places.append(k)
                words.append(w)
            if by:
                lists = [_pack_words(*v) for v in by.values()]
                cols = [[block] * len(by), list(by), [None] * len(by), [None] * len(by), [None] * len(by), lists]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def places_of(words: list[bytes]) -> np.ndarray:
            return np.fromiter((at.setdefault(w, len(at)) for w in words), np.uint32, len(words))

        for b in batches:
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if own.is_valid:
                    places = places_of(own.as_py().split(b"\n") if len(own.as_buffer()) else [])
                else:
                    places = places_of([plain(w) for w in split_text(text.as_py(), vocabulary)])
                chunk.append((doc, places))
                held += len(places) + 1
                size += 6 * (len(places) + 1)
                if held >= CHUNK_WORDS:
                    yield document_rows()
                    chunk, held = [], 0
            if size >= block_bytes:
                if chunk:
                    yield document_rows()
                yield from word_rows()
                n_blocks += 1
                at, chunk, held, size, block = {}, [], 0, 0, (block >> 32 << 32) + n_blocks
        if chunk:
            yield document_rows()
        yield from word_rows()
        pa.default_memory_pool().release_unused()

    names = ["block", "bucket", "ids", "counts", "places", "words"]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return rows.mapInArrow(run, SPLIT)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_bytes: int | None = None, buckets: int | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "ids_sha256")) -> DataFrame:
    """A row for each document: id and the outputs n_tokens, ids (array of int), ids_sha256 (of the ids as little-endian 32-bit
    integers) or decoded (as decode() tells), in any choice.

    Ids equal those of the vocabulary's tokenizer without special tokens, truncation and padding; an added token's string in
    a text is that token. A null text counts as empty, which has no ids. Rows that repeat an id, or have none, keep a row
    each. An empty table gives an empty result. A word or a text may have any length.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    block_bytes = block_bytes or min(max(8 << 20, total // 4000), 64 << 20)
    buckets = buckets or max(256, total >> 25)
    parts = max(shuffle_partitions(docs.sparkSession), total >> 24)  # stated, as packed rows look too small to be worth a task
    split = bucketed(split_blocks(docs, id_col, text_col, block_bytes, buckets, vocabulary), "block", parts)

    def tell(rows: pa.Table) -> pa.Table:
        lists = [_unpack_words(b.as_py()) for b in rows["words"]]
        at: dict[bytes, int] = {}
        asked = [[at.setdefault(w, len(at)) for w in words] for _, words in lists]
        found = word_encoder(vocabulary)([w.decode() for w in at])
        n = np.array([len(f) for f in found], np.int64)
        ends = np.cumsum(n)
        flat = np.array([i for f in found for i in f], np.uint32)
        told = []
        for (places, _), own in zip(lists, asked):
            own = np.array(own, np.int64)
            told.append((_packed(np.diff(places, prepend=0)), _packed(n[own]), _packed(flat[_ranges(ends[own] - n[own], n[own])])))
        return pa.table([rows["block"], *(pa.array(c, pa.binary()) for c in zip(*told))], names=["block", "at", "n", "tokens"])

    def join(block: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        at = [np.cumsum(_unpacked(b.as_py()), dtype=np.int64) for b in told["at"]]
        lengths = [_unpacked(b.as_py()).astype(np.int64) for b in told["n"]]
        flat = np.concatenate([_unpacked(b.as_py()) for b in told["tokens"]] or [np.zeros(0, np.uint32)])
        size = sum(map(len, at))
        n, start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if size:
            every, count = np.concatenate(at), np.concatenate(lengths)
            n[every] = count
            start[every] = np.cumsum(count) - count
        out = []
        for docs_, counts, packed in zip(own["ids"], own["counts"], own["places"]):
            places = _unpacked(packed.as_py())
            got = flat[_ranges(start[places], n[places])]
            ends = np.concatenate([[0], np.cumsum(n[places])])[np.concatenate([[0], np.cumsum(counts.values.to_numpy())])]
            for k in range(0, len(docs_), OUT_ROWS):  # small batches, as both sides of the worker hold them
                cut_ = ends[k : k + OUT_ROWS + 1]
                tokens = pa.ListArray.from_arrays(pa.array(cut_ - cut_[0], pa.int32()), pa.array(got[cut_[0] : cut_[-1]].astype(np.int32)))
                made = {"id": docs_.values.slice(k, len(tokens)), "n_tokens": pa.array(np.diff(cut_), pa.int64()), "ids": tokens}
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = pa.array([hashlib.sha256(got[s:e].tobytes()).hexdigest() for s, e in zip(cut_[:-1].tolist(), cut_[1:].tolist())], pa.string())
                if "decoded" in outputs:
                    made["decoded"] = decoded_texts(tokens, vocabulary)
                out.append(pa.RecordBatch.from_arrays([made[c] for c in ("id", *outputs)], schema=schema))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, schema)

    kinds = {"id": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string())}
    schema = pa.schema([(c, kinds[c][1]) for c in ("id", *outputs)])
    asks, own = split.where("bucket >= 0").select("block", "bucket", "words"), split.where("bucket < 0").select("block", "ids", "counts", "places")
    told = asks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(tell, "block long, at binary, n binary, tokens binary")
    return own.groupBy("block").cogroup(told.repartition(parts, "block").groupBy("block")).applyInArrow(join, ", ".join(f"{c} {kinds[c][0]}" for c in ("id", *outputs)))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n places for each entry, one after another."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def decoded_texts(lists: pa.ListArray, vocabulary: str) -> pa.Array:
    """The pieces of each list of ids, which join the table of pieces by place, with a space between them."""
    table, flat = pieces(vocabulary), lists.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    found = table.take(pc.if_else(known, flat, None))
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    named = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
    if found.null_count:
        named = pa.array([[p for p in row if p is not None] for row in named.to_pylist()], pa.list_(pa.string()))
    return pc.if_else(lists.is_valid(), pc.binary_join(named, " "), None).cast(pa.string())


def decode(encoded: DataFrame, ids_col: str = "ids", to: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns and the text of the ids, as the vocabulary's tokenizer decodes them with special tokens kept.

    Ids join the table of pieces by place, as pieces are numbered; the table is as large as the vocabulary and each worker
    holds it. An id that is null or beyond the table has no piece, as in the tokenizer. No ids: an empty text; null: null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = decoded_texts(b.column(b.schema.get_field_index(ids_col)), vocabulary)
                yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, to])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(to, StringType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded): every text encoded, and its ids decoded."""
    return encode(docs, id_col, text_col, vocabulary, outputs=("n_tokens", "ids_sha256", "decoded"))
