"""Best-fit packing (operator 3): bound-certified repacking of tokenized documents into sequences.

Every partition packs its own pieces best-fit decreasing and compares its bin count with a lower bound from dual-feasible
functions. A partition that meets its bound is certified: it keeps its bins, but for the emptiest one. A partition with a
gap keeps its full bins. What is left is exchanged, by hash, among fewer partitions, which pack again; after the last
round everything is kept. No text and no ids are shuffled, only (id, piece, length).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: The pre-token pattern of this vocabulary, as its public tokenizer defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space beyond this length go to the library whose splitting keeps no place for each character of a run.
LONG_RUN = 100_000
SPACE = re.compile(r"\s+")


def _has_long_run(text: str) -> bool:
    return len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in SPACE.finditer(text))


def _byte_of_char() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file: visible Latin-1 characters stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers JSON file, run by the faster of the two libraries that read this vocabulary.

    Ids equal those of tokenizers.Tokenizer.encode(add_special_tokens=False): an added token's string in a text is that token.
    Texts with very long runs of white space, which the faster one can't split, are left to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    back = _byte_of_char()
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)
    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(public_tokenizers.path(vocabulary)))

    def encode(text: str) -> list[int]:
        if _has_long_run(text):
            return whole().encode(text, add_special_tokens=False).ids
        if any(m in text for m in marks):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first can be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves.

    A null text counts as empty; every document ends with END_ID, so that it has one piece at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            ids, piece, start, length, crc, own = [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for k, (s, n) in enumerate(cuts(len(tokens), capacity)):
                    part = tokens[s : s + n]
                    ids.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        own.append(part.astype(np.int32))
            cols = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual-feasible functions over the lengths' histogram."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    above = count[::-1].cumsum()[::-1]  # pieces of at least so many
    mass = (count * size).cumsum()
    for eps in range(1, capacity // 2 + 1):  # sizes over capacity - eps round up to a whole bin, sizes under eps to none
        whole = above[capacity - eps + 1]
        best = max(best, int(whole) + -(-int(mass[capacity - eps] - mass[eps - 1]) // capacity))
    for k in range(1, 21):  # rounding to multiples of 1/k of a bin
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which come in decreasing order, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r exists
    for k, n in enumerate(lengths.tolist()):
        fitting = some >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            at = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, at = capacity, len(room)
            room.append(capacity)
        bins[k], offsets[k] = at, capacity - r
        room[at] = r - n
        if r > n:
            by_room[r - n].append(at)
            some |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def _pack_once(df: DataFrame, capacity: int, turn: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        is_open = np.zeros(len(room), bool)
        if not last:
            is_open = room > 0
            if not gap:
                is_open &= np.arange(len(room)) == room.argmax()
        base = (turn << 58) + (TaskContext.get().partitionId() << 32)
        cols = [t["id"], t["piece"], t["length"], pa.array(bins + base), pa.array(offsets), pa.array(is_open[bins])]
        yield from pa.table(cols, names=["id", "piece", "length", "sequence_id", "offset", "is_open"]).to_batches(max_chunksize=1 << 16)

    return df.select("id", "piece", "length").mapInArrow(run, "id long, piece int, length long, sequence_id long, offset long, is_open boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_rows: int = 200_000, rounds: int = 4) -> DataFrame:
    """(id, piece, length, sequence_id, offset) of all pieces; lengths are 1 to capacity.

    Best-fit decreasing a partition, certified by lower_bound(); open bins are exchanged among ever fewer partitions of up
    to `task_rows` pieces. Two rows with the same id and piece are packed apart. An empty table gives an empty result.
    """
    kept, rest = [], pieces
    for turn in range(rounds):
        last = turn == rounds - 1
        done = cut(_pack_once(rest, capacity, turn, last))
        kept.append(done.where("NOT is_open"))
        rest = done.where("is_open")
        n = 0 if last else rest.count()
        if not n:
            break
        parts = min(-(-n // task_rows), max(1, done.rdd.getNumPartitions() // 2))
        if parts == 1:
            kept.append(_pack_once(rest.repartition(1), capacity, turn + 1, True))
            break
        rest = rest.repartition(parts, F.xxhash64("id", "piece", F.lit(turn)))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.drop("is_open")


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; a text may have any length and be white space alone. Rows that repeat an id keep a piece each: they are told apart by a row number, and so are
    rows with a null id.
    """
    pieces = cut(tokenized(docs, id_col, text_col, capacity, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    placed = pack(pieces.select(F.col("row").alias("id"), "piece", "length"), capacity)
    placed = placed.select(F.col("id").alias("row"), "sequence_id", "offset")
    return pieces.join(placed, "row").drop("row")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and parts (id, piece, start, length, offset) in order."""
    place = packed_documents(docs, id_col, text_col, capacity, vocabulary)
    ids = tokenized(docs, id_col, text_col, capacity, vocabulary, with_ids=True).select("id", "piece", "ids", "ids_crc32").dropDuplicates(["id", "piece", "ids_crc32"])
    same = F.expr("p.id <=> i.id AND p.piece = i.piece AND p.ids_crc32 = i.ids_crc32")
    rows = place.alias("p").join(ids.alias("i"), same).select("p.*", "i.ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "start", "length", "ids")))
    grouped = rows.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))
