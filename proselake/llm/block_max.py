"""Ranked lexical search with block-max pruning (operator 13).

Documents stand in a forward index of blocks: runs of documents with the terms that any query asks for, each with its
impact, and the block's largest impact of each term. A query's bound on a block is the weighted sum of these maxima.
The blocks of highest bound are scored first and give each query a threshold, the k-th best score so far. Every task then
goes through its blocks in descending bound and stops at the first whose bound is below the threshold, which rises as
the task finds better documents; a bound that equals the threshold is still scored, as ties go by id.

All numbers are 64-bit integers. Queries go in chunks of a bounded size, so that what every task holds of them is bounded.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselake.llm.common import cut

#: The bytes that make up terms (in UTF-8, every byte beyond ASCII), and the constants of the score.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCORE = 1_000_000_000
BLOCK_DOCS = 128
GROUP = 256


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order; only A to Z are lower-cased."""
    return TERM.findall(text.lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """A term's share of the score before its weight, for documents of n terms."""
    m = np.array([50 + 50 * k * n_docs // length for k in n.tolist()], np.int64)
    return SCORE * tf // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class Queries:
    """A chunk of queries: the distinct terms of all, and each query's terms as a slice of `flat`."""

    ids: list
    vocabulary: dict[bytes, int]
    flat: np.ndarray
    ends: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]


def chunks(items: DataFrame, id_col: str, text_col: str, chunk_bytes: int = 8 << 20, chunk_items: int = 10_000) -> Iterator[Queries]:
    """The queries that have terms, in chunks that fit in every task; items are dealt out by hash."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(-(-(size["b"] or 0) // chunk_bytes), -(-size["n"] // chunk_items), 1)
    for k in range(n):
        ids, vocabulary, flat, ends = [], {}, [], [0]
        for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toLocalIterator():
            own = dict.fromkeys(terms(r["text"].encode()))
            if own:
                ids.append(r["id"])
                flat.extend(vocabulary.setdefault(t, len(vocabulary)) for t in own)
                ends.append(len(flat))
        if ids:
            yield Queries(ids, vocabulary, np.array(flat, np.int64), np.array(ends, np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))


def statistics(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents hold each term of the vocabulary."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size + 2, np.int64)
        for b in batches:
            for text in b.column(0):
                found = terms(text.as_py())
                count[size] += bool(found)
                count[size + 1] += len(found)
                for t in vocabulary.keys() & set(found):
                    count[vocabulary[t]] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["term", "n"])

    total = np.zeros(size + 2, np.int64)
    for r in texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["term"]] = r["n"]
    return int(total[size]), int(total[size + 1]), total[:size]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^32, of equal length, byte plane by byte plane."""
    return zlib.compress(np.stack([np.asarray(c, "<u4") for c in columns]).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1).tobytes(), 1)


def _unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(n, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(n, -1).astype(np.int64)


def forward_index(texts: DataFrame, vocabulary: dict[bytes, int], n_docs: int, length: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of documents that hold a term of the vocabulary: block, ids, counts, postings (terms, impacts), maxima (terms, impacts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_blocks = TaskContext.get().partitionId() << 32, 0
        ids, counts, term, tf, n = [], [], [], [], []

        def block() -> pa.RecordBatch:
            nonlocal n_blocks
            t, hit = np.array(term, np.int64), impacts(np.array(tf, np.int64), np.repeat(n, counts), n_docs, length)
            order = np.lexsort((hit, t))
            last = np.flatnonzero(np.diff(t[order], append=-1))  # the largest impact of each term
            cols = [[base + n_blocks], [ids], [counts], [_pack(t, hit)], [_pack(t[order][last], hit[order][last])]]
            n_blocks += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = terms(text.as_py())
                times = Counter(found)
                own = vocabulary.keys() & times.keys()
                if own:
                    ids.append(doc)
                    counts.append(len(own))
                    n.append(len(found))
                    term.extend(vocabulary[t] for t in own)
                    tf.extend(times[t] for t in own)
                if len(ids) == block_docs:
                    yield block()
                    ids, counts, term, tf, n = [], [], [], [], []
        if ids:
            yield block()

    names = ["block", "ids", "counts", "postings", "maxima"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return texts.mapInArrow(run, "block long, ids array<long>, counts array<int>, postings binary, maxima binary")


def _bounds(maxima: list[bytes], q: Queries, flat_weights: np.ndarray) -> np.ndarray:
    """What a document of each block can score at most, for each query and block."""
    out, row = np.empty((len(q.ids), len(maxima)), np.int64), np.zeros(len(q.vocabulary), np.int64)
    for k, b in enumerate(maxima):
        t, high = _unpack(b, 2)
        row[t] = high
        out[:, k] = np.add.reduceat(flat_weights * row[q.flat], q.ends[:-1])
        row[t] = 0
    return out


class _Best:
    """The k best (score, id) so far, ties to the smaller id and a null id last; `least` is what a document must reach."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.score, self.id, self.none = k, least, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        hit = score >= self.least
        self.score, self.id, self.none = np.concatenate([self.score, score[hit]]), np.concatenate([self.id, ids[hit]]), np.concatenate([self.none, none[hit]])
        if len(self.score) >= self.k:
            order = np.lexsort((self.id, self.none, -self.score))[: self.k]
            self.score, self.id, self.none = self.score[order], self.id[order], self.none[order]
            self.least = max(self.least, int(self.score[-1]))


def _scored(index: DataFrame, q: Queries, weights: np.ndarray, least: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """(query, id, score): each task's best documents of each query. only: the queries that ask for a block, else all do."""
    flat_weights = weights[q.flat]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        row = np.zeros(len(q.vocabulary), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, GROUP):
                part = b.slice(s, GROUP)
                bound = _bounds(part.column(4).to_pylist(), q, flat_weights)
                if only is not None:
                    asked = np.zeros_like(bound, bool)
                    for c, block in enumerate(part.column(0).to_pylist()):
                        asked[only.get(block, []), c] = True
                    bound = np.where(asked, bound, 0)
                decoded: dict[int, tuple] = {}
                for i in np.flatnonzero((bound >= least[:, None]).any(1)).tolist():
                    own = best.setdefault(i, _Best(k, int(least[i])))
                    row[q.of(i)] = weights[q.of(i)]
                    for c in np.argsort(-bound[i], kind="stable").tolist():
                        if bound[i, c] < own.least:
                            break
                        if c not in decoded:
                            t, hit = _unpack(part.column(3)[c].as_py(), 2)
                            counts, ids = part.column(2)[c].values.to_numpy(), part.column(1)[c].values
                            none = ids.is_null().to_numpy(zero_copy_only=False)
                            decoded[c] = t, hit, np.cumsum(counts) - counts, ids.fill_null(0).to_numpy(), none
                        t, hit, start, ids, none = decoded[c]
                        own.add(np.add.reduceat(row[t] * hit, start), ids, none)
                    row[q.of(i)] = 0
        for i, own in best.items():
            if len(own.score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own.id), pa.int32()), pa.array(own.id, mask=own.none), pa.array(own.score)], names=["query", "id", "score"])

    found = index.select("block", "ids", "counts", "postings", "maxima").mapInArrow(run, "query int, id long, score long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)


def thresholds(index: DataFrame, q: Queries, weights: np.ndarray, k: int, lead: int = 4) -> np.ndarray:
    """For each query the k-th best score among the documents of its `lead` blocks of highest bound; 1 if there are fewer."""
    flat_weights = weights[q.flat]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, GROUP):
                part = b.slice(s, GROUP)
                bound = _bounds(part.column(1).to_pylist(), q, flat_weights)
                top = np.argsort(-bound, axis=1, kind="stable")[:, :lead]
                query = np.repeat(np.arange(len(bound)), top.shape[1])
                at = top.ravel()
                blocks = part.column(0).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(blocks), pa.array(bound[query, at])], names=["query", "block", "bound"])

    found = index.select("block", "maxima").mapInArrow(run, "query int, block long, bound long").where("bound > 0")
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    only: dict[int, list[int]] = {}
    for r in found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= lead).collect():  # `lead` rows a query of the chunk
        only.setdefault(r["block"], []).append(r["query"])
    least = np.ones(len(q.ids), np.int64)
    blocks = index.sparkSession.createDataFrame([(b,) for b in only], "block long") if only else None
    if blocks is not None:
        scored = _scored(index.join(F.broadcast(blocks), "block", "left_semi"), q, weights, least, k, only)
        for r in scored.where(F.col("rank") == k).select("query", "score").collect():
            least[r["query"]] = r["score"]
    return least


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item with a score above 0, equal scores by ascending id.

    A null text has no terms; a document without terms is never found and counts nowhere. Rows that repeat an id are
    documents of their own, and items that repeat an id are searched for each; a null document id comes last among equal
    scores. Texts may have any length. No items, or none with terms, or no documents: an empty result.
    """
    spark, texts, out = docs.sparkSession, _texts(docs, id_col, text_col), None
    kind = items.schema[item_col].dataType.simpleString()
    for q in chunks(items, item_col, item_text):
        n_docs, length, df = statistics(texts, q.vocabulary)
        if not n_docs:
            continue
        weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
        index = cut(forward_index(texts, q.vocabulary, n_docs, length, block_docs))
        found = _scored(index, q, weights, thresholds(index, q, weights, k), k)
        names = spark.createDataFrame(list(enumerate(q.ids)), f"query int, item {kind}")
        found = found.join(F.broadcast(names), "query").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item {kind}, rank int, id long, score long") if out is None else out
