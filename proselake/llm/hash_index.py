"""Approximate nearest neighbours (operator 1): multi-index hashing over learned rotated binary codes.

Codes: vectors are centred, turned onto their principal axes and by several rotations learned to make the signs fit (the
iterative-quantization objective), one bit an axis and rotation. Each code is split into substrings of 16 bits, and each
substring has its own index. If two codes differ in at most m * (s + 1) - 1 bits, one of their m substrings differs in at
most s bits; probing the buckets within s of the query's substrings therefore finds every code of that radius. s grows until
that radius holds enough codes, or, from s = 3 on, until enough codes have been probed at all: where vectors lie evenly, the
nearest codes are far beyond the radius and most are probed all the same. The probed codes nearest by all their bits are
ranked by their original vectors.

The rotations are fitted on a bounded sample; every vector is indexed. The index is dealt to shards of bounded size, the
queries to blocks of bounded size, and each pair of shard and block is a task of its own. Equal vectors are one entry.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselake.llm.common import cut, valid_vectors

WIDE = 16  # bits of a substring
_MASKS = [np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDE), s)], np.int64) for s in range(WIDE + 1)]


@dataclass
class Rotations:
    mean: np.ndarray
    turns: np.ndarray  # dimensions x bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of bytes."""
        return np.packbits((x - self.mean) @ self.turns > 0, axis=1)


def learn(sample: np.ndarray, bits: int = 768, rounds: int = 20, seed: int = 7) -> Rotations:
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    v = (sample - mean) @ axes.T
    d = v.shape[1]
    turns = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        turns.append(axes.T @ r)
    return Rotations(mean, np.concatenate(turns, 1)[:, :bits])


class SubstringIndex:
    """The shard's codes, by the value of each of their substrings."""

    def __init__(self, codes: np.ndarray) -> None:
        if codes.shape[1] % 8:
            raise ValueError("codes must be whole 64-bit words")
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        parts = np.ascontiguousarray(codes).view(">u2").astype(np.int64)
        self.order = np.argsort(parts, axis=0, kind="stable").astype(np.int32)
        self.starts = [np.searchsorted(parts[self.order[:, j], j], np.arange((1 << WIDE) + 1)).astype(np.int32) for j in range(parts.shape[1])]

    def __len__(self) -> int:
        return len(self.words)

    def probe(self, code: np.ndarray, s: int, hit: np.ndarray) -> None:
        """Mark the codes of which a substring differs from the query's in exactly s bits."""
        for j, value in enumerate(np.ascontiguousarray(code).view(">u2").astype(np.int64).tolist()):
            at, starts = _MASKS[s] ^ value, self.starts[j]
            first, size = starts[at], starts[at + 1] - starts[at]
            some = np.flatnonzero(size)
            first, size = first[some], size[some]
            hit[self.order[np.repeat(first - (size.cumsum() - size), size) + np.arange(size.sum()), j]] = True

    def distances(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[at] ^ np.ascontiguousarray(code).view(np.uint64)).sum(1, dtype=np.int64)

    def nearest(self, code: np.ndarray, enough: int, even: int = 3) -> tuple[np.ndarray, int]:
        """The probed codes within the smallest distance that `enough` of them have, and how many were probed."""
        m, hit = len(self.starts), np.zeros(len(self), bool)
        enough = min(enough, len(self))
        for s in range(WIDE + 1):
            self.probe(code, s, hit)
            at = np.flatnonzero(hit)
            if len(at) < enough:
                continue
            d = self.distances(code, at)
            radius = np.partition(d, enough - 1)[enough - 1]
            if radius < m * (s + 1) or s >= even:
                break
        return at[d <= radius], len(at)


def _rows(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, sample_rows: int = 10_000, bits: int = 768, enough: int = 512, shard_rows: int = 65_536, block_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which the column `is_query` holds.

    Nearest first by Euclidean distance in double precision; ties go to smaller ids. Rows that are null, zero or hold null or
    non-finite components, and rows with a null id, take no part; so do rows whose vector's length isn't the commonest.
    Rows with the query's id are its own and no candidates. Fewer than k candidates: all of them. No rows: no result.
    """
    rows = valid_vectors(vectors, vec_col).where(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.size("vec") == sizes["d"])
    # entries: distinct vectors with their k + 1 smallest ids; more can't be among the k nearest of any query
    by_id = Window.partitionBy("vec").orderBy("id")
    ids = rows.select("id", "vec").distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    entries = cut(ids.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.col("ids")[0]))
    n = entries.count()
    sample = entries.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("vec").toArrow()
    model = learn(_rows(sample["vec"]), bits)
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "vec")
    asked = cut(asking.join(entries.select("vec", "key"), "vec").select("query_id", "key").distinct())
    heads = asked.select("key").distinct().join(entries.select("key", F.col("vec").alias("asked")), "key")
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // block_rows))
    left = entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = heads.withColumn("block", F.pmod(F.xxhash64(F.col("key") + 1), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(index: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_i, out_d = [], [], []
        if index.num_rows and queries.num_rows:
            x = _rows(index["vec"])
            own = index["ids"].to_pylist()
            tables = SubstringIndex(model.codes(x))
            q = _rows(queries["asked"])
            for key, v, code in zip(queries["key"].to_pylist(), q, model.codes(q)):
                at, _ = tables.nearest(code, enough)
                d = np.sqrt(np.cumsum((x[at] - v) ** 2, axis=1)[:, -1])  # in order of the dimensions, whatever the batch
                if len(d) > k + 1:
                    far = np.partition(d, k)[k]
                    at, d = at[d <= far], d[d <= far]
                best = sorted((float(y), i) for y, a in zip(d, at.tolist()) for i in own[a])[: k + 1]
                out_q += [key] * len(best)
                out_i += [i for _, i in best]
                out_d += [y for y, _ in best]
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_d, pa.float64())], names=["key", "vec_id", "score"])

    found = left.select("shard", "block", "vec", "ids").groupBy("shard", "block").cogroup(right.select("shard", "block", "key", "asked").groupBy("shard", "block")).applyInArrow(cell, "key long, vec_id long, score double")
    nearest_first = Window.partitionBy("key").orderBy("score", "vec_id")
    found = found.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= k + 1)
    answers = asked.join(found, "key").where(F.col("query_id") != F.col("vec_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
