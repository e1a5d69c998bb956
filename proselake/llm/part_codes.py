"""Vector code compression with partial-distance search (operator 11).

Vectors become integers and are cut into equal parts; each part position has a small codebook of integer entries. A part's
nearest entry is found dimension by dimension, in the order of the codebook's variance: every row completes the distance of
the entry that looks best so far, and entries whose partial distance strictly exceeds that row's best complete distance are
dropped by masks. Sums of a round are added up before they are shuffled; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut

SCALE = 256
#: Integers are held within these bounds (vectors of components within 262,144), so that sums of squares fit in 64 bits.
MOST = 1 << 26
SLAB = 4096


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # (parts, entries, dimensions of a part), int64

    @property
    def size(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, the lower index where two are as near."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for s in range(0, len(x), SLAB):
        part = x[s : s + SLAB]
        every = np.arange(len(part))
        partial = (part[:, order[0], None] - book[None, :, order[0]]) ** 2
        best = ((part - book[partial.argmin(1)]) ** 2).sum(1)
        rows, entries = np.nonzero(partial <= best[:, None])
        partial = partial[rows, entries]
        for d in order[1:]:
            partial = partial + (part[rows, d] - book[entries, d]) ** 2
            start = np.searchsorted(rows, every)
            least = np.minimum.reduceat(partial, start)
            hit = np.flatnonzero(partial == least[rows])
            looks = entries[hit[np.searchsorted(rows[hit], every)]]
            best = np.minimum(best, ((part - book[looks]) ** 2).sum(1))
            alive = partial <= best[rows]
            rows, entries, partial = rows[alive], entries[alive], partial[alive]
        hit = np.flatnonzero(partial == best[rows])
        index[s : s + SLAB] = entries[hit[np.searchsorted(rows[hit], every)]]
        distance[s : s + SLAB] = best
    return index, distance


def assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances) of each row and part."""
    parts, _, wide = books.entries.shape
    found = [nearest(x[:, p * wide : (p + 1) * wide], books.entries[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def usable(vec: Column, parts: int) -> Column:
    """Vectors that have only finite components and can be cut into equal parts."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & (F.size(vec) % parts == 0) & F.coalesce(fine, F.lit(False))


def _vectors(b: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return integers(b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def train(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks that start as the parts of the rows with the smallest ids and are moved to their parts' floored means.

    Every usable vector takes part in every round. Unused entries stay. Rows that repeat an id go by their vectors' order; a
    null id comes last. The first row sets the length; vectors of another length are left out. No usable vector: None.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).where(usable(F.col("vec"), parts))
    first = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(1).collect()
    if not first:
        return None
    size = len(first[0]["vec"])
    rows = rows.where(F.size("vec") == size)
    seeds = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    start = integers(np.array([r["vec"] for r in seeds]))
    books = Codebooks(start.reshape(len(seeds), parts, size // parts).swapaxes(0, 1).copy())
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    parts, k, wide = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, wide), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            if b.num_rows:
                x = _vectors(b, 0, books.size)
                codes, _ = assigned(x, books)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p * wide : (p + 1) * wide])
                    count[p] += np.bincount(codes[:, p], minlength=k)
        used = np.argwhere(count > 0)
        if len(used):
            p, e = used.T
            sums = pa.array(list(total[p, e]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], names=["part", "entry", "n", "sums"])

    partial = rows.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    sums = F.array(*(F.sum(F.get("sums", F.lit(j))) for j in range(wide)))
    moved = books.entries.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # as many rows as entries
        moved[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return Codebooks(moved)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, code, error) of every usable vector of the codebooks' length: a byte for each part, and the
    squared distances summed over the parts."""
    parts = books.entries.shape[0]
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(vec.alias("vec"), F.col(id_col).alias("id"), *carry).where(usable(F.col("vec"), parts) & (F.size("vec") == books.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, distance = assigned(_vectors(b, 0, books.size), books)
                packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], packed, pa.array(distance.sum(1))], names=[*b.schema.names[1:], "code", "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(run, ", ".join([*fields, "code binary", "error long"]))


def with_group_error(coded: DataFrame, label_col: str, most_labels: int = 100_000) -> DataFrame:
    """All columns and the errors summed over rows of an equal label, nulls together.

    Up to `most_labels` sums are broadcast. Beyond, those of labels that hold over a thousandth of the rows, at most 1,000,
    are, and the other labels are joined by a shuffle, so that no task gets a large label's rows.
    """
    sums = cut(coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    same = F.col(label_col).eqNullSafe(F.col("_label"))
    if sums.count() <= most_labels:
        return coded.join(F.broadcast(sums.drop("_n")), same).drop("_label")
    most = sums.agg(F.sum("_n") / 1000).first()[0]
    hot = F.broadcast(sums.where(F.col("_n") > most).drop("_n"))
    cold = coded.join(hot.select("_label"), same, "left_anti").join(sums.drop("_n"), same).drop("_label")
    return coded.join(hot, same).drop("_label").unionByName(cold)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    Vectors that are null or hold null or non-finite components are left out, and so are those that can't be cut into equal
    parts or differ in length from the one with the smallest id. Rows that repeat an id keep a row each. No usable vector:
    an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    books = train(rows, "id", "vec", parts, entries, rounds)
    if books is None:
        empty = rows.where("false").select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(""))
    coded = cut(encode(rows, books, "id", "vec", ("label",)))
    return with_group_error(coded, "label").withColumn("codebooks_sha256", F.lit(books.digest()))
